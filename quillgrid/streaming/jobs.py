"""The job queue as a stream of transitions with state per job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgrid.operators.jobs import NEXT

OUT = "id long, status string, attempts int"
STATE = "status string, attempts int, at string"


def _advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts, last = state.get if state.exists else ("", 0, "")
    for frame in rows:
        for r in frame.sort_values(["at", "seq"]).itertuples():
            attempts += r.action == "lease"
            if str(r.at) >= last:
                status, last = NEXT.get(r.action, status), str(r.at)
    state.update((status, attempts, last))
    yield pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [attempts]})


def job_states(transitions: DataFrame) -> DataFrame:
    """The state of each job (id, seq, at, action) after each batch that touches it; a late transition counts as an attempt but changes no state."""
    return transitions.groupBy("id").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
