"""The conversation prefix trie against a plain one, and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from quillgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own[c], key=lambda x: (*x[:3], hashlib.sha256((hashlib.sha256(x[2].encode()).hexdigest() + hashlib.sha256(x[3].encode()).hexdigest()).encode()).digest()))] for c in own}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = turns.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in convs if len(full[c]) == len(path))
        out.append((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(frame).select(*COLUMNS).collect()), key=repr)


def test_trie_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    r, rows = random.Random(5), []
    for c in [*range(0, 60), *range(100, 112), 205, 300, -7, -100]:
        same = r.random() < 0.4  # many copies of one conversation
        for t in range(4 if same else r.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 else "system", "same" if same else r.choice(["a", "bb", "", None, "ключ 🙂"])))
    rows += [(400, None, None, None), (400, 3, "user", "x"), (400, 3, "user", "x"), (400, 3, "user", "a"), (400, 3, None, "z"), (None, 1, "user", "lost")]
    rows += [(500, t, "user", "long " * (t % 3)) for t in range(37)]  # one long conversation
    rows += [(501, 0, "user", "one")]
    assert built(spark, rows) == plain(rows)


def test_conversations_without_turns_are_at_the_root(spark):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 99)}
    alone = [c for c in h if h[c] >= 2][:5]
    got = built(spark, [(c, 0, "user", "hello") for c in alone])
    assert got == [(alone[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]


def test_no_rows_no_nodes(spark):
    assert built(spark, []) == [] and built(spark, [(None, 0, "user", "x")]) == []


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    theirs = con.execute(prefix_trie.ORACLE)
    at = [[c[0] for c in theirs.description].index(c) for c in COLUMNS]
    theirs = sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)
    assert theirs == sorted((tuple(r) for r in prefix_trie.query(spark, sf_dir).select(*COLUMNS).collect()), key=repr)
