"""Exact top-k inner products by dual-tree search over cover trees.

Pivots of a bounded sample are the top of one cover for queries and data: every vector
goes to its nearest pivot, each pivot has a covering radius, and its vectors are dealt to
blocks of bounded size, which have a center and a radius. In a block a cover tree goes on:
a node's points lie within its radius of its center; its children are a net of its points
at half that radius, so children's radii are at most half (covering) and their centers
are more than half apart (separation).

A pair of nodes can hold no better score than the product of the centers plus what the
radii add; it is pruned if that is below the worst k-th score of the queries in the node.
A block of queries first meets the block of its own pivot with the highest bound, which
sets its k-th scores. Then it descends: pivots whose bound is too low fall away with all
they cover, then blocks, then nodes. Summaries of blocks are packed some hundreds a row
and joined by pivot and chunk, so no task or driver holds those of all blocks.

A data block is sent to one place, and query blocks to the data blocks that they have to
meet. Copies of one vector share a pivot but fill several blocks. The result is exact:
pivots, blocks and trees only decide what is skipped. found() also tells how many pairs
of rows were compared; spread-out vectors of many dimensions leave bounds little to prune.

Cases: vectors that are null, or hold null or non-finite components, and null ids take
no part; a shorter vector counts as filled with zeros; rows with the query's id are not
its candidates; equal scores go by the smaller id, so ties are settled; a repeated row
counts each time, as a candidate and as a query, whose rows share the k ranks; with k candidates or fewer all are returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import cut, table

K, SCALE = 20, 64
#: Rows that pivots are chosen from, by the smallest hashes of their ids; and pivots at most.
SAMPLE, PIVOTS = 4_096, 64
#: Rows of a data and a query block; of a leaf; rows compared before bounds are looked at again.
DATA_ROWS, QUERY_ROWS, LEAF, STEP = 4_096, 512, 16, 512
#: Blocks whose summaries make one row.
CHUNK = 256
#: Room for rounding in a bound, as a share of the norms it is made of.
SLACK = 1e-9


def net(points: np.ndarray, radius: float, most: int | None = None, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first points until all lie within radius of one (or there are most of them): their places, and each point's nearest among them."""
    squares = (points * points).sum(1)
    chosen, near = [start], np.zeros(len(points), np.int64)
    far = np.maximum(squares - 2 * (points @ points[start]) + squares[start], 0)
    while far.max() > radius * radius and (most is None or len(chosen) < most):
        x = int(far.argmax())
        d = np.maximum(squares - 2 * (points @ points[x]) + squares[x], 0)
        closer = d < far
        near[closer], far = len(chosen), np.where(closer, d, far)
        chosen.append(x)
    return np.array(chosen), near


@dataclass
class CoverTree:
    """points and ids in the order of the leaves; of each node its range of them, center, radius, the center's norm and its children."""

    points: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    below: list[np.ndarray]

    @staticmethod
    def build(points: np.ndarray, ids: np.ndarray) -> CoverTree:
        order, spans, centers, radii, below = [], [], [], [], []
        # Nodes to grow: their rows, the place of the center among these, and the parent.
        first = int(np.linalg.norm(points - points.mean(0), axis=1).argmin())
        todo, size = [(np.arange(len(points)), first, -1)], 0
        while todo:
            rows, c, parent = todo.pop()
            mine = points[rows]
            radius, at = float(np.linalg.norm(mine - mine[c], axis=1).max()), len(spans)
            spans.append((size, size + len(rows)))
            centers.append(mine[c])
            radii.append(radius)
            below.append([])
            if parent >= 0:
                below[parent].append(at)
            if len(rows) <= LEAF or radius == 0:
                order.append(rows)
                size += len(rows)
            else:
                # The node's center stays the center of its first child.
                chosen, near = net(mine, radius / 2, start=c)
                for k in range(len(chosen) - 1, -1, -1):
                    inside = np.flatnonzero(near == k)
                    todo.append((rows[inside], int(np.searchsorted(inside, chosen[k])), at))
        order, starts, ends = np.concatenate(order), *np.array(spans, np.int64).T
        centers = np.array(centers)
        return CoverTree(points[order], ids[order], starts, ends, centers, np.array(radii), np.linalg.norm(centers, axis=1), [np.array(x, np.int64) for x in below])


class TopK:
    """The best scores of each query so far, their ids, and whether they were added here or before; missing ones are -inf."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        self.fresh = np.ones((len(ids), k), bool)

    def worst(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, start: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the queries from start against ids."""
        mine = self.ids[start : start + len(scores)]
        may = (scores >= self.worst()[start : start + len(scores), None]) & (ids[None, :] != mine[:, None])
        for r in np.flatnonzero(may.any(1)):
            at = np.flatnonzero(may[r])
            s, i = scores[r, at], ids[at]
            if len(at) > 4 * self.k:  # ties at the cut stay in
                high = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[high], i[high]
            new = np.concatenate([self.fresh[start + r], np.ones(len(s), bool)])
            s, i = np.concatenate([self.scores[start + r], s]), np.concatenate([self.found[start + r], i])
            best = np.lexsort((i, -s))[: self.k]
            self.scores[start + r], self.found[start + r], self.fresh[start + r] = s[best], i[best], new[best]


def search(queries: CoverTree, data: CoverTree, top: TopK) -> int:
    """Adds the data's scores to top, whose queries are in the tree's order. Returns the pairs of rows compared.

    A query node goes down the data tree with a frontier of nodes, whose bounds are one matrix product.
    """
    leaf = np.array([len(x) == 0 for x in data.below])

    def bounds(q: int, ds: np.ndarray) -> np.ndarray:
        rq, nq, rd, nd = queries.radii[q], queries.norms[q], data.radii[ds], data.norms[ds]
        return data.centers[ds] @ queries.centers[q] + nq * rd + nd * rq + rq * rd + SLACK * (nq + rq) * (nd + rd)

    compared, todo = 0, [(0, np.zeros(1, np.int64))]
    while todo:
        q, ds = todo.pop()
        s, e = queries.starts[q], queries.ends[q]
        most = bounds(q, ds)
        ds = ds[most >= top.worst()[s:e].min()]
        if not len(ds):
            continue
        ends = leaf[ds]
        if len(queries.below[q]) and (ends.all() or queries.radii[q] >= data.radii[ds].max()):
            todo += [(int(c), ds) for c in queries.below[q]]
            continue
        inner = [data.below[d] for d in ds[~ends]]
        if len(queries.below[q]):
            todo.append((q, np.concatenate([ds[ends], *inner])))
            continue
        if inner:
            todo.append((q, np.concatenate(inner)))
        # The leaves of the highest bounds first; what they find may rule out the others.
        rest = ds[ends]
        rest = rest[np.argsort(-bounds(q, rest), kind="stable")]
        while len(rest):
            n = max(1, int(np.searchsorted(np.cumsum(data.ends[rest] - data.starts[rest]), STEP, "right")))
            rows = np.concatenate([np.arange(data.starts[d], data.ends[d]) for d in rest[:n]])
            top.add(s, data.ids[rows], queries.points[s:e] @ data.points[rows].T)
            compared += int((e - s) * len(rows))
            rest = rest[n:]
            rest = rest[bounds(q, rest) >= top.worst()[s:e].min()]
    return compared


def _whole(vectors: pd.Series) -> np.ndarray:
    """Quantised vectors as float64, which is exact for their products up to 2**53."""
    got = [np.frombuffer(v, np.float64) for v in vectors]
    out = np.zeros((len(got), max(map(len, got), default=0)))
    for k, v in enumerate(got):
        out[k, : len(v)] = v
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v (float64 bytes of floor(64 * x)) of the rows that take part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, np.floor(SCALE * np.asarray(v, np.float64)).tobytes()) for i, v in zip(batch["vec_id"], batch["embedding"], strict=True)]
            yield pd.DataFrame(rows, columns=["vec_id", "v"])

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    part = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return part.select("vec_id", "embedding").mapInPandas(run, "vec_id long, v binary")


def _assigned(pivots: np.ndarray):
    """The nearest pivot of each vector, and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, p = _matched(_whole(batch["v"]), pivots)
                near = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
                yield batch.assign(pivot=near.astype(np.int64), far=np.linalg.norm(x - p[near], axis=1))

    return run


ASSIGNED = "vec_id long, v binary, pivot long, far double"


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    """One block: its rows, center and radius."""
    x = _whole(group["v"])
    center = x.mean(0)
    return pd.DataFrame(
        {
            "block": [group["block"].iloc[0]],
            "pivot": [group["pivot"].iloc[0]],
            "rows": [len(x)],
            "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
            "points": [x.tobytes()],
            "center": [center.tobytes()],
            "radius": [float(np.linalg.norm(x - center, axis=1).max()) * (1 + 1e-9)],
        }
    )


PACKED = "block long, pivot long, rows long, ids binary, points binary, center binary, radius double"


def _blocks(assigned: DataFrame, counts: dict[int, int], rows: int) -> DataFrame:
    """Blocks of at most about rows vectors of one pivot, packed as one row each."""
    parts = F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, -(-n // rows))]) if counts else F.create_map(F.lit(0), F.lit(1))
    # Repeated rows hash alike, so the part of a row also depends on where it was read.
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.element_at(parts, F.col("pivot").cast("int")))
    return cut(assigned.withColumn("block", F.col("pivot") * 2**40 + part).groupBy("block").applyInPandas(_packed, PACKED))


def _tree(row) -> CoverTree:
    return CoverTree.build(np.frombuffer(row.points, np.float64).reshape(row.rows, -1).copy(), np.frombuffer(row.ids, np.int64))


def _matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both filled with zeros to one width."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _upper(x: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What each query of x can score at most in each ball."""
    x, centers = _matched(x, centers)
    size = np.linalg.norm(x, axis=1)[:, None]
    return x @ centers.T + size * radii[None, :] * (1 + SLACK) + SLACK * size * np.linalg.norm(centers, axis=1)[None, :]


def _chunks(blocks: DataFrame) -> DataFrame:
    """Summaries of up to CHUNK blocks of a pivot as one row each. A pivot's blocks are numbered from 0, so chunks are too."""
    number = F.col("block") % 2**40

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        centers = _whole(group["center"])
        return pd.DataFrame({"pivot": [group["pivot"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "n": [len(group)], "blocks": [group["block"].to_numpy(np.int64).tobytes()], "centers": [centers.tobytes()], "radii": [group["radius"].to_numpy(float).tobytes()]})

    rows = blocks.select("block", "pivot", "center", "radius", F.floor(number / CHUNK).cast("long").alias("chunk"))
    return cut(rows.groupBy("pivot", "chunk").applyInPandas(summed, "pivot long, chunk long, n long, blocks binary, centers binary, radii binary"))


def _asks(pivots: np.ndarray, radii: np.ndarray, chunks: dict[int, int], first: bool):
    """The pivots and chunks that each query block has to look at: at first those of its own pivot (or, if that has no data, of the pivot of highest bound), then those its k-th scores leave."""
    at = np.array(sorted(chunks), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples() if len(at) else ():
                upper = _upper(np.frombuffer(row.points, np.float64).reshape(row.rows, -1), pivots[at], radii[at])
                if first:
                    mine = [row.pivot if row.pivot in chunks else int(at[upper.max(0).argmax()])]
                else:
                    worst = np.frombuffer(row.scores, np.float64).reshape(row.rows, -1)[:, -1]
                    mine = at[(upper >= worst[:, None]).any(0)].tolist()
                out += [(row.block, p, c) for p in mine for c in range(chunks[p])]
            yield pd.DataFrame(out, columns=["query_block", "pivot", "chunk"])

    return run


def _looked(first: bool):
    """The blocks of a chunk that a query block has to meet, with their bounds: the best one at first, then all that its k-th scores leave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                blocks, radii = np.frombuffer(row.blocks, np.int64), np.frombuffer(row.radii, float)
                upper = _upper(np.frombuffer(row.points, np.float64).reshape(row.rows, -1), np.frombuffer(row.centers, float).reshape(row.n, -1), radii)
                if first:
                    out.append((row.query_block, int(blocks[upper.max(0).argmax()]), float(upper.max())))
                else:
                    worst = np.frombuffer(row.scores, np.float64).reshape(row.rows, -1)[:, -1]
                    out += [(row.query_block, int(blocks[j]), 0.0) for j in np.flatnonzero((upper >= worst[:, None]).any(0)) if blocks[j] != row.home]
            yield pd.DataFrame(out, columns=["query_block", "block", "bound"])

    return run


#: Rows of a meeting: the data block first, then the query blocks that meet it.
RESULT = "block long, pivot long, rows long, ids binary, points binary, scores binary, found binary, home long, compared long"


def _met(k: int):
    """Each query block's best scores in a data block, without those from before. Rows come sorted by data block, that block first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.side == 0:
                    tree = _tree(row)
                    continue
                mine = _tree(row)
                for t, other in ((mine, tree), (tree, mine)):
                    t.points, t.centers = _matched(t.points, other.points)[0], _matched(t.centers, other.points)[0]
                top = TopK(mine.ids, k)
                if row.scores is not None:
                    order = np.argsort(np.frombuffer(row.ids, np.int64), kind="stable")
                    back = np.empty(len(order), np.int64)
                    back[np.argsort(mine.ids, kind="stable")] = order
                    top.scores = np.frombuffer(row.scores, np.float64).reshape(row.rows, -1)[back].copy()
                    top.found = np.frombuffer(row.found, np.int64).reshape(row.rows, -1)[back].copy()
                    top.fresh[:] = False
                compared = search(mine, tree, top)
                scores = np.where(top.fresh, top.scores, -np.inf)
                out.append((row.block, row.pivot, row.rows, mine.ids.tobytes(), mine.points.tobytes(), scores.tobytes(), top.found.tobytes(), row.at, compared))
            yield pd.DataFrame(out, columns=["block", "pivot", "rows", "ids", "points", "scores", "found", "home", "compared"])

    return run


def _meet(queries: DataFrame, data: DataFrame, pairs: DataFrame, parts: int, k: int) -> DataFrame:
    """queries' results after the meetings (query_block, block)."""
    used = data.join(pairs.select("block").distinct(), "block", "left_semi")
    none = F.lit(None).cast("binary")
    columns = ["block", "pivot", "rows", "ids", "points"]
    left = used.select(F.col("block").alias("at"), F.lit(0).alias("side"), *columns, none.alias("scores"), none.alias("found"))
    moved = queries.join(pairs.select("query_block", F.col("block").alias("at")), F.col("block") == F.col("query_block"))
    right = moved.select("at", F.lit(1).alias("side"), *columns, "scores", "found")
    met = left.unionByName(right).repartition(parts, "at").sortWithinPartitions("at", "side", "block")
    return met.mapInPandas(_met(k), RESULT)


def found(vectors: DataFrame, queries: DataFrame | None = None, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The k best rows of vectors (vec_id, embedding) for each query (query_id, rank, vec_id, score), and the meetings of blocks (rows, compared), whose sum tells how many pairs were compared."""
    data = cut(quantised(vectors))
    asked = data.where(F.col("vec_id") % 20 == 0) if queries is None else quantised(queries)
    sample = [r.v for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    x = np.unique(_whole(pd.Series(sample)) if sample else np.zeros((1, 1)), axis=0)
    pivots = x[net(x, 0.0, PIVOTS)[0]]
    assigned, asked = (cut(df.mapInPandas(_assigned(pivots), ASSIGNED)) for df in (data, asked))
    # At most PIVOTS rows each.
    covers = {r.pivot: r for r in assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    radii = np.array([covers[p].radius * (1 + SLACK) if p in covers else 0.0 for p in range(len(pivots))])
    blocks = _blocks(assigned, {p: r.n for p, r in covers.items()}, DATA_ROWS)
    asked_blocks = _blocks(asked, {r.pivot: r["count"] for r in asked.groupBy("pivot").count().collect()}, QUERY_ROWS)
    chunks = _chunks(blocks)
    numbers = {r.pivot: r.n for r in chunks.groupBy("pivot").agg((F.max("chunk") + 1).alias("n")).collect()}
    none = F.lit(None).cast("binary")
    asked_blocks = asked_blocks.select("block", "pivot", "rows", "ids", "points", none.alias("scores"), none.alias("found"), F.lit(-1).cast("long").alias("home"))
    spread = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count())

    def pairs(of: DataFrame, first: bool) -> DataFrame:
        asks = of.mapInPandas(_asks(pivots, radii, numbers, first), "query_block long, pivot long, chunk long")
        seen = asks.join(chunks, ["pivot", "chunk"]).join(of.select(F.col("block").alias("query_block"), "rows", "points", "scores", "home"), "query_block")
        return seen.mapInPandas(_looked(first), "query_block long, block long, bound double")

    homes = pairs(asked_blocks, True).groupBy("query_block").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    started = cut(_meet(asked_blocks, blocks, cut(homes), spread, k))
    ended = cut(_meet(started, blocks, cut(pairs(started, False)), spread, k))
    met = started.unionByName(ended)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                scores, hits = (np.frombuffer(b, t).reshape(row.rows, -1) for b, t in ((row.scores, np.float64), (row.found, np.int64)))
                q, j = np.nonzero(scores > -np.inf)
                yield pd.DataFrame({"query_id": ids[q], "vec_id": hits[q, j], "score": scores[q, j].astype(np.int64)})

    rows = met.select("rows", "ids", "scores", "found").mapInPandas(listed, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), met.select("rows", "compared")


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of vectors (vec_id, embedding) for each query. queries: rows like vectors'; by default those with an id divisible by 20."""
    return found(vectors, queries, k)[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_dualtree: the 20 best rows for every row whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""
