"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Index: vectors become integers (``floor(scale * x)``) and are packed into shards of at
most ``SHARD_CELLS`` components. In a shard an entry's impact is its size, quantised
to ``LEVELS`` levels, and a posting segment holds the rows (with signed quantised
values) that one dimension has at one level of impact.

Search: segments are processed by falling impact, all dimensions of a level before
the next level. Between stages of levels the part of a score still missing is bounded
by the norm of what is left of the vector (Cauchy-Schwarz), so each candidate has a
lower and an upper bound. Rows that no query of the batch can still want drop out of
the segments to come. The search of a shard stops when the bounds prove that the
possible members are few enough to rescore (or no segment is left); every possible
member is rescored exactly on the full integers. No candidate is dropped without that
proof.

Thresholds: an exact search of one in ``PILOT`` vectors comes first. A query's k-th
best score there is a lower bound of its k-th best of all, and each shard starts from it.

Queries and shards meet block by block: each pair of a query block and a shard
yields k rows per query at most, and those are ranked at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathspring.llm._store import arrow, written

SHARD_CELLS = 1 << 19
"""Components in a shard at most (or one vector)."""
QUERY_BLOCK = 1024
"""About how many queries are in a query block."""
BATCH = 64
"""Queries that are searched together."""
LEVELS = 16
STAGES = (12, 8, 6, 5, 4, 3, 2, 1)
"""The least level of impact of each stage; the remainder under one level is never in a segment."""
RESCORE = 16
"""A shard's search may stop when a query has at most so many possible members, times k."""
PILOT = 64
BROADCAST_BYTES = 64 << 20
"""Query blocks up to this size are broadcast; larger ones are joined by a shuffle."""

_PACK = "block long, n int, width int, ids binary, floors binary, data binary"


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    inside = lambda x: F.when(F.abs(x * F.lit(float(scale))) < 2.0**62, F.floor(x * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component beyond 62 bits")).cast("long"))
    return v.select("id", F.transform("v", inside).alias("v"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The integers in as few bytes as hold them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


_WIDTHS = {2: np.int16, 4: np.int32, 8: np.int64}


def _pack(cells: int, rows: int | None = None):
    """Rows into packs of equal-length vectors, by block if there is one: at most so many cells, or rows, each."""

    def run(batches):
        kept: dict[tuple, list] = {}
        held = 0

        def out(keys):
            for key in keys:
                ids, floors, data = (np.concatenate(x) for x in zip(*kept.pop(key)))
                size = rows or max(1, cells // max(1, data.shape[1]))
                for at in range(0, len(ids), size):
                    d = _narrow(data[at : at + size])
                    yield pa.RecordBatch.from_pydict({"block": [key[0]], "n": pa.array([len(d)], pa.int32()), "width": pa.array([d.itemsize], pa.int32()), "ids": [ids[at : at + size].tobytes()], "floors": [floors[at : at + size].tobytes()], "data": [d.tobytes()]})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            blocks = batch.column("block").to_numpy(zero_copy_only=False) if rows else np.zeros(len(ids), dtype=np.int64)
            floors = batch.column("floor").fill_null(NO_FLOOR).to_numpy(zero_copy_only=False) if rows else np.zeros(len(ids), dtype=np.int64)
            lists = batch.column("v")
            lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for block, dims in {*zip(blocks.tolist(), lengths.tolist())}:
                at = np.flatnonzero((blocks == block) & (lengths == dims))
                kept.setdefault((block, dims), []).append((ids[at], floors[at].astype(np.int64), flat[starts[at][:, None] + np.arange(dims)]))
            held += len(flat)
            if held >= cells and not rows:
                yield from out([*kept])
                held = 0
        yield from out([*kept])

    return run


NO_FLOOR = -(1 << 63)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one vector with rows; one beyond 64 bits is an error."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(q))
    if most < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [sum(a * b for a, b in zip(row, q.tolist())) for row in x.tolist()]
    if any(not -(1 << 63) <= v < 1 << 63 for v in whole):
        raise OverflowError("a score beyond 64 bits")
    return np.array(whole, dtype=np.int64)


class Shard:
    """Vectors of one shard and their posting segments, highest impacts first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        size = np.abs(x.astype(np.int64))
        self.shift = max(0, int(size.max(initial=0)).bit_length() - LEVELS.bit_length() + 1)
        level = size >> self.shift
        left = x.astype(np.float64)
        self.whole = np.sqrt((left * left).sum(axis=1))
        self.stages, above = [], np.inf
        for least in STAGES:
            inside = (level >= least) & (level < above)
            value = np.where(inside, np.sign(x).astype(np.int64) * (level << self.shift), 0).astype(np.float64)
            left = left - value
            # by falling level, and by dimension: the rows of a segment and their values
            dims, rows = np.nonzero(inside.T)
            order = np.lexsort((rows, dims, -level[rows, dims]))
            dims, rows = dims[order], rows[order]
            cuts = np.flatnonzero(np.append(True, (np.diff(dims) != 0) | (np.diff(level[rows, dims]) != 0))) if len(dims) else np.zeros(0, dtype=np.int64)
            ends = np.append(cuts[1:], len(dims))
            segments = [(int(dims[a]), rows[a:b], value[rows[a:b], dims[a]]) for a, b in zip(cuts.tolist(), ends.tolist())]
            self.stages.append((segments, np.sqrt((left * left).sum(axis=1))))
            above = least

    def search(self, query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int):
        """(query, vector, score) of each query's k best of the shard that reach its floor (ties to smaller ids), the query's own row apart."""
        qt = np.ascontiguousarray(q.astype(np.float64).T)
        norm = np.sqrt((qt * qt).sum(axis=0))
        score = np.zeros((len(self.ids), len(q)))
        own = self.ids[:, None] == query_ids[None, :]
        possible = ~own
        alive = np.ones(len(self.ids), dtype=bool)
        floor = np.where(floors == NO_FLOOR, -np.inf, floors.astype(np.float64) * (1 - 1e-12 * np.sign(floors)) - 1e-6)
        for segments, left in self.stages:
            whole = alive.all()
            for dim, rows, values in segments:
                if not whole:
                    live = alive[rows]
                    rows, values = rows[live], values[live]
                score[rows] += values[:, None] * qt[dim]
            at = np.flatnonzero(alive)
            bound = (left[at, None] * (1 + 1e-9) + 1e-12 * self.whole[at, None]) * norm + 1e-6
            if len(at) > k:
                low = np.where(own[at], -np.inf, score[at] - bound)
                floor = np.maximum(floor, np.partition(low, len(at) - k, axis=0)[len(at) - k])
            possible = (score[at] + bound >= floor) & ~own[at]
            keep = possible.any(axis=1)
            alive[at[~keep]] = False
            at, possible = at[keep], possible[keep]
            if (possible.sum(axis=0) <= RESCORE * k).all():
                break
        found = [(np.zeros(0, dtype=np.int64),) * 3]
        for i in range(len(q)):
            mine = at[possible[:, i]]
            exact = _exact(q[i], self.x[mine])
            mine, exact = mine[exact >= floors[i]], exact[exact >= floors[i]]
            top = np.lexsort((self.ids[mine], -exact))[:k]
            found.append((np.full(len(top), query_ids[i]), self.ids[mine][top], exact[top]))
        return [np.concatenate(c) for c in zip(*found)]


def _search(k: int):
    def run(batches):
        held: tuple[bytes, Shard] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                n, m = row["n"], row["qn"]
                if held is None or held[0] != row["ids"]:
                    held = row["ids"], Shard(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], _WIDTHS[row["width"]]).reshape(n, -1))
                q = np.frombuffer(row["qdata"], _WIDTHS[row["qwidth"]]).reshape(m, -1)
                if q.shape[1] != held[1].x.shape[1]:
                    continue
                ids, floors = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["qfloors"], np.int64)
                for at in range(0, m, BATCH):
                    query, vector, score = held[1].search(ids[at : at + BATCH], q[at : at + BATCH], floors[at : at + BATCH], k)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vector, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _found(queries: DataFrame, vectors: DataFrame, k: int, blocks: int, small: bool) -> DataFrame:
    """query_id, vec_id, score: the best of each shard."""
    packed = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed = packed.repartition(blocks, "block").transform(arrow(_pack(1, 4 * QUERY_BLOCK), _PACK))
    packed = packed.select("block", *[F.col(c).alias(f"q{c}") for c in ("n", "width", "ids", "floors", "data")])
    shards = vectors.transform(arrow(_pack(SHARD_CELLS), _PACK)).drop("block", "floors")
    shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    packed = F.broadcast(packed) if small else packed
    return shards.join(packed, "block").transform(arrow(_search(k), "query_id long, vec_id long, score long"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """For each query the k candidates of highest integer inner product.

    Returns query_id long, rank int (from 1), vec_id long, score long; ties go to
    smaller ids. Candidates are all rows of vectors whose id is not the query's.

    Rows take no part if their id is null, or their vector is null, empty or holds
    a null or non-finite component. Only vectors of the query's length are its
    candidates. Of query rows that repeat an id, the least vector counts; candidate
    rows that repeat an id are ranked each for itself. Other columns are ignored.
    Empty inputs give no rows.
    """
    vectors, queries = _integers(vectors, id_col, vector_col, scale), _integers(queries, id_col, vector_col, scale)
    queries = written(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("cells")).first()
    blocks = max(1, math.ceil(size["n"] / QUERY_BLOCK))
    small = 8 * (size["cells"] or 0) <= BROADCAST_BYTES
    pilot = vectors.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(PILOT)) == 0)
    floors = _found(queries.withColumn("floor", F.lit(None).cast("long")), pilot, k, blocks, small)
    floors = floors.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("best")).select(F.col("query_id").alias("id"), F.get("best", F.lit(k - 1)).alias("floor"))
    queries = written(queries.join(floors, "id", "left"), "queries-with-floors")
    found = _found(queries, vectors, k, blocks, small)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
