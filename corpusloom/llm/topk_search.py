"""Exact top-k by inner product, by pivot-table elimination.

Components become floor(scale * x).  A vector x is lifted to (x, sqrt(M - |x|^2)), M the
largest squared length, and a query q to (q, 0), so that |q - x|^2 = |q|^2 + M - 2 q.x:
the largest inner products are the nearest lifted vectors.  Every block of vectors
carries a table of distances to the pivots; the largest difference to the query's own
distances bounds a candidate's distance from below and so its score from above.
Candidates are scored in order of that bound until the k-th best score is beyond it.
How much that spares depends on the vectors: of the given embeddings, unit vectors whose
twentieth neighbour lies some 70 degrees away, nearly all candidates are scored.

Queries and candidates are dealt out in blocks, never joined row by row: a group of
GROUP queries meets shards of SHARD blocks, each of which gives k rows a query.

Vectors that are null, or hold null or non-finite components, and rows without an id
take no part.  Vectors of other lengths aren't compared.  Rows with equal ids are
vectors of their own; ties go to the smaller id.  Scores are longs that wrap as Java's
do; components saturate at the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WorkTable

BLOCK, SHARD, GROUP = 2048, 8, 4096
PIVOTS, SAMPLE = 64, 2000
EXACT = float(2**52)


def integers(vectors: list, scale: int) -> np.ndarray:
    x = np.floor(scale * np.array(vectors, np.float64))
    top = 2.0**63
    out = np.where(np.abs(x) < top, x, 0).astype(np.int64)
    out[x >= top] = np.iinfo(np.int64).max
    out[x <= -top] = np.iinfo(np.int64).min
    return out


def pack(batches: Iterator[pa.RecordBatch], scale: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: part, n, width, longest squared length, ids, integers."""
    from pyspark import TaskContext

    held: dict[int, tuple[list, list]] = {}
    part = TaskContext.get().partitionId() << 32

    def flush(width: int) -> pa.RecordBatch:
        nonlocal part
        ids, vectors = held.pop(width)
        x = integers(vectors, scale)
        row = [[part], [len(ids)], [width], [float((x.astype(np.float64) ** 2).sum(axis=1).max())], [np.array(ids, "<i8").tobytes()], [x.astype("<i8").tobytes()]]
        part += 1
        types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, types, strict=True)], ["part", "n", "width", "longest", "ids", "vectors"])

    for batch in batches:
        for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not x:
                continue
            ids, vectors = held.setdefault(len(x), ([], []))
            ids.append(vec_id)
            vectors.append(x)
            if len(ids) == block:
                yield flush(len(x))
    for width in [*held]:
        yield flush(width)


def lift(x: np.ndarray, most: float) -> np.ndarray:
    y = x.astype(np.float64)
    return np.column_stack((y, np.sqrt(np.maximum(most - (y**2).sum(axis=1), 0))))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n vectors each as far as can be from those before it."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T, 0))


def best(queries: np.ndarray, own: np.ndarray, query_table: np.ndarray, ids: np.ndarray, uids: np.ndarray, x: np.ndarray, table: np.ndarray, most: float, k: int, first: int = 256) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """[(query, places, scores, how many were scored)]: the k best candidates of each query, the query's own row left out.

    x: int64.  Scores beyond 2^52, where bounds in floating point don't hold, are all computed.
    """
    biggest = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * x.shape[1]
    exact = biggest < EXACT
    y = x.astype(np.float64) if exact else x
    out = []
    slack = 1e-7 * (most + 1)
    table, query_table = np.ascontiguousarray(table.T, np.float32), query_table.astype(np.float32)  # pivots side by side
    gaps, rounding = np.empty_like(table), 1e-6 * (1 + max(float(table.max(initial=0)), float(query_table.max(initial=0))))
    for i, q in enumerate(queries):
        mine = q.astype(np.float64) if exact else q
        score = lambda at: (y[at] @ mine).astype(np.int64)  # noqa: B023, E731
        if not exact:
            at = np.arange(len(x))
            got = score(at)
        else:
            np.subtract(table, query_table[i][:, None], out=gaps)
            np.abs(gaps, out=gaps)
            low = gaps.max(axis=0).astype(np.float64)
            bound = (float(mine @ mine) + most - np.maximum(low - rounding, 0) ** 2) / 2 + slack
            head = np.argpartition(-bound, min(first, len(x) - 1))[:first]
            at, got, rest = head, score(head), np.ones(len(x), bool)
            rest[head] = False
            todo = np.flatnonzero(rest)
            todo = todo[np.argsort(-bound[todo], kind="stable")] if len(todo) < 4096 else todo
            width = 4 * first
            while len(todo):
                kept = got[uids[at] != own[i]]
                floor = np.partition(kept, -k)[-k] if len(kept) >= k else -np.inf
                todo = todo[bound[todo] >= floor]  # equal scores may still win by id
                if not len(todo):
                    break
                if len(todo) > width:
                    part = np.argpartition(-bound[todo], width)
                    now, todo = todo[part[:width]], todo[part[width:]]
                else:
                    now, todo = todo, todo[:0]
                width *= 4
                at, got = np.concatenate((at, now)), np.concatenate((got, score(now)))
        scored = len(at)
        other = uids[at] != own[i]
        at, got = at[other], got[other]
        order = np.lexsort((uids[at], ids[at], -got))[:k] if len(got) <= 4 * k else None
        if order is None:
            edge = np.partition(got, -k)[-k]
            near = np.flatnonzero(got >= edge)
            order = near[np.lexsort((uids[at[near]], ids[at[near]], -got[near]))[:k]]
        out.append((i, at[order], got[order], scored))
    return out


FOUND = "query_uid long, query_id long, vec_id long, uid long, score long, scored long"


def search(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by `every`; scored: candidates scored for the query."""
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & sound)
    blocks = WorkTable(rows.mapInArrow(lambda batches: pack(batches, scale), "part long, n long, width int, longest double, ids binary, vectors binary")).df
    most = {r["width"]: r["m"] for r in blocks.groupBy("width").agg(F.max("longest").alias("m")).collect()}
    drawn = rows.select("x").orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(SAMPLE)  # a bounded sample
    drawn = WorkTable(drawn).df.collect()  # limited by the executors, not by the driver
    points = {w: far_apart(lift(integers([r["x"] for r in drawn if len(r["x"]) == w] or [[0.0] * w], scale), m), pivots) for w, m in most.items()}

    def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for width, raw in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i8").reshape(-1, width)
                tables.append(distances(lift(own, most[width]), points[width]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables, pa.binary())], ["part", "n", "width", "ids", "vectors", "pivots"])

    def queries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, width, ids, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                own = np.frombuffer(ids, "<i8")
                at = np.flatnonzero(own % every == 0)
                if len(at):
                    row = [[part], [len(at)], [width], [own[at].tobytes()], [at.astype("<i8").tobytes()], [np.frombuffer(raw, "<i8").reshape(-1, width)[at].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "n", "width", "ids", "places", "vectors"])

    bare = blocks.select("part", "n", "width", "ids", "vectors")
    tabled = bare.mapInArrow(with_table, "part long, n long, width int, ids binary, vectors binary, pivots binary")
    asked = bare.mapInArrow(queries_of, "part long, n long, width int, ids binary, places binary, vectors binary")
    numbered = blocks.select("part", "width").withColumn("seq", F.row_number().over(Window.partitionBy("width").orderBy("part")) - 1)  # a row a block
    lots = {r["width"]: (int(r["shards"]), int(r["groups"])) for r in blocks.groupBy("width").agg(F.ceil(F.count("*") / SHARD).alias("shards"), F.ceil(F.sum("n") / every / GROUP).alias("groups")).collect()}
    plan = spark.createDataFrame([(w, s, g) for w, (s, g) in lots.items()] or [], "width int, shards long, groups long")
    place = numbered.join(F.broadcast(plan), "width")  # a row a width
    left = tabled.join(place.drop("width"), "part").withColumn("shard", F.pmod("seq", "shards")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("seq", "shards", "groups")
    right = asked.join(place.drop("width"), "part").withColumn("group", F.pmod("seq", "groups")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("seq", "shards", "groups")

    def meet(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if candidates.num_rows and queries.num_rows:
            width = candidates.column("width")[0].as_py()
            join = lambda t, c, w: np.concatenate([np.frombuffer(r, "<i8" if c != "pivots" else np.float64).reshape(-1, w) for r in t.column(c).to_pylist()])
            base = lambda t, inner: np.concatenate([(p << 16) + i for p, i in zip(t.column("part").to_pylist(), inner, strict=True)])
            uids = base(candidates, [np.arange(n) for n in candidates.column("n").to_pylist()])
            own = base(queries, [np.frombuffer(r, "<i8") for r in queries.column("places").to_pylist()])
            q = join(queries, "vectors", width)
            lifted = np.column_stack((q.astype(np.float64), np.zeros(len(q))))
            ids, query_ids = join(candidates, "ids", 1)[:, 0], join(queries, "ids", 1)[:, 0]
            for i, at, got, scored in best(q, own, distances(lifted, points[width]), ids, uids, join(candidates, "vectors", width), join(candidates, "pivots", len(points[width])), most[width], k):
                for column, values in zip(out, (np.full(len(at), own[i]), np.full(len(at), query_ids[i]), ids[at], uids[at], got, np.where(np.arange(len(at)) == 0, scored, 0)), strict=True):
                    column.append(values)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("query_uid", "query_id", "vec_id", "uid", "score", "scored"), out, strict=True)})

    found = left.groupBy("width", "group", "shard").cogroup(right.groupBy("width", "group", "shard")).applyInArrow(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid"))
    told = found.withColumn("scored", F.sum("scored").over(Window.partitionBy("query_uid")))  # a shard tells it in its first row
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "scored")


def op6(vectors: DataFrame) -> DataFrame:
    return search(vectors).drop("scored")
