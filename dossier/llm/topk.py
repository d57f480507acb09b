"""Exact top-k by inner product: a pivot table gives distance bounds that eliminate candidates.

Components x become floor(64 * x), as integers. With Euclidean distance d, the score of q
and x is (|q|^2 + |x|^2 - d(q, x)^2) / 2, and for any pivot p, d(q, x) >= |d(q, p) - d(x, p)|;
the maximum over many pivots, whose distances are computed once a row, bounds the score from
above. Pivots come from a bounded sample by farthest-first choice; any choice gives the same
result.

Candidates are ordered by nearest pivot and distance to it and written as blocks in the
shared folder, GROUP_BLOCKS neighbouring blocks a group, with the least and greatest distance
to every pivot for blocks and groups. Only the groups' ranges are broadcast, a few hundred
bytes for millions of rows; those of blocks are read with their group. A task takes a batch of
queries and visits groups and their blocks in the order of their bounds, best first, reading
only those it needs; in a block it visits tiles in the order of their bounds, and in a tile only
candidates whose own bound reaches a query's k-th best score so far are evaluated. It stops
when no group's bound reaches any query's k-th best. So queries and candidates meet without
a cross join or a shuffle of pairs, and a task holds one batch and one block.

How much the bounds eliminate depends on the data: vectors at nearly equal distances, as
random ones of many dimensions are, leave little to eliminate, and then the search is a
blocked scan.

Defined cases: vectors that are null or hold a null or non-finite component take no part,
nor rows with a null vec_id. Shorter vectors count as padded with zeros. Repeated rows are
candidates of each other; repeated query ids each give their rows. Ties go to the smaller
vec_id. Scores are exact whole numbers however large the components; one that a long can't
hold is given as the nearest long. Other columns are ignored, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import scratch, written

K = 20
SCALE = 64
PIVOTS = 32
#: Rows that pivots are chosen from, at most.
PIVOT_SAMPLE = 4096
BLOCK_ROWS = 16384
GROUP_BLOCKS = 256
TILE_ROWS = 1024
QUERY_ROWS = 512
#: Groups whose blocks' ranges a worker keeps.
KEPT_GROUPS = 64
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

RESULT = "query_id long, rank int, vec_id long, score long"


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as floats, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(off)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width))
    if len(size):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)] = flat[off[0] : off[-1]]
    return out


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first from the row of greatest norm; fewer if the sample has fewer different rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [int(np.argmax((sample * sample).sum(1)))]
    gap = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def quantized(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row (unique), vec_id and comps, the whole components, of the rows that take part; as a table."""
    comps = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    sound = F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), comps.cast("array<double>").alias("comps"))
    return written(rows, "vectors")


def _bound(nq: np.ndarray, nx: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Greatest possible score, with room for rounding."""
    top = (nq + nx - gap * gap) / 2
    return top + 1e-6 * (nq + nx) + 1e-3


class _Best:
    """The k best (score, vec_id) of each query of a batch; `kth` is the last one's score, as a float."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LOW)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.there = np.zeros((n, k), bool)
        self.kth = np.full(n, -np.inf)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, some: np.ndarray) -> None:
        """scores: rows x ids, where `some` is true."""
        k = self.k
        hit = some & (scores >= self.kth[rows][:, None])
        if scores.shape[1] > 2 * k:
            guess = np.where(some, scores, _LOW)
            hit &= scores >= np.partition(guess, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        at, col = np.nonzero(hit)
        if not len(at):
            return
        some_rows = np.flatnonzero(np.bincount(at, minlength=len(rows)))
        r = np.r_[at, np.repeat(some_rows, k)]
        s = np.r_[scores[at, col], self.score[rows[some_rows]].ravel()]
        i = np.r_[ids[col], self.id[rows[some_rows]].ravel()]
        there = np.r_[np.ones(len(at), bool), self.there[rows[some_rows]].ravel()]
        order = np.lexsort((i, ~s, ~there, r))  # ~s descends as s ascends, and can't overflow
        r, s, i, there = r[order], s[order], i[order], there[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        keep = place < k
        for mine, new in ((self.score, s), (self.id, i), (self.there, there)):
            mine[rows[r[keep]], place[keep]] = new[keep]
        full = self.there[rows[some_rows], k - 1]
        self.kth[rows[some_rows[full]]] = self.score[rows[some_rows[full]], k - 1]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs. Floats hold whole numbers up to 2**53; what may pass that is added up as Python integers."""
    out = a @ b.T
    big = np.abs(a).max(axis=1, initial=0)[:, None] * np.abs(b).max(axis=1, initial=0)[None] * a.shape[1] >= 2.0**53
    if not big.any():
        return out.astype(np.int64)
    exact = np.where(big, 0, out).astype(np.int64)
    for i, j in zip(*np.nonzero(big)):
        exact[i, j] = min(max(sum(int(x) * int(y) for x, y in zip(a[i], b[j])), _LOW), _HIGH)
    return exact


def search_block(best: _Best, q: np.ndarray, qrow: np.ndarray, dq: np.ndarray, x: np.ndarray, row: np.ndarray, ids: np.ndarray, dx: np.ndarray, tile_rows: int = TILE_ROWS) -> None:
    """Visit the tiles of a block in the order of their bounds; evaluate what the bounds leave."""
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    cuts = list(range(0, len(x), tile_rows))
    low = np.stack([dx[c : c + tile_rows].min(0) for c in cuts])
    high = np.stack([dx[c : c + tile_rows].max(0) for c in cuts])
    norm = np.array([nx[c : c + tile_rows].max() for c in cuts])
    gap = np.zeros((len(q), len(cuts)))
    for p in range(dx.shape[1]):
        np.maximum(gap, np.maximum(low[:, p][None] - dq[:, p][:, None], dq[:, p][:, None] - high[:, p][None]), out=gap)
    tile = _bound(nq[:, None], norm[None], gap)
    for t in np.argsort(-tile.max(0), kind="stable"):
        rows = np.flatnonzero(tile[:, t] >= best.kth)
        if not len(rows):
            continue
        c = cuts[t]
        part = slice(c, c + tile_rows)
        own = np.zeros((len(rows), len(nx[part])), np.float32)
        a, b = dq[rows].astype(np.float32), dx[part].astype(np.float32)
        work = np.empty_like(own)
        for p in range(dx.shape[1]):
            np.subtract(a[:, p][:, None], b[:, p][None], out=work)
            np.abs(work, out=work)
            np.maximum(own, work, out=own)
        own -= np.float32(1e-6) * (a.max(initial=0) + b.max(initial=0))
        np.maximum(own, 0, out=own)
        need = _bound(nq[rows][:, None], nx[part][None], own) >= best.kth[rows][:, None]
        cols = np.flatnonzero(need.any(0))
        if not len(cols):
            continue
        scores = _product(q[rows], x[part][cols])
        best.take(rows, ids[part][cols], scores, need[:, cols] & (qrow[rows][:, None] != row[part][cols][None]))


def search(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, tile_rows: int = TILE_ROWS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that `is_query` marks. vectors: from `quantized`."""
    spark = vectors.sparkSession
    width, total = vectors.agg(F.max(F.size("comps")), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    taken = vectors.orderBy(F.xxhash64("row"), "row").limit(sample).select("comps").toArrow()
    table = choose_pivots(_matrix(taken.column(0), width), pivots)
    count = len(table)
    shipped = spark.sparkContext.broadcast(table)  # pivots x dimensions

    def measure(batches):
        p = shipped.value
        for b in batches:
            if b.num_rows:
                d = distances(_matrix(b.column(2), width), p)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(d), pa.list_(pa.float64())), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=["row", "vec_id", "comps", "dist", "cell", "near"])

    pivoted = written(vectors.select("row", "vec_id", "comps").mapInArrow(measure, "row long, vec_id long, comps array<double>, dist array<double>, cell int, near double"), "pivot-table")
    n_blocks = max(1, -(-total // block_rows))
    ordered = pivoted.repartitionByRange(n_blocks, "cell", "near", "row").sortWithinPartitions("cell", "near", "row")
    folder = scratch(spark, "blocks")
    ordered.withColumn("block", F.spark_partition_id()).write.mode("overwrite").partitionBy("block").parquet(folder)
    at = lambda f, name: [f(F.get("dist", F.lit(i))).alias(f"{name}{i}") for i in range(count)]
    norm = F.aggregate("comps", F.lit(0.0), lambda s, x: s + x * x)
    names = [f"{n}{i}" for n in ("low", "high") for i in range(count)]
    ranges = spark.read.parquet(folder).groupBy("block").agg(F.max(norm).alias("norm"), *at(F.min, "low"), *at(F.max, "high"))
    bounds = scratch(spark, "bounds")
    ranges.withColumn("group", F.floor(F.col("block") / group_blocks).cast("int")).repartition("group").write.partitionBy("group").mode("overwrite").parquet(bounds)
    # One row of 2 * pivots + 2 numbers for block_rows * group_blocks rows.
    groups = spark.read.parquet(bounds).groupBy("group").agg(F.max("norm").alias("norm"), *(F.min(c).alias(c) for c in names[:count]), *(F.max(c).alias(c) for c in names[count:])).orderBy("group").toPandas()
    whole = spark.sparkContext.broadcast((groups["group"].to_numpy(), groups["norm"].to_numpy(float), groups[names[:count]].to_numpy(float), groups[names[count:]].to_numpy(float)))

    def files_of(files: fs.FileSystem, place: str, columns: list[str]) -> pa.Table:
        found = sorted(i.path for i in files.get_file_info(fs.FileSelector(place)) if i.path.endswith(".parquet"))
        return pa.concat_tables([pq.ParquetFile(files.open_input_file(f)).read(columns=columns) for f in found])

    def reach(dq: np.ndarray, nq: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Greatest possible score of each query in each range."""
        gap = np.zeros((len(dq), len(norms)))
        for p in range(dq.shape[1]):
            np.maximum(gap, np.maximum(low[:, p][None] - dq[:, p][:, None], dq[:, p][:, None] - high[:, p][None]), out=gap)
        return _bound(nq[:, None], norms[None], gap)

    def visit(top: np.ndarray, best: _Best):
        """Numbers of ranges, best first, with the queries that they may serve; until no later one can serve any."""
        for b in np.argsort(-top.max(0), kind="stable"):
            go = np.flatnonzero(top[:, b] >= best.kth)
            if len(go):
                yield b, go
            elif (top.max(0)[b] < best.kth).all():
                return

    def answer(q, qrow, qid, dq, files, root, group_of):
        numbers, norms, low, high = whole.value
        nq = (q * q).sum(1)
        best = _Best(len(q), k)
        for g, _ in visit(reach(dq, nq, norms, low, high), best):
            blocks, *ranged = group_of(int(numbers[g]))
            for b, go in visit(reach(dq, nq, *ranged), best):
                t = files_of(files, f"{root}/block={blocks[b]}", ["row", "vec_id", "comps", "dist"])
                part = _Best(len(go), k)
                fields = ("score", "id", "there", "kth")
                for f in fields:
                    setattr(part, f, getattr(best, f)[go])
                search_block(part, q[go], qrow[go], dq[go], _matrix(t["comps"], width), t["row"].to_numpy(), t["vec_id"].to_numpy(), _matrix(t["dist"], count), tile_rows)
                for f in fields:
                    getattr(best, f)[go] = getattr(part, f)
        row, place = np.nonzero(best.there)
        return pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(place + 1, pa.int32()), pa.array(best.id[row, place]), pa.array(best.score[row, place])], names=["query_id", "rank", "vec_id", "score"])

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        _, ranged = fs.FileSystem.from_uri(bounds)

        @lru_cache(maxsize=KEPT_GROUPS)
        def group_of(g: int):
            t = files_of(files, f"{ranged}/group={g}", ["block", "norm", *names])
            part = lambda c: np.stack([t[n].to_numpy() for n in c], axis=1)
            return t["block"].to_numpy(), t["norm"].to_numpy(), part(names[:count]), part(names[count:])

        for b in batches:
            for i in range(0, b.num_rows, query_rows):
                t = b.slice(i, query_rows)
                if t.num_rows:
                    yield answer(_matrix(t.column(2), width), t.column(0).to_numpy(), t.column(1).to_numpy(), _matrix(t.column(3), count), files, root, group_of)

    queries = pivoted.where(is_query)
    tasks = max(1, -(-queries.count() // query_rows))
    spread = queries.repartitionByRange(tasks, "cell", "near", "row").select("row", "vec_id", "comps", "dist")
    return spread.mapInArrow(run, RESULT)
