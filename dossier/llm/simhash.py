"""SimHash near-duplicates: fingerprints, BK-trees over sharded fingerprints, components.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, 4-word shingles joined by a
space (a shorter text is one shingle, no word gives fingerprint zero), XXH64 of each with
seed 42; a bit is 1 if set in over half of the hashes, repeats counted.

Documents of one fingerprint form one class, so a group of copies is one row from there
on, whatever its size. Two fingerprints within 4 bits agree on at least two of six bit
blocks (11, 11, 11, 11, 10, 10 bits), so each class goes to fifteen shards, one for each
pair of blocks and their bits. A shard's fingerprints form a BK-tree: a child hangs on its
parent by their integer Hamming distance d, and a search within radius r follows only the
edges from d - r to d + r of each node it meets. Trees of all shards of a partition are
built and searched level by level in numpy. A pair is counted in the first shard that has
both. A shard of over SHARD_SIZE classes is cut into pieces, and each two pieces (a piece
with itself too) are one unit of work: the tree of one, searched for the other's classes.

A partition returns, per class, the number of documents it links to, and a spanning forest
of its links, never the pairs. Components come from alternating large-star and small-star
rounds on those forests, written to the shared folder between rounds.

Defined cases: null and empty texts have fingerprint zero and link with each other like
any other; extra columns are ignored. A very long text is hashed whole, a piece of its
shingles at a time. Rows with a repeated doc_id each count and are returned, each by its own
text; of rows of one doc_id `distinct_documents` keeps one, the smallest text first. Ties
don't arise: a link is a distance, a component's name its smallest doc_id. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textbatch as tb
from dossier.llm.shared import discard, spread_join, written

RADIUS = 4
SHINGLE = 4
SEED = 42
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
PAIRS = [(a, b) for a in range(6) for b in range(a + 1, 6)]
SHARD_SIZE = 4096
_HASHES_AT_ONCE = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprints(t: tb.Texts) -> np.ndarray:
    """uint64 fingerprint of each text of a block."""
    w = tb.words(t)
    n = np.diff(w.off)
    # All words, one separator after each: a shingle is then one slice.
    size = w.end - w.start
    start = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=start[1:])
    joined = np.full(start[-1], 32, np.uint8)
    if len(size):
        inside = np.ones(start[-1], bool)
        inside[start[1:] - 1] = False
        covered = ~tb.SEPARATOR[t.data]
        joined[inside] = LOWER[t.data[covered]]
    raw = joined.tobytes()
    per = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=off[1:])
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((len(n), 64), np.int64)
    for at in range(0, int(off[-1]), _HASHES_AT_ONCE):
        k = np.arange(at, min(at + _HASHES_AT_ONCE, int(off[-1])))
        text = np.searchsorted(off, k, side="right") - 1
        first = k - off[text] + w.off[text]
        last = np.minimum(first + SHINGLE, w.off[text + 1])
        h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(start[first].tolist(), (start[last] - 1).tolist())), np.uint64, len(k))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.clip(off, at, at + len(k)) - at
        votes += tb.sum_by(bits.astype(np.int32), cut)
    ones = 2 * votes > per[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def with_fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch, t in tb.blocks(batches, "text"):
            yield tb.output(batch, ["doc_id"], {"fp": fingerprints(t).view(np.int64)})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_values(fp: np.ndarray) -> np.ndarray:
    """The six block values of each uint64."""
    out, at = np.empty((len(fp), 6), np.uint64), 0
    for i, bits in enumerate(BLOCK_BITS):
        out[:, i] = (fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)
        at += bits
    return out


def _blocks_sql() -> list[str]:
    out, at = [], 0
    for bits in BLOCK_BITS:
        out.append(f"(shiftrightunsigned(fp, {at}) & {(1 << bits) - 1})")
        at += bits
    return out


def shard_keys() -> str:
    """SQL: the fifteen shard keys of fp as array<long>; each holds the number of its pair of blocks."""
    b = _blocks_sql()
    return "array(" + ", ".join(f"({k}L << 32) | ({b[x]} << 11) | {b[y]}" for k, (x, y) in enumerate(PAIRS)) + ")"


def first_shared(x: np.ndarray) -> np.ndarray:
    """Number of the first pair of blocks in which two fingerprints agree, from their XOR."""
    v = block_values(x) == 0
    out = np.full(len(x), -1, np.int64)
    for k in range(len(PAIRS) - 1, -1, -1):
        out[v[:, PAIRS[k][0]] & v[:, PAIRS[k][1]]] = k
    return out


class Forest:
    """BK-trees, one a tree number, over fingerprints, in arrays.

    order: the nodes, by parent and edge; at, to: each node's children within order;
    edge: distance of each ordered node to its parent.
    """

    def __init__(self, fp: np.ndarray, tree: np.ndarray):
        n = len(fp)
        self.fp = fp
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        by_tree = np.argsort(tree, kind="stable")
        first = np.flatnonzero(np.r_[True, tree[by_tree][1:] != tree[by_tree][:-1]]) if n else np.zeros(0, np.int64)
        self.root_tree, self.root = tree[by_tree[first]], by_tree[first]
        rest = np.ones(n, bool)
        rest[self.root] = False
        below = np.flatnonzero(rest)
        under = self.root[np.searchsorted(self.root_tree, tree[below])] if n else below
        while len(below):
            d = np.bitwise_count(fp[below] ^ fp[under]).astype(np.int64)
            key = under * 65 + d
            order = np.argsort(key, kind="stable")
            k = key[order]
            head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            child = below[order[head]]
            parent[child], edge[child] = under[order[head]], d[order[head]]
            group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
            left = np.ones(len(below), bool)
            left[head] = False
            under, below = child[group[left]], below[order[left]]
        self.order = np.lexsort((edge, parent))
        self.key = parent[self.order] * 65 + edge[self.order]

    def search(self, query: np.ndarray, tree: np.ndarray, radius: int = RADIUS, at_once: int = 1 << 20):
        """Yields (query number, node, distance) arrays of all hits; a query of a tree that isn't there finds none."""
        at = np.searchsorted(self.root_tree, tree)
        ok = at < len(self.root_tree)
        ok[ok] = self.root_tree[at[ok]] == tree[ok]
        stack = [(np.flatnonzero(ok), self.root[at[ok]])]
        while stack:
            q, node = stack.pop()
            if len(q) > at_once:
                stack += [(q[i : i + at_once], node[i : i + at_once]) for i in range(0, len(q), at_once)]
                continue
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit], d[hit]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            go = np.flatnonzero(n)
            if len(go):
                n = n[go]
                ends = np.cumsum(n)
                pos = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo[go], n)
                stack.append((np.repeat(q[go], n), self.order[pos]))


class Union:
    """Union-find on whole arrays; every root is the smallest of its set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def _link(table: pa.Table) -> tuple[dict, dict]:
    """Counts and forest of the links within a partition's units. Columns: key, lo, hi, own, fp, cnt."""
    key, lo, hi, own, fp, cnt = (table[c].to_numpy().astype(np.int64) for c in ("key", "lo", "hi", "own", "fp", "cnt"))
    fp = fp.view(np.uint64)
    unit = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    nodes, asks = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    forest = Forest(fp[nodes], unit[nodes])
    ids, of = np.unique(fp, return_inverse=True)
    union, near = Union(len(ids)), np.zeros(len(ids), np.int64)
    for q, node, d in forest.search(fp[asks], unit[asks]):
        q, node = asks[q], nodes[node]
        keep = (d > 0) & (first_shared(fp[q] ^ fp[node]) == key[q] >> 32)
        q, node = q[keep], node[keep]
        near += np.bincount(of[q], cnt[node], len(ids)).astype(np.int64)
        two = lo[q] != hi[q]  # within one piece the search finds each link from both ends
        near += np.bincount(of[node[two]], cnt[q[two]], len(ids)).astype(np.int64)
        union.join(of[q], of[node])
    root = union.roots()
    linked = np.flatnonzero(root != np.arange(len(ids)))
    some = np.flatnonzero(near)
    return {"fp": ids[some].view(np.int64), "near": near[some]}, {"a": ids[linked].view(np.int64), "b": ids[root[linked]].view(np.int64)}


def links(classes: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """From classes (fp, cnt): rows (kind 'near': a = fp, n = documents linked) and (kind 'edge': a, b).

    Only shards of two or more classes go to Python, those over `shard_size` in pieces.
    """
    keyed = classes.select(F.explode(F.expr(shard_keys())).alias("key"), "fp", "cnt")
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shards")
    shards = spread_join(keyed, sizes, "key", "size", len(PAIRS) * classes.count())
    pieces = F.ceil(F.col("size") / shard_size).cast("int")
    cut = shards.select("key", "fp", "cnt", pieces.alias("pieces"), F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("own"))
    cut = cut.select("key", "fp", "cnt", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    placed = cut.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp", "cnt")

    def flush(part):
        near, edge = _link(part)
        for kind, x, y, n in (("near", near["fp"], np.zeros(len(near["fp"]), np.int64), near["near"]), ("edge", edge["a"], edge["b"], np.zeros(len(edge["a"]), np.int64))):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(x)), pa.array(x), pa.array(y), pa.array(n)], names=["kind", "a", "b", "n"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:  # sorted by unit: work is done up to the last unit that is complete
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 18:
                t = pa.Table.from_batches(held).combine_chunks()
                before = np.zeros(len(t), bool)
                for c in ("key", "lo", "hi"):
                    v = t[c].to_numpy()
                    before |= v != v[-1]
                done = int(np.flatnonzero(before)[-1]) + 1 if before.any() else 0
                if done:
                    yield from flush(t.slice(0, done).combine_chunks())
                held, rows = t.slice(done).to_batches(), len(t) - done
        if rows:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    spread = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return spread.mapInArrow(run, "kind string, a long, b long, n long")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (smallest node of its component) for each node of the edges (a, b).

    Alternating large-star and small-star until nothing changes; every round is written to the
    shared folder. A round's neighbours are never gathered in a task: minima are aggregates,
    joined back, and the edges of a hub are spread over tasks.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    now = _checksum(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        large = written(spread_join(both, low, "u", "n", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        near = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        small = spread_join(large, near, "u", "n", 2 * now[0])
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        after = small.select(pairs.alias("_e")).select("_e.u", "_e.v").where("u <> v").distinct()
        last, edges = edges, written(after, name)
        for used in (last, low, large, near):
            discard(used)
        before, now = now, _checksum(edges)
        if now == before:
            break
    tree = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def classes_of(prints: DataFrame) -> DataFrame:
    return prints.groupBy("fp").agg(F.count(F.lit(1)).alias("cnt"), F.min("doc_id").alias("low"))


def labelled(documents: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """doc_id, fingerprint (hex), n_near, component_id for every row."""
    prints = written(with_fingerprint(documents), "fingerprints")
    classes = written(classes_of(prints), "classes")
    found = written(links(classes.select("fp", "cnt"), shard_size), "links")
    near = found.where("kind = 'near'").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n"))
    comp = components(found.where("kind = 'edge'").select("a", "b"))
    with_comp = written(classes.join(comp, classes.fp == comp.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node"), "classes")
    lowest = with_comp.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size"))
    placed = spread_join(with_comp, lowest, "root", "size", with_comp.count())
    info = written(placed.join(near, "fp", "left").select("fp", "cnt", (F.col("cnt") - 1 + F.coalesce("n", F.lit(0))).alias("n_near"), "component_id"), "classes")
    whole = spread_join(prints, info, "fp", "cnt", prints.count())
    return whole.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def distinct_documents(documents: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """The documents, all columns, whose doc_id is the smallest of its component; of rows of one doc_id, one. Rows without a doc_id all stay."""
    named = documents.where("doc_id is not null")
    kept = labelled(named, shard_size).where("doc_id = component_id").select("doc_id").distinct()
    names = documents.columns
    rows = F.struct(*names)
    one = named.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(rows, F.struct("text", F.to_json(rows))).alias("_row"))
    return one.select("_row.*").unionByName(documents.where("doc_id is null"))
