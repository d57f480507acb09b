"""URL filters: host and path rules, then a listed-URL check by Bloom filter and exact join.

A url's host runs from after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased;
its path from there to `?`, `#` or the end. The longest rule that fits decides. Other urls
are blocked if their canonical form is listed: a blocked Bloom filter (one 512-bit block a
key, eight bits in it) of the listed URLs, at most `max_bits` large whatever the list's
length, passes possible hits to an exact hash join, which removes false positives. A list
too long for the filter's size only passes more rows to the join. Urls are parsed and probed
once; hits are counted by url before they are joined, so that a much repeated one is spread.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule,
isn't listed, and is allowed. Repeated pages each give a row; a url listed twice blocks
once. Null entries of the list don't count. With an empty list nothing is blocked but by
rule. Of rules of one length the first by text wins, if both fit. A very long url is parsed
whole. Only page_id and url are read, so other columns may have any names. An empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import spread_join, written

#: (host suffix and path prefix, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")
BLOCK_WORDS = 8  # 64-bit words of a block
MAX_BITS = 1 << 27  # 16 MB: the filter's proven bound

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without leading www., m. or a port; path without index page or final slash; query without tracking fields. Null if there is no host."""
    rest = _rest(url)
    h = F.regexp_replace(F.regexp_replace(host(url), r":\d+\z", ""), r"\A(www|m)\.", "")
    p = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?\z", "/"), r"/+\z", "")
    query = F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"\A(" + "|".join(TRACKING) + r")(=|\z)"))), "&")
    return F.when(h != "", F.concat(h, p, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (none, none)


def _positions(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash and its mask of eight words, one bit a word."""
    u = h.view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    low = (u & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    bit = (low[:, None] >> (np.uint64(6) * np.arange(BLOCK_WORDS, dtype=np.uint64))) & np.uint64(63)
    return block.astype(np.int64), np.uint64(1) << bit


def build_bloom(listed: DataFrame, key: str, bits_per_key: int = 12, max_bits: int = MAX_BITS) -> np.ndarray:
    """Blocks of the filter. Tasks send their own set bits, merged on executors, never the keys."""
    n = listed.count()
    size = min(max(n, 1) * bits_per_key, max_bits)
    n_blocks = max(1, math.ceil(size / (64 * BLOCK_WORDS)))
    merge = max(1, min(64, n_blocks // 1024))

    def partial(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            block, mask = _positions(b.column(0).to_numpy(zero_copy_only=False), n_blocks)
            order = np.argsort(block, kind="stable")
            block, mask = block[order], mask[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
            if len(first):
                for k, m in zip(block[first].tolist(), np.bitwise_or.reduceat(mask, first, axis=0)):
                    own[k] = own[k] | m if k in own else m
        if own:
            keys = np.fromiter(own, np.int64)
            words = np.stack([own[k] for k in keys.tolist()]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(words[:, i].copy()) for i in range(BLOCK_WORDS))], names=["block", *names])

    names = [f"w{i}" for i in range(BLOCK_WORDS)]
    schema = "block long, " + ", ".join(f"{w} long" for w in names)
    hashes = listed.select(F.xxhash64(key).alias("h"))
    merged = hashes.mapInArrow(partial, schema).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in names)).coalesce(merge)
    blocks = np.zeros((n_blocks, BLOCK_WORDS), np.int64)
    for b in merged.toArrow().to_batches():  # at most max_bits
        at = b.column(0).to_numpy()
        for i in range(BLOCK_WORDS):
            blocks[at, i] = b.column(i + 1).to_numpy()
    return blocks.view(np.uint64)


def maybe(blocks: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, mask = _positions(h, len(blocks))
    return ((blocks[block] & mask) == mask).all(axis=1)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, maybe_listed, listed. `listed` has one column url of canonical URLs."""
    spark = pages.sparkSession
    listed = written(listed.select(F.col("url").alias("canonical")).where("canonical is not null").distinct(), "listed")
    filled = spark.sparkContext.broadcast(build_bloom(listed, "canonical", max_bits=max_bits))  # at most max_bits

    @F.pandas_udf("boolean")
    def probe(h):
        import pandas as pd

        return pd.Series(maybe(filled.value, h.to_numpy(np.int64)))

    base = pages.select(F.col("page_id"), "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    base = written(base.withColumn("maybe_listed", F.col("canonical").isNotNull() & probe(F.xxhash64("canonical"))).drop("url"), "urls")
    hits = base.where("maybe_listed")
    counts = hits.groupBy("canonical").agg(F.count(F.lit(1)).alias("_n"))
    marked = written(counts.join(listed.withColumn("_listed", F.lit(True)), "canonical", "left"), "hits")
    total = int(marked.agg(F.sum("_n")).first()[0] or 0)
    out = spread_join(hits, marked, "canonical", "_n", total).select(*base.columns, F.coalesce("_listed", F.lit(False)).alias("listed"))
    out = out.unionByName(base.where("not maybe_listed").withColumn("listed", F.lit(False)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "maybe_listed", "listed")


def with_mirrors(pages: DataFrame, bad: Column, least_bytes: int = 100) -> DataFrame:
    """One column url: canonical URLs of the pages that `bad` marks, and of all pages with the html of one of them, if that has `least_bytes`."""
    url = F.col("url")
    body = F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256))
    rows = written(pages.select(canonical(url).alias("url"), F.coalesce(bad, F.lit(False)).alias("bad"), body.alias("digest")).where("url is not null"), "bodies")
    copies = rows.where("digest is not null").groupBy("digest").agg(F.max("bad").alias("_bad"), F.count(F.lit(1)).alias("_n")).where("_bad and _n > 1")
    copies = written(copies, "mirrors")
    total = int(copies.agg(F.sum("_n")).first()[0] or 0)
    return rows.where("bad").select("url").unionByName(spread_join(rows, copies, "digest", "_n", total).select("url")).distinct()
