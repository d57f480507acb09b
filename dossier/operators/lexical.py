"""Keyword search: a query mini-language, and BM25 over token arrays or a stored index.

Scores follow the usual full-text form, lower is better: for each phrase of the query,
idf = ln((N - n + 0.5) / (n + 0.5)), floored to 1e-6, and
score = -sum(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))). N, n and avgdl are
over all passages, whatever filters follow.

`search` needs no shuffle of tokens: tokens stay in their row, a pass aggregates one row of
statistics, and the best rows are taken by a distributed top-k. `build_index` stores
postings with positions and the corpus's statistics for repeated queries of the whole
language; `search_index` then reads only the buckets of the query's terms, and all buckets'
matching row groups for a prefix.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as t
from dossier.functions.porter import stem

K1, B, FLOOR = 1.2, 0.75, 1e-6
BUCKETS = 64


class QueryError(ValueError):
    """The query text isn't valid."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple = field(default=())


_LEX = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<mark>[()*^+:,{}])|(?P<minus>-)|(?P<word>[A-Za-z0-9_\u0080-\U0010ffff\x1a]+))')


class _Parser:
    """AND binds tighter than OR, NOT tighter than AND; words side by side are joined by AND."""

    def __init__(self, text: str, columns: tuple[str, ...], stemmed: bool):
        self.columns, self.stemmed = columns, stemmed
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QueryError(f"syntax error near {text[at:at + 1]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def need(self, mark: str) -> None:
        if self.take() != ("mark", mark):
            raise QueryError(f"expected {mark!r}")

    def parse(self):
        if not self.items:
            raise QueryError("the query is empty")
        tree = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"syntax error near {self.peek()[1]!r}")
        return tree

    def _chain(self, kind: str, below):
        parts = [below()]
        while self.peek() == ("word", kind.upper()):
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def either(self):
        return self._chain("or", self.both)

    def both(self):
        return self._chain("and", self.without)

    def without(self):
        left = self.implicit()
        while self.peek() == ("word", "NOT"):
            self.take()
            left = Op("not", (left, self.implicit()))
        return left

    def starts(self) -> bool:
        kind, value = self.peek()
        return kind == "str" or (kind == "word" and value not in ("AND", "OR", "NOT")) or (kind, value) in (("mark", "("), ("mark", "^"), ("mark", "{"), ("minus", "-"))

    def implicit(self):
        alone = self.peek() == ("mark", "(")  # brackets take no neighbours without an operator
        parts = [self.unit()]
        while not alone and self.starts() and self.peek() != ("mark", "("):
            parts.append(self.unit())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def unit(self):
        kind, value = self.peek()
        if (kind, value) == ("mark", "("):
            self.take()
            tree = self.either()
            self.need(")")
            return tree
        if kind == "minus" or (kind, value) == ("mark", "{") or self.peek(1) == ("mark", ":"):
            return self.column()
        if kind == "word" and value.upper() == "NEAR" and self.peek(1) == ("mark", "("):
            return self.near()
        return self.phrase()

    def column(self):
        exclude = self.peek()[0] == "minus"
        if exclude:
            self.take()
        names = []
        if self.peek() == ("mark", "{"):
            self.take()
            while self.peek()[0] in ("word", "str"):
                names.append(self.take()[1].strip('"'))
            self.need("}")
        else:
            kind, value = self.take()
            if kind not in ("word", "str"):
                raise QueryError("a column name is missing")
            names.append(value.strip('"'))
        self.need(":")
        for n in names:
            if n.lower() not in self.columns:
                raise QueryError(f"no such column: {n}")
        inner = self.unit()
        # One indexed column: naming it changes nothing, excluding it leaves nothing.
        return Op("none", (inner,)) if exclude else inner

    def near(self):
        self.take()
        self.need("(")
        phrases, distance = [], 10
        while self.peek() not in (("mark", ")"), ("mark", ",")):
            phrases.append(self.phrase())
        if self.peek() == ("mark", ","):
            self.take()
            value = self.take()[1]
            if not value.isdigit():
                raise QueryError(f"expected a number, not {value!r}")
            distance = int(value)
        self.need(")")
        return phrases[0] if len(phrases) == 1 else Near(tuple(phrases), distance)

    def phrase(self) -> Phrase:
        first = self.peek() == ("mark", "^")
        if first:
            self.take()
        terms: list[str] = []
        while True:
            kind, value = self.take()
            if kind not in ("word", "str") or (kind == "word" and value in ("AND", "OR", "NOT")):
                raise QueryError(f"syntax error near {value!r}")
            terms += query_terms(value[1:-1].replace('""', '"') if kind == "str" else value, self.stemmed)
            if self.peek() != ("mark", "+"):
                break
            self.take()
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(tuple(terms), prefix, first)


_TERM = re.compile(r"[^\W_]+")


def query_terms(text: str, stemmed: bool) -> list[str]:
    found = _TERM.findall(t.fold_text(text))
    return [stem(x) for x in found] if stemmed else found


def parse(query: str, stemmed: bool = False, columns: tuple[str, ...] = ("text",)):
    """The query's tree; QueryError if it isn't valid."""
    return _Parser(query, columns, stemmed).parse()


def phrases_of(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree] if tree.terms else []
    if isinstance(tree, Near):
        return [p for x in tree.phrases for p in phrases_of(x)]
    return [p for x in tree.parts for p in phrases_of(x)]


@lru_cache(maxsize=20_000)
def _stem(word: str) -> str:
    return stem(word)


def stems(tokens: pa.ListArray) -> pa.ListArray:
    """Porter stems of token arrays. Only the different words of the batch become Python objects, so a worker holds little more than the batch."""
    words = tokens.flatten().dictionary_encode()
    made = pa.array([_stem(x) for x in words.dictionary.to_pylist()], words.dictionary.type)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    starts = pa.array(np.concatenate([np.zeros(1, np.int32), ends]), pa.int32(), mask=np.append(tokens.is_null().to_numpy(zero_copy_only=False), False) if tokens.null_count else None)
    return pa.ListArray.from_arrays(starts, made.take(words.indices))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(tokens: pa.Array) -> pa.Array:
    """Porter stems of token arrays."""
    return stems(tokens)


def positions(tokens: Column, p: Phrase) -> Column:
    """Places (from 0) at which a phrase starts, as an array."""
    if not p.terms:
        return F.array().cast("array<int>")
    k = len(p.terms)

    def fits(i: Column) -> Column:
        tests = []
        for j, term in enumerate(p.terms):
            x = F.get(tokens, i + j)
            tests.append(x.startswith(term) if p.prefix and j == k - 1 else x == term)
        return reduce(lambda a, b: a & b, tests)

    places = F.when(F.size(tokens) >= k, F.sequence(F.lit(0), F.size(tokens) - k)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: fits(i) & (i == 0)) if p.first else F.filter(places, fits)
    return found


def _count(tokens: Column, p: Phrase) -> Column:
    if len(p.terms) == 1 and not p.first:
        term = p.terms[0]
        return F.size(F.filter(tokens, lambda x: x.startswith(term) if p.prefix else x == term))
    return F.size(positions(tokens, p))


def _near(at: Callable[[Phrase], Column], n: Near) -> Column:
    """Whether occurrences of all phrases lie within `distance` tokens of each other, between the first's end and the last's start."""
    lists = [(at(p), len(p.terms)) for p in n.phrases if p.terms]
    if len(lists) < 2:
        return F.size(lists[0][0]) > 0 if lists else F.lit(False)

    def extend(k: int, lo: Column, hi: Column) -> Column:
        # lo: end of the earliest phrase end, hi: latest start; all phrases must fit a span whose inner gap is at most the distance
        places, size = lists[k]

        def ok(i: Column) -> Column:
            new_lo, new_hi = F.least(lo, i + size), F.greatest(hi, i)
            inside = new_hi - new_lo <= n.distance
            return inside & (extend(k + 1, new_lo, new_hi) if k + 1 < len(lists) else F.lit(True))

        return F.exists(places, ok)

    first, size = lists[0]
    return F.exists(first, lambda i: extend(1, i + size, i))


def matches(tree, at: Callable[[Phrase], Column], count: Callable[[Phrase], Column]) -> Column:
    """Whether a passage fits the query; at: places of a phrase in it, count: how many."""
    if isinstance(tree, Phrase):
        return count(tree) > 0 if tree.terms else F.lit(True)
    if isinstance(tree, Near):
        return _near(at, tree)
    parts = [matches(p, at, count) for p in tree.parts]
    if tree.kind == "and":
        return reduce(lambda a, b: a & b, parts)
    if tree.kind == "or":
        return reduce(lambda a, b: a | b, parts)
    if tree.kind == "not":
        return parts[0] & ~parts[1]
    return F.lit(False)


def _score(tf: list[Column], dl: Column, n: Column, total: Column, avg: Column) -> Column:
    out = F.lit(0.0)
    for k, f in enumerate(tf):
        df = F.get(n, F.lit(k)).cast("double")
        idf = F.log((total - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(FLOOR)
        out = out + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avg))
    return -out


def search(passages: DataFrame, query: str, limit: int = 20, stemmed: bool = False, id_column: str = "passage_id") -> DataFrame:
    """`id_column` and keyword_score of the best `limit` matches, ties to the smaller id.

    One pass gathers statistics (a single row), another scores; a null text matches nothing.
    """
    tree = parse(query, stemmed)
    phrases = phrases_of(tree)
    if not phrases:
        return passages.select(id_column, F.lit(0.0).alias("keyword_score")).limit(0)
    toks = t.tokens(F.col("text"))
    # Bound once a row as a lambda's variable: the optimizer can't copy the tokenizer into each use, as a pushed filter would.
    measure = lambda x: F.struct(F.array(*(_count(x, p) for p in phrases)).alias("tf"), F.size(x).alias("dl"), matches(tree, lambda p: positions(x, p), lambda p: _count(x, p)).alias("hit"))
    if stemmed:
        toks = stemmed_tokens(toks)
    counted = passages.select(id_column, F.get(F.transform(F.array(toks), measure), F.lit(0)).alias("_m")).select(id_column, F.col("_m.tf").alias("_tf"), F.col("_m.dl").alias("_dl"), F.col("_m.hit").alias("_hit"))
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("_total"), F.avg("_dl").alias("_avg"), _having(len(phrases)))
    return _best(counted, stats, len(phrases), limit, id_column)


def _having(n: int) -> Column:
    """In how many passages each phrase occurs."""
    return F.array(*(F.coalesce(F.sum((F.get("_tf", F.lit(k)) > 0).cast("long")), F.lit(0)) for k in range(n))).alias("_n")


def _best(counted: DataFrame, stats: DataFrame, n: int, limit: int, id_column: str) -> DataFrame:
    hits = counted.where("_hit").crossJoin(F.broadcast(stats))  # one row of statistics
    tf = [F.get("_tf", F.lit(k)).cast("double") for k in range(n)]
    scored = hits.select(id_column, _score(tf, F.col("_dl"), F.col("_n"), F.col("_total"), F.col("_avg")).alias("keyword_score"))
    return scored.orderBy("keyword_score", id_column).limit(limit)


def postings(passages: DataFrame, stemmed: bool = False, id_column: str = "passage_id") -> DataFrame:
    """`id_column`, term, tf, positions: one row a passage and term, made within the row by sorting its own tokens."""
    toks = t.tokens(F.col("text"))
    placed = F.sort_array(F.transform(stemmed_tokens(toks) if stemmed else toks, lambda x, i: F.struct(x.alias("term"), i.alias("at"))))
    one = lambda x, a, n: F.struct(F.get(x, a)["term"].alias("term"), n.cast("long").alias("tf"), F.transform(F.slice(x, a + 1, n), lambda p: p["at"]).alias("positions"))
    return passages.select(id_column, F.inline(_runs(placed, lambda x: x["term"], one)))


def _runs(values: Column, key: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(array, start, length) of each run of equal keys of a sorted array, which is bound once a row."""

    def cut(x: Column) -> Column:
        n = F.size(x)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (key(F.get(x, i)) != key(F.get(x, i - 1))))
        pairs = F.zip_with(starts, F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(F.filter(pairs, lambda p: p["a"].isNotNull()), lambda p: make(x, p["a"], p["b"] - p["a"]))

    return F.flatten(F.transform(F.array(values), cut))


def term_counts(passages: DataFrame, stemmed: bool = False) -> DataFrame:
    """term, df (passages that have it), cf (occurrences): a passage's terms are counted in its row, and rows of terms combine within tasks."""
    toks = t.tokens(F.col("text"))
    ordered = F.sort_array(stemmed_tokens(toks) if stemmed else toks)
    # Each token beside the one before it in order, so that a passage's first of each counts for df.
    beside = F.transform(F.array(ordered), lambda x: F.arrays_zip(x.alias("term"), F.concat(F.array(F.lit("")), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))).alias("before")))
    rows = passages.select(F.inline(F.get(beside, F.lit(0))).alias("term", "before")).where("term is not null")
    return rows.groupBy("term").agg(F.count_if(F.col("term") != F.col("before")).alias("df"), F.count(F.lit(1)).alias("cf"))


def lengths(passages: DataFrame, id_column: str = "passage_id") -> DataFrame:
    return passages.select(id_column, F.size(t.tokens(F.col("text"))).alias("dl"))


def term_stats(posts: DataFrame) -> DataFrame:
    """term, df (passages that have it), cf (occurrences)."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Index:
    """Stored postings in buckets by term, lengths, and the two corpus numbers."""

    path: str
    stemmed: bool
    id_column: str

    def table(self, spark, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def build_index(passages: DataFrame, path: str, stemmed: bool = False, id_column: str = "passage_id") -> Index:
    """Each bucket is split by passage, so that a frequent term's postings don't meet in one task."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    posts = postings(passages, stemmed, id_column).withColumn("bucket", bucket)
    posts.repartition("bucket", F.pmod(F.xxhash64(id_column), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths(passages, id_column).write.mode("overwrite").parquet(f"{path}/lengths")
    spark = passages.sparkSession
    spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).cast("double").alias("_total"), F.avg("dl").alias("_avg")).write.mode("overwrite").parquet(f"{path}/corpus")
    return Index(path, stemmed, id_column)


def search_index(spark, index: Index, query: str, limit: int = 20) -> DataFrame:
    """As `search`, for the whole language, from the stored postings of the query's terms."""
    tree = parse(query, index.stemmed)
    phrases, key = phrases_of(tree), index.id_column
    if not phrases:
        return index.table(spark, "lengths").select(key, F.lit(0.0).alias("keyword_score")).limit(0)
    wanted = sorted({(x, p.prefix and j == len(p.terms) - 1) for p in phrases for j, x in enumerate(p.terms)})
    number = {w: k for k, w in enumerate(wanted)}
    fits = [F.col("term").startswith(x) if prefix else F.col("term") == x for x, prefix in wanted]
    posts = index.table(spark, "postings").where(reduce(lambda a, b: a | b, fits))
    if not any(prefix for _, prefix in wanted):
        rows = spark.createDataFrame([(x,) for x, _ in wanted], "term string")
        posts = posts.where(F.col("bucket").isin([r[0] for r in rows.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]))
    none = F.array().cast("array<int>")
    lists = posts.groupBy(key).agg(*(F.array_sort(F.flatten(F.collect_list(F.when(f, F.col("positions"))))).alias(f"_w{k}") for k, f in enumerate(fits)))

    def at(p: Phrase) -> Column:
        of = [F.col(f"_w{number[x, p.prefix and j == len(p.terms) - 1]}") for j, x in enumerate(p.terms)]
        return F.filter(of[0], lambda i: reduce(lambda a, b: a & b, [F.array_contains(x, i + j) for j, x in enumerate(of) if j] + ([i == 0] if p.first else []), F.lit(True)))

    every = any(not p.terms for p in _leaves(tree))  # a phrase without a term fits every passage
    whole = index.table(spark, "lengths").join(lists, key, "left" if every else "inner")
    whole = whole.select(key, "dl", *(F.coalesce(f"_w{k}", none).alias(f"_w{k}") for k in range(len(wanted))))
    count = lambda p: F.size(at(p))
    counted = whole.select(key, F.array(*(count(p) for p in phrases)).alias("_tf"), F.col("dl").alias("_dl"), matches(tree, at, count).alias("_hit"))
    stats = counted.agg(_having(len(phrases))).crossJoin(F.broadcast(index.table(spark, "corpus")))  # one row each
    return _best(counted, stats, len(phrases), limit, key)


def _leaves(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    return [p for x in (tree.phrases if isinstance(tree, Near) else tree.parts) for p in _leaves(x)]
