"""Facts: a table function over pages, document-wide de-duplication, and incremental persistence.

Nine rules give typed items with a quote each. Rules are Unicode-aware regular expressions
whose match offsets decide the quote, which built-in functions don't return, so pages pass
through Python in Arrow batches; a page's rules run only if a cheap test finds their mark.
`seq` numbers a page's facts in rule order; of facts with one key the first by (page, seq)
is kept. `first_facts` shuffles pages by document before it reads them and drops repeats as
it makes them, as pages are a tenth of their facts' rows; `first_of_key` takes facts that are
there already.
"""

from __future__ import annotations

import calendar
import json
import re
from collections.abc import Collection, Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as t

EXTRACTOR, PROVIDER, MODEL, VALIDATED = "rules-over-pages", "rules", "rules-v1", "validated"
QUOTE_CHARS, LABEL_CHARS, SENTENCE_CHARS, ENTITY_CHARS = 280, 80, 20, 80

_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in calendar.month_name[1:])
_I = re.IGNORECASE
MONEY = re.compile(r"\$\s?" + r"(?:\d\d?\d?(?:,\d\d\d)+|\d+)" + r"(?:\.\d+)?" + r"(?:\s?(?:thousand|million|billion))?", _I)
PERCENT = re.compile(r"\b(?:\d+\.)?\d+\s?(?:percent\b|%)", _I)
ISO = re.compile(r"\b20\d\d(?:-\d\d){2}\b")
LONG = re.compile(rf"\b(?:{_MONTH})\s+\d{{1,2}},\s+20\d\d\b", _I)
URL = re.compile(r"https?://[^,>)\s]+", _I)
IDENTIFIER = re.compile(r"\b(?:Resolution|Ordinance)(?:\s+(?:Number|No\.))?\s+[-A-Za-z0-9]+\b", _I)
_NAME = r"[A-Z][-'&A-Za-z]+"
ENTITY = re.compile(rf"\b{_NAME}(?:\s+(?:{_NAME}|and|of|&)){{1,5}}\b")
SENTENCE = re.compile(r"[^\n?!.]*(?:[?!.]|$)")
DEADLINE = re.compile(r"\b(?:due|deadline|no later than|must (?:be (?:completed|submitted)|begin) by|by\s+(?:" + "|".join(calendar.month_abbr[1:]) + r"))\b", _I)
ACTIONS = "accepted adopted amended approved authorized awarded denied passed postponed rejected tabled voted".split()
ACTION = re.compile(r"\b(?:" + "|".join(ACTIONS) + r")\b", _I)
#: Cheap signs, by literal text first, that a date may be there; and the two sentence rules for lower-cased text.
_ISO_SIGN, _LONG_SIGN = re.compile(r"20\d\d-\d\d-\d\d"), re.compile(r",\s+20\d\d")
_DEADLINE_LOW = re.compile(r"\b(?:due|deadline|no later than|must (?:be (?:completed|submitted)|begin) by|by\s+(?:" + "|".join(x.lower() for x in calendar.month_abbr[1:]) + r"))\b")
_ACTION_LOW = re.compile(r"\b(?:" + "|".join(ACTIONS) + r")\b")
#: Letters that match ASCII ones when case is ignored, but aren't lower-cased to them; texts that hold one skip the cheap tests.
_ODD = re.compile("[\u017f\u0130\u0131]")

#: topic: keywords in the order in which they are looked for
TOPICS = {
    line.split(": ")[0]: tuple(line.split(": ")[1].split("|"))
    for line in """budget: budget|fund|funding|appropriation
contract: contract|bid|vendor|procurement
development: development|developer|subdivision
grant: grant
housing: housing|affordable housing
infrastructure: infrastructure|road|sidewalk|bridge
ordinance: ordinance
parks: park|parks|recreation
public hearing: public hearing
resolution: resolution
sewer: sewer|wastewater|treatment plant
stormwater: stormwater|runoff|drainage
zoning: zoning|rezoning|variance""".splitlines()
}
_BY_NAME = sorted(TOPICS.items())
_WORDS_I = {k: re.compile(rf"\b{re.escape(k)}\b", _I) for keys in TOPICS.values() for k in keys}
SUFFIXES = frozenset("Agency Authority Board Bureau City Commission Committee Company Construction Corp Corporation Council County Department Inc LLC Library Mayor Office".split())
NOT_FIRST = frozenset("All Join Monday Open Page The".split())
NOT_NAMES = frozenset(["Page", "Staff Report", "City Manager", "City Manager Report", *(f"City Manager{q}s Report" for q in "'’")])
MONTHS = frozenset([*calendar.month_name[1:], *calendar.month_abbr[1:]])
CONFIDENCE = {"money": 0.95, "percentage": 0.92, "date": 0.9, "url": 0.98, "civic_identifier": 0.9, "deadline": 0.82, "action": 0.75, "topic": 0.6, "entity": 0.55}

FACT = "document_id string, page_number long, seq int, item_type string, label string, value_json string, summary string, confidence double, quote string"


def _one(s: str) -> str:
    return " ".join(s.split())


def short(s: str, size: int = QUOTE_CHARS) -> str:
    s = _one(s)
    return s if len(s) <= size else s[: size - 1].rstrip() + "…"


def quote_at(text: str, first: int, last: int) -> str:
    """From after the previous full stop or newline to the next, shortened."""
    a = max(text.rfind(c, 0, first) for c in ".\n") + 1
    ends = [i for i in (text.find(c, last) for c in ".\n") if i >= 0]
    return short(text[a : min(ends) + 1 if ends else len(text)])


def real_date(label: str) -> bool:
    if not ISO.fullmatch(label):
        return True
    try:
        return bool(date.fromisoformat(label))
    except ValueError:
        return False


def _title(word: str) -> bool:
    return word.lower() in ("and", "for", "of", "the") or (word[0].isupper() and not word.isupper())


def is_entity(label: str) -> bool:
    words, low = label.split(), label.lower()
    if not 2 <= len(words) <= 5 or len(label) > ENTITY_CHARS or label in NOT_NAMES or words[0] in NOT_FIRST:
        return False
    if words[-1].lower() in ("and", "from", "of", "with") or not MONTHS.isdisjoint(words):
        return False
    if low.startswith(("page ", "ordinance ", "resolution ")) or " report" in low or " date" in low:
        return False
    known = not SUFFIXES.isdisjoint(words)
    return known if label.isupper() else known or all(map(_title, words))


def _word_at(low: str, word: str) -> int:
    """Where a word first stands by itself, as `\\b` has it, or -1."""
    i = low.find(word)
    while i >= 0:
        end = i + len(word)
        if not (i and (low[i - 1].isalnum() or low[i - 1] == "_")) and not (end < len(low) and (low[end].isalnum() or low[end] == "_")):
            return i
        i = low.find(word, i + 1)
    return -1


def _unquoted(text: str, first: int, last: int) -> str:
    return ""


KINDS = frozenset(CONFIDENCE)
#: Kinds of which one is kept a document, not one a page and quote.
WIDE = frozenset(("entity", "topic"))


def facts_of(text: str, quotes: bool = True, kinds: Collection[str] = KINDS) -> Iterator[tuple[str, str, tuple[str, str], str, str]]:
    """(item_type, label, key and value, summary, quote) in rule order, repeats included. Without `quotes` most stay empty. Rules of other kinds don't run."""
    if not text.strip():
        return
    seen = "{} appears in document text.".format
    quote = quote_at if quotes else _unquoted
    low = text.lower()
    odd = _ODD.search(text) is not None

    def may(*marks: str) -> bool:
        """Whether any of the strings, one of which a rule's match must hold, is there in some case."""
        return odd or any(m in low for m in marks)

    rules = (
        (may("$"), "money", "amount_text", MONEY),
        (may("%", "percent"), "percentage", "percentage_text", PERCENT),
        (_ISO_SIGN.search(text), "date", "date_text", ISO),
        (_LONG_SIGN.search(text), "date", "date_text", LONG),
        (may("://"), "url", "url", URL),
        (may("ordinance", "resolution"), "civic_identifier", "identifier", IDENTIFIER),
    )
    for there, kind, key, pattern in rules:
        for m in pattern.finditer(text) if there and kind in kinds else ():
            label = _one(m[0].rstrip(".,;:"))
            if label and (kind != "date" or real_date(label)):
                yield kind, label, (key, label), seen(label), quote(text, *m.span())
    # DEADLINE sees collapsed sentences: its marks are single words, as blanks may still be irregular here.
    due, acted = "deadline" in kinds and may("due", "deadline", "later", "by"), "action" in kinds and may(*ACTIONS)
    for m in SENTENCE.finditer(text) if due or acted else ():
        s = _one(m[0])
        if len(s) < SENTENCE_CHARS:
            continue
        small = s if odd else s.lower()
        if due and (DEADLINE if odd else _DEADLINE_LOW).search(small):
            found = _ISO_SIGN.search(s) and ISO.search(s) or _LONG_SIGN.search(s) and LONG.search(s)
            label = _one(found[0]) if found else short(s, LABEL_CHARS) or "deadline"
            yield "deadline", label, ("phrase", label), "Deadline-related language appears in document text.", s
        if acted and (verb := (ACTION if odd else _ACTION_LOW).search(small)):
            yield "action", verb[0].lower(), ("verb", verb[0].lower()), "Action or vote language appears in document text.", s
    aligned = len(low) == len(text) and not odd
    for topic, words in _BY_NAME if "topic" in kinds else ():
        for word in words:
            at = _word_at(low, word)
            if at < 0:
                continue
            m = None if aligned else _WORDS_I[word].search(text)
            span = (at, at + len(word)) if aligned else m.span() if m else None
            yield "topic", topic, ("keyword", word), f"Topic candidate from keyword '{word}'.", quote(text, *span) if span else short(text)
            break
    for m in ENTITY.finditer(text) if "entity" in kinds else ():
        label = _one(m[0].strip("[]().,:;"))
        if is_entity(label):
            yield "entity", label, ("name", label), "Entity candidate from capitalized phrase.", quote(text, *m.span())


FIELDS = tuple(x.split()[0] for x in FACT.split(", "))
_TYPES = dict(zip(FIELDS, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())))
_QUOTED = json.encoder.encode_basestring


class _Firsts:
    """The first fact of each key, of pages that come in the order of document and page number.

    It holds the labels of one document's wide kinds, and what tells one page's other facts
    apart: their quotes, which are made only where a page repeats a label.
    """

    def __init__(self, quotes: bool, kinds: Collection[str]):
        self.quotes, self.kinds = quotes, kinds
        self.document, self.page = object(), object()
        self.wide: set[tuple[str, str]] = set()
        self.narrow: set[tuple[str, str, str]] | None = None
        self.texts: list[str] = []

    def of(self, document: str | None, page: int | None, text: str) -> Iterator[tuple[int, tuple]]:
        """seq and fact."""
        if document != self.document:
            self.document, self.page, self.wide = document, object(), set()
        if page != self.page:
            self.page, self.texts, self.narrow = page, [], None
        plain = not self.quotes and not self.texts
        found = list(facts_of(text, not plain, self.kinds))
        if plain:
            keys = [(f[0], f[1].casefold()) for f in found if f[0] not in WIDE]
            if len(set(keys)) < len(keys):
                plain, found = False, list(facts_of(text, True, self.kinds))
        if not plain and self.narrow is None:
            self.narrow = {(f[0], f[1].casefold(), f[4].casefold()) for x in self.texts for f in facts_of(x, True, self.kinds) if f[0] not in WIDE}
        self.texts.append(text)
        for seq, f in enumerate(found):
            if f[0] in WIDE:
                key, seen = (f[0], f[1].casefold()), self.wide
            elif plain:
                yield seq, f
                continue
            else:
                key, seen = (f[0], f[1].casefold(), f[4].casefold()), self.narrow
            if key not in seen:
                seen.add(key)
                yield seq, f


def _made(columns: Sequence[str], kinds: Collection[str], first: bool):
    """The function of Arrow batches (document_id, page_number, text) that makes the columns of their facts."""
    quotes = "quote" in columns

    def run(batches):
        firsts = _Firsts(quotes, kinds) if first else None
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                made: list[tuple] = []
                size, seq = [], []
                texts = part.column(2).to_pylist()
                for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts) if first else texts:
                    before = len(made)
                    if first:
                        for k, fact in firsts.of(row[0], row[1], row[2] or ""):
                            seq.append(k)
                            made.append(fact)
                    else:
                        made.extend(facts_of(row or "", quotes, kinds))
                        seq.extend(range(len(made) - before))
                    size.append(len(made) - before)
                page = pa.array(np.repeat(np.arange(part.num_rows), size))
                kind, labels, values, summaries, quoted = zip(*made) if made else ((),) * 5
                make = {
                    "document_id": lambda: part.column(0).take(page),
                    "page_number": lambda: part.column(1).take(page),
                    "seq": lambda: seq,
                    "item_type": lambda: kind,
                    "label": lambda: labels,
                    "value_json": lambda: [f'{{"{k}": {_QUOTED(v)}}}' for k, v in values],
                    "summary": lambda: summaries,
                    "confidence": lambda: [CONFIDENCE[k] for k in kind],
                    "quote": lambda: quoted,
                }
                arrays = [make[c]() for c in columns]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, _TYPES[c]) for c, x in zip(columns, arrays)], names=list(columns))

    return run


def _extracted(pages: DataFrame, columns: Sequence[str], kinds: Collection[str], first: bool) -> DataFrame:
    schema = ", ".join(x for x in FACT.split(", ") if x.split()[0] in columns)
    rows = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("long").alias("page_number"), "text")
    if first:
        rows = rows.repartition("document_id").sortWithinPartitions("document_id", "page_number")
    return rows.mapInArrow(_made([c for c in FIELDS if c in columns], frozenset(kinds), first), schema)


def extract(pages: DataFrame, columns: Sequence[str] = FIELDS, kinds: Collection[str] = KINDS) -> DataFrame:
    """All facts of pages (document_id, page_number, text), repeats included. Null and blank pages give none.

    Only the named columns and kinds are made: what the caller drops costs nothing. `seq`
    numbers a page's facts of these kinds.
    """
    return _extracted(pages, columns, kinds, False)


def first_facts(pages: DataFrame, columns: Sequence[str] = FIELDS, kinds: Collection[str] = KINDS) -> DataFrame:
    """`first_of_key` of all facts of pages, of the named columns and kinds.

    A document's pages are read in order by one task, so only pages are shuffled and no fact
    is compared with those of other documents.
    """
    return _extracted(pages, columns, kinds, True)


def fact_key() -> list[Column]:
    """Entities and topics are one a document; others one a page and quote. Case doesn't count."""
    wide = F.col("item_type").isin(*sorted(WIDE))
    return [F.col("item_type").alias("key_type"), t.casefold(F.col("label")).alias("key_label"), F.when(wide, F.lit(0).cast("long")).otherwise(F.col("page_number")).alias("key_page"), F.when(wide, "").otherwise(t.casefold(F.col("quote"))).alias("key_quote")]


KEY = ["document_id", "key_type", "key_label", "key_page", "key_quote"]


def first_of_key(facts: DataFrame) -> DataFrame:
    """The first fact of each key of a document, by (page_number, seq); pre-aggregated in each task."""
    columns = facts.columns
    keyed = facts.select("*", *fact_key())
    return keyed.groupBy(*KEY).agg(F.min_by(F.struct(*columns), F.struct(F.col("page_number"), F.col("seq"))).alias("_row")).select("_row.*")


#: What tells facts apart in joins: the key's text as half of its SHA-256, so that no quotes are shuffled.
SHORT_KEY = ["document_id", "key_type", "key_digest"]


def _short_key() -> list[Column]:
    kind, label, page, quote = fact_key()
    text = F.concat(F.length(label).cast("string"), F.lit(":"), label, F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), quote)
    return [kind, F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key_digest")]


def new_facts(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """Facts whose key `existing` (the same columns) lacks. Neither side is broadcast, as `persist_counts` says."""
    keys = existing.select("document_id", *_short_key()).distinct()
    return facts.select("*", *_short_key()).join(keys.hint("merge"), SHORT_KEY, "left_anti").select(*facts.columns)


def persist_counts(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """document_id, extracted, created, skipped of an incremental run.

    The keys of both are shuffled and counted together, without a join: the optimizer would
    take their sizes from the files behind the pages, and might send them to the driver.
    """
    keys = facts.select("document_id", *_short_key(), F.lit(1).alias("_new"), F.lit(0).alias("_old"))
    old = existing.select("document_id", *_short_key(), F.lit(0).alias("_new"), F.lit(1).alias("_old"))
    each = keys.unionByName(old).groupBy(*SHORT_KEY).agg(F.sum("_new").alias("_new"), F.max("_old").alias("_old")).where("_new > 0")
    skipped = F.coalesce(F.sum(F.when(F.col("_old") > 0, F.col("_new"))), F.lit(0))
    counted = each.groupBy("document_id").agg(F.sum("_new").alias("extracted"), skipped.alias("skipped"))
    return counted.select("document_id", "extracted", (F.col("extracted") - F.col("skipped")).alias("created"), "skipped")


def items_of(facts: DataFrame, created_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, evidence) of first facts; ids are made from the key, so that a repeated run makes the same."""
    key = F.concat_ws("|", "document_id", *fact_key())
    item = F.concat(F.lit("item-"), F.substring(F.sha2(key, 256), 1, 16))
    now = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    items = facts.select(item.alias("item_id"), "document_id", "item_type", "label", "value_json", "summary", "confidence", F.lit(EXTRACTOR).alias("extractor"), F.lit(PROVIDER).alias("provider"), F.lit(MODEL).alias("model"), now.alias("created_at"))
    evidence = facts.select(F.concat(item, F.lit("-1")).alias("evidence_id"), item.alias("item_id"), "document_id", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "quote", F.lit(VALIDATED).alias("validation_status"))
    return items, evidence
