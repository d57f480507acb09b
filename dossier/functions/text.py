"""Text helpers as Column expressions, with Python's ideas of white space, lines and case."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it; Java's (?U)\s lacks U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Line ends of str.splitlines().
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The same sets for RE2, as DuckDB takes them.
RE2_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RE2_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, as an embedded SQL store's lower() does."""
    return F.translate(c, _UPPER, _LOWER)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def optional(c: Column) -> Column:
    """Null if empty or white space only, else stripped."""
    return F.nullif(strip(c), F.lit(""))


def lines(c: Column) -> Column:
    """Lines, each with white space collapsed."""
    return F.transform(F.split(c, LINE_END), collapse)


def _folds() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and those letters."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x2000)]:
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(c) == 1 and len(base) == 1 and base != c:
            src.append(c)
            dst.append(base)
    seen = dict(zip(src, dst))
    return "".join(seen), "".join(seen.values())


_MARKED, _PLAIN = _folds()
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def folded(c: Column) -> Column:
    """Lower case without diacritics; letters without a decomposition, such as ß and œ, stay."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), r"\p{Mn}", "")


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded. Null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def fold_text(text: str) -> str:
    low = unicodedata.normalize("NFD", text.lower())
    return unicodedata.normalize("NFC", "".join(x for x in low if unicodedata.category(x) != "Mn"))


def casefold(c: Column) -> Column:
    """Equal for strings that are equal under Unicode's full case folding, inside the JVM: ß and SS, ς and Σ, ſ and S.

    Dotless ı, whose upper case is I, stands aside meanwhile; its return also keeps the
    optimizer from taking the lower case of an upper case for the lower case itself.
    """
    kept = F.translate(F.lower(c), "ı", "\uf8fe")
    full = F.translate(F.lower(F.translate(F.upper(kept), "\uf8fe", "ı")), "ς", "σ")
    return F.when(c.rlike(r"[^\x00-\x7f]"), full).otherwise(F.lower(c))


def casefold_equal(c: Column, value: str) -> Column:
    return casefold(c) == casefold(F.lit(value.strip()))


def citation(title: Column, meeting_date: Column, page: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(title, F.lit("")), F.nullif(meeting_date, F.lit("")), F.concat(F.lit("p. "), page.cast("string")))


def snippet(text: Column, query: str | None, size: int = 700) -> Column:
    """At most `size` characters around the earliest query word, with an ellipsis at each cut."""
    terms = [t.casefold() for t in (query or "").split()]
    n = F.length(text)
    if terms:
        found = F.filter(F.array(*(F.locate(t, F.lower(text)) for t in terms)), lambda p: p > 0)
        at = F.coalesce(F.array_min(found), F.lit(0))
    else:
        at = F.lit(0)
    start = F.greatest(F.lit(0), at - 1 - size // 2)
    end = F.least(n, F.when(at > 0, start).otherwise(F.lit(0)) + size)
    start = F.when(at > 0, F.greatest(F.lit(0), end - size)).otherwise(F.lit(0))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), strip(F.substring(text, start + 1, end - start)), F.when(end < n, "…").otherwise(""))
    return F.when(n <= size, text).otherwise(cut)


def metadata(c: Column) -> Column:
    """A JSON object's values by key, strings only; malformed JSON and other values give an empty map."""
    parsed = F.try_parse_json(c)
    return F.coalesce(F.from_json(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def merged(stored: Column, given: Column) -> Column:
    """Both maps' members; those of `given` win."""
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(given, k)), given)


def json_text(c: Column, key: str) -> Column:
    """The value of a key if it is a JSON string; numbers and other types give null, so that 2026 isn't '2026'."""
    v = F.try_variant_get(F.try_parse_json(c), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(c), f"$.{key}", "string"))


def iso_date(c: Column) -> Column:
    """A date from YYYY-MM-DD text, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))
