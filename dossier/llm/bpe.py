"""BPE encoding and decoding with a word-ended vocabulary file.

Encoding follows the file's pipeline: special tokens are cut out of the raw text; the rest
is NFC-normalised, lower-cased code point by code point, and split into contractions,
letter runs, single digits and runs of other visible characters, all by the library's own
tables of Unicode (`unicode_tables`), which differ from Python's. Each piece is encoded by
backtracking: an Aho-Corasick automaton over all reachable tokens finds, in one pass, every
token at every place; the encoder takes the longest token that is compatible with the one
before, then shorter ones, and steps back when none is left, marking the place as dead so
that it is entered once. Two tokens are compatible if undoing their merges from the latest
backwards meets no earlier merge across their border; the answers are kept in a table.
That gives the exact result of applying merges by rank, in time linear in the piece.

Decoding concatenates token strings through a table of offsets, a space between tokens
(the file names no decoder), as whole-array copies.

Defined cases: null and empty texts have no ids and decode to an empty text. A very long
text is encoded whole, in parts that are cut before blanks, where no token and no
normalization reaches across. Repeated rows each give a row. Columns other than doc_id and text are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm import textbatch as tb
from dossier.llm import unicode_tables

END = "</w>"
#: Bytes of pieces and their encodings that a worker keeps, with ENTRY_BYTES of the table for each, and pairs of tokens of
#: which it keeps whether they fit. Beyond it starts anew, which changes no result.
CACHE_BYTES, ENTRY_BYTES, CACHE_PAIRS = 48 << 20, 80, 1 << 18

#: Characters of a text, and ids of a sequence, that are handled at once.
PART_CHARS, PART_IDS = 1 << 20, 1 << 18
#: Bytes of text whose code points, pieces and ids are held at once.
BLOCK_BYTES = tb.BLOCK_BYTES // 2

_BARRIER = re.compile("([" + unicode_tables.barriers() + "])")
_LOWER = unicode_tables.lower()
_RECENT = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def byte_alphabet() -> dict[str, int]:
    """The visible stand-in of each byte, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return out


class Vocabulary:
    """A word-ended BPE vocabulary: tokens as strings over 512 symbols, byte b or, ending a word, 256 + b."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None:
            raise ValueError("not a word-ended BPE file without decoder")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}

        def symbols(s: str) -> str:
            last = s.endswith(END) and len(s) > len(END)
            codes = [alphabet[c] for c in (s[: -len(END)] if last else s)]
            if last:
                codes[-1] += 256
            return "".join(map(chr, codes))

        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merged[x, y] = (rank, z)
            self.parts.setdefault(z, (x, y, rank))
        self.compatible: dict[int, bool] = {}
        self.sizes: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if i in self.special.values():
                continue
            text = symbols(s)
            if i not in self.parts and len(text) > 1:
                continue  # no merge makes it
            self.sizes[i] = len(text)
            automaton.add_word(text, (i, len(text)))
        automaton.make_automaton()
        self.automaton = automaton

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side."""
        known = self.compatible.get(left << 32 | right)
        if known is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[left << 32 | right] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo merges, the latest first. A merge across the border would have been made if its rank lies below
        # that of the merge undone last; of equal ranks the left one comes first.
        limit, left_first = 1 << 60, False
        while True:
            cross = self.merged.get((a, b))
            if cross and (cross[0] < limit or (left_first and cross[0] == limit)):
                return False
            ra, rb = (self.parts[t][2] if t in self.parts else -1 for t in (a, b))
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, left_first, a = ra, False, self.parts[a][1]
            else:
                limit, left_first, b = rb, True, self.parts[b][0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        text = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n = len(text)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(text):
            longest[end - size + 1] = token  # ends ascend, so the longest stays
        # Mostly the longest tokens fit all along; no step back is needed then.
        out: list[int] = []
        pos, last, fits, sizes = 0, -1, self.fits, self.sizes
        while pos < n:
            token = longest[pos]
            if token < 0 or (last >= 0 and not fits(last, token)):
                return self._backtrack(text)
            out.append(token)
            last = token
            pos += sizes[token]
        return out

    def _backtrack(self, text: str) -> list[int]:
        n = len(text)
        at: list[list[int]] = [[] for _ in range(n)]
        for end, (token, size) in self.automaton.iter(text):
            at[end - size + 1].append(token)  # the longest last
        out: list[int] = []
        taken: list[tuple[int, int]] = []  # where each token of out starts and which option it is
        dead = bytearray(n + 1)
        fits, sizes = self.fits, self.sizes
        pos, option = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while option >= 0:
                token = options[option]
                if not dead[pos + sizes[token]] and (not out or fits(out[-1], token)):
                    break
                option -= 1
            else:
                if not out:
                    raise ArithmeticError("a piece has no encoding")
                dead[pos] = 1
                out.pop()
                pos, option = taken.pop()
                option -= 1
                continue
            out.append(token)
            taken.append((pos, option))
            pos += sizes[token]
            option = len(at[pos]) - 1 if pos < n else 0
        return out


CONTRACTED = {(ord("s"), 0), (ord("t"), 0), (ord("m"), 0), (ord("d"), 0), (ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))}
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and a random odd number for each."""
    kind = np.empty(0x110000, np.uint8)
    runs = unicode_tables.classes()
    for (at, name), (to, _) in zip(runs, [*runs[1:], (len(kind), "")]):
        kind[at:to] = "SLNO".index(name)
    return kind, np.random.default_rng(31).integers(1, 1 << 63, len(kind), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def piece_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in lower-cased code points of each contraction, letter run, digit or run of other visible characters."""
    kind = _code_tables()[0][codes]
    new = np.ones(len(codes), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(codes)]
    # An apostrophe that starts a piece takes the letters of a contraction from the run behind it.
    lone = np.flatnonzero((codes[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1) & (kind[start[1:]] == LETTER)) if len(start) > 1 else np.zeros(0, np.int64)
    if len(lone):
        one = codes[end[lone]]
        two = codes[np.minimum(end[lone] + 1, len(codes) - 1)]
        two = np.where(end[lone] + 1 < end[lone + 1], two, 0)
        take = np.zeros(len(lone), np.int64)
        for x, y in CONTRACTED:
            take[(one == x) & (two == y if y else True)] = 2 if y else 1
        end[lone] += take
        start[lone + 1] += take
    real = (kind[np.minimum(start, len(codes) - 1)] != SPACE) & (start < end)
    return start[real], end[real]


def parts(text: str) -> Iterator[str]:
    """The text, cut before blanks so that no part but one without blanks is much longer than PART_CHARS."""
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= PART_CHARS else text.find(" ", at + PART_CHARS - 1)
        yield text[at : to if to > 0 else len(text)]
        at = to if to > 0 else len(text)


class Encoder(dict):
    """Maps a piece to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.held = 0
        self.marks = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.vocabulary.encode_piece(piece)).tobytes()
        if len(piece) < 64:
            self.held += ENTRY_BYTES + sys.getsizeof(piece) + sys.getsizeof(ids)
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = ENTRY_BYTES + sys.getsizeof(piece) + sys.getsizeof(ids)
            self[piece] = ids
        return ids

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        if _BARRIER.search(text):
            text = "".join(x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_BARRIER.split(text)))
        else:
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return text.translate(_LOWER) if _RECENT.search(text) else text

    def _plain(self, text: str) -> bytes:
        low = self.normal(text)
        start, end = piece_spans(np.frombuffer(low.encode("utf-32-le"), "<u4"))
        return b"".join(self[low[a:b]] for a, b in zip(start.tolist(), end.tolist()))

    def encode(self, text: str) -> bytes:
        if self.marks and "<|" in text and self.marks.search(text):
            special = self.vocabulary.special
            return b"".join(array("I", [special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(self.marks.split(text)))
        return self._plain(text)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A block's pieces are found at once, and each different one is encoded once."""
        if len(texts) == 1 and len(texts[0]) > PART_CHARS:
            return [np.concatenate([self._block([x])[0] for x in parts(texts[0])])]
        return self._block(texts)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        marked = {k for k, x in enumerate(texts) if "<|" in x and self.marks and self.marks.search(x)}
        ready = ["" if k in marked else self.normal(x) for k, x in enumerate(texts)]
        whole = "\n".join(ready)
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in ready], out=off[1:])
        start, end = piece_spans(codes)
        key = tb.SpanHash(codes, _code_tables()[1])(start, end)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        if not tb.same_spans(codes, start, end, start[first[which]], end[first[which]]).all():  # two pieces of one hash
            return [np.frombuffer(self.encode(x), "<u4") for x in texts]
        ids = [self[whole[a:b]] for a, b in zip(start[first].tolist(), end[first].tolist())]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = np.frombuffer(b"".join(ids), "<u4")[np.arange(total) + np.repeat(at[which] - (ends - n), n)]
        cut = np.r_[0, ends][np.searchsorted(start, off)]
        return [np.frombuffer(self.encode(texts[k]), "<u4") if k in marked else out[cut[k] : cut[k + 1]] for k in range(len(texts))]


class Decoder:
    """Offset table of all tokens' strings, each with a space after it."""

    def __init__(self, vocabulary: Vocabulary):
        shown = [vocabulary.shown[i].encode("utf-8") + b" " if i in vocabulary.shown else b"" for i in range(max(vocabulary.shown) + 1)]
        self.data = np.frombuffer(b"".join(shown), np.uint8)
        self.off = np.zeros(len(shown) + 1, np.int64)
        np.cumsum([len(s) for s in shown], out=self.off[1:])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self._spaced(ids[a : a + PART_IDS]) for a in range(0, len(ids), PART_IDS))[:-1]

    def _spaced(self, ids: np.ndarray) -> bytes:
        start = self.off[ids]
        size = self.off[ids + 1] - start
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes()


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Encoder, Decoder]:
    v = Vocabulary(path)
    return Encoder(v), Decoder(v)


def _texts(t: tb.Texts) -> list[str]:
    raw = t.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist())]


def _encoded(documents: DataFrame, path: str, decoded: bool) -> DataFrame:
    def run(batches):
        enc, dec = _tools(path)
        for batch, t in tb.blocks(batches, "text", BLOCK_BYTES):
            ids = enc.encode_all(_texts(t))
            out = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
            if decoded:
                out["decoded"] = pa.array([dec.decode(x) for x in ids], pa.binary()).cast(pa.string())
            yield tb.output(batch, ["doc_id"], out)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids, little-endian unsigned 32-bit integers in a binary."""
    return _encoded(documents, path, False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns and `decoded`, the text of the column ids."""
    names = encoded.columns

    def run(batches):
        _, dec = _tools(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(names.index("ids"))
                text = [dec.decode(np.frombuffer(x.as_buffer(), "<u4")).decode("utf-8") if x.is_valid else "" for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded in one pass over the texts."""
    return _encoded(documents, path, True)
