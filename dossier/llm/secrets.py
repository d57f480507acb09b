"""Secret scans: base patterns, and grammars inferred from labelled credentials.

Base spans are exact, leftmost and not overlapping within their kind:

* assign: a keyword, an assignment sign and a value of 12 or more characters;
* access: `AKIA` and capitals or digits, 18 or more characters together;
* hex: a run of 16 or more lower-case hexadecimal digits.

The method adds spans of further formats. Labelled credentials of one format form a prefix
tree with counts. A node keeps a branch of its own for a character that most of its strings
take, as a fixed prefix does, and else branches by class of character (digit, a-f, g-z, A-F,
G-Z, each mark). States whose ends and branches are statistically alike, all the way down,
by Hoeffding's bound, are merged, ancestors first, into a probabilistic automaton. Candidates
are the parts, of 16 or more characters, of the runs of `A-Za-z0-9+/_.=-` that base spans
leave. An automaton whose strings begin by characters of their own starts
at every place of a run; one that begins by a class of characters (upper-case hexadecimal)
only where no letter or digit comes before, and ends only where none follows. The score is the
logarithm of the likelihood over that of a uniform choice of characters, by the longest part
that the automaton accepts, or by the likeliest if the longest has less than `THRESHOLD`.
Parts of `THRESHOLD` or more become spans, leftmost first, then by score, not overlapping.
Walks that meet in one state at one place are walked on once, so time is linear in the text.

All work is on UTF-8 bytes of whole texts; offsets returned are code points. An assigned
value's span is that of the whole match.

Defined cases: null and empty texts have no spans; the digest of no spans is that of an
empty string. A very long text is scanned whole. Spans of equal start and score go by kind. Repeated rows each give a row. Columns other than doc_id and text are ignored
by `scan`; `redact` keeps all columns. An empty table gives no rows; without labelled
credentials only base spans are found.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textbatch as tb

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
MIN_CANDIDATE = 16
#: Natural logarithm of the likelihood ratio from which a candidate is a credential.
THRESHOLD = 12.0
ALPHA = 0.05
#: Share of a node's strings from which one character has a branch of its own.
LITERAL_SHARE = 0.4
#: Strings from which on a node can be part of a fixed prefix.
MIN_FIXED = 8

TOKEN = np.zeros(256, bool)
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
ALNUM = TOKEN.copy()
ALNUM[list(b"+/_.=-")] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_HEADS = np.array([int.from_bytes(x, "little") for x in (b"pass", b"secr", b"toke", b"api_", b"apik")], np.uint32)

CLASSES: dict[str, str] = {}
for _name, _chars in (("0", string.digits), ("a", "abcdef"), ("g", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("G", "GHIJKLMNOPQRSTUVWXYZ")):
    CLASSES.update(dict.fromkeys(_chars, _name))
CLASSES.update({c: c for c in "+/_.=-"})
MEMBERS: dict[str, str] = {}
for _c, _k in CLASSES.items():
    MEMBERS[_k] = MEMBERS.get(_k, "") + _c


def labelled_credentials(each: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential) examples of publicly documented credential formats; none of them was ever issued."""
    rng = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    url = alnum + "-_"

    def some(chars: str, low: int, high: int | None = None) -> str:
        return "".join(rng.choices(chars, k=rng.randint(low, high or low)))

    makers = {
        "github": lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + some(alnum, 36),
        "gitlab": lambda: "glpat-" + some(url, 20),
        "google": lambda: "AIza" + some(url, 35),
        "jwt": lambda: "eyJ" + some(url, 17, 40) + ".eyJ" + some(url, 30, 120) + "." + some(url, 43),
        "npm": lambda: "npm_" + some(alnum, 36),
        "slack": lambda: rng.choice(["xoxb-", "xoxp-"]) + some(string.digits, 11, 12) + "-" + some(string.digits, 11, 12) + "-" + some(alnum, 24),
        "stripe": lambda: rng.choice(["sk_live_", "rk_live_"]) + some(alnum, 24),
        "upperhex": lambda: some("0123456789ABCDEF", 40),
    }
    return [(kind, make()) for kind, make in makers.items() for _ in range(each)]


class _Node:
    """A state: strings that came by, that end here, and its branches with the strings that took them."""

    __slots__ = ("n", "end", "next", "taken")

    def __init__(self):
        self.n, self.end, self.next, self.taken = 0, 0, {}, {}

    def fixed(self) -> bool:
        """Part of a fixed prefix: many strings, all of which go on by one character."""
        return self.n >= MIN_FIXED and not self.end and len(self.next) == 1 and next(iter(self.next))[0] == "="


def prefix_tree(samples: list[str]) -> _Node:
    """Counts by prefix. Branches are single characters that LITERAL_SHARE of a node's strings take, else classes."""
    root = _Node()
    work = [(root, samples, 0)]
    while work:
        node, strings, at = work.pop()
        node.n = len(strings)
        seen: dict[str, list[str]] = {}
        for s in strings:
            if len(s) == at:
                node.end += 1
            else:
                seen.setdefault(s[at], []).append(s)
        by: dict[str, list[str]] = {}
        for c, group in seen.items():
            own = (len(group) >= LITERAL_SHARE * node.n and node.n >= MIN_FIXED) or len(MEMBERS[CLASSES[c]]) == 1
            by.setdefault("=" + c if own else CLASSES[c], []).extend(group)
        for symbol in sorted(by):
            node.next[symbol] = child = _Node()
            node.taken[symbol] = len(by[symbol])
            work.append((child, by[symbol], at + 1))
    return root


def _alike(a: _Node, b: _Node, alpha: float) -> bool:
    """Whether two states' ends and branches, and all states below in step, pass Hoeffding's bound."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        if a.fixed() or b.fixed():
            return False
        bound = (0.5 * np.log(2 / alpha)) ** 0.5 * (a.n**-0.5 + b.n**-0.5)
        if abs(a.end / a.n - b.end / b.n) > bound:
            return False
        for s in {*a.next, *b.next}:
            if abs(a.taken.get(s, 0) / a.n - b.taken.get(s, 0) / b.n) > bound:
                return False
            if s in a.next and s in b.next:
                work.append((a.next[s], b.next[s]))
    return True


def _fold(a: _Node, b: _Node) -> None:
    """Add the tree below b to a."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        a.n, a.end = a.n + b.n, a.end + b.end
        for s, child in b.next.items():
            a.taken[s] = a.taken.get(s, 0) + b.taken[s]
            if s in a.next:
                work.append((a.next[s], child))
            else:
                a.next[s] = child


def infer(samples: list[str], alpha: float = ALPHA) -> _Node:
    """Red-blue merging, the state of most strings first; it is compared with its parent, then with the states before."""
    root = prefix_tree(samples)
    red, done = [root], {id(root)}
    while True:
        blue = [(p, s, c) for p in red for s, c in p.next.items() if id(c) not in done]
        if not blue:
            return root
        parent, symbol, child = max(blue, key=lambda x: x[2].n)
        for r in [parent, *(x for x in reversed(red) if x is not parent)]:
            if _alike(r, child, alpha):
                parent.next[symbol] = r
                _fold(r, child)
                break
        else:
            red.append(child)
            done.add(id(child))


@dataclass(frozen=True)
class Grammar:
    """All formats' automata in one table: step and log-likelihood ratio by state and byte; -1 and end -inf: not accepted."""

    kinds: list[str]
    start: np.ndarray
    step: np.ndarray
    gain: np.ndarray
    end: np.ndarray
    #: By format: whether its strings begin by a class of characters; whether it accepts two bytes, b0 * 256 + b1, at its start.
    loose: np.ndarray
    pairs: np.ndarray


def compile_grammar(labelled: list[tuple[str, str]]) -> Grammar:
    by: dict[str, list[str]] = {}
    for kind, text in labelled:
        if text and all(c in CLASSES for c in text):
            by.setdefault(kind, []).append(text)
    kinds, start, states, loose = sorted(by), [], [], []
    for kind in kinds:
        root = infer(by[kind])
        number, order = {id(root): len(states)}, [root]
        for node in order:
            for c in node.next.values():
                if id(c) not in number:
                    number[id(c)] = len(states) + len(order)
                    order.append(c)
        start.append(len(states))
        loose.append(any(s[0] != "=" for s in root.next))
        states += [(node, number) for node in order]
    step = np.full((len(states), 256), -1, np.int32)
    gain = np.zeros((len(states), 256))
    end = np.full(len(states), -np.inf)
    uniform = np.log(len(CLASSES))
    for k, (node, number) in enumerate(states):
        if node.end:
            end[k] = np.log(node.end / node.n) + uniform
        for s, c in sorted(node.next.items(), key=lambda x: len(x[0])):  # single characters last: they overrule their class
            chars = s[1] if s[0] == "=" else MEMBERS[s]
            for ch in chars:
                step[k, ord(ch)] = number[id(c)]
                gain[k, ord(ch)] = np.log(node.taken[s] / node.n / len(chars)) + uniform
    pairs = np.zeros((len(kinds), 256, 256), bool)
    for k, root in enumerate(start):
        first = np.flatnonzero(step[root] >= 0)
        pairs[k, first] = step[step[root, first]] >= 0
    return Grammar(kinds, np.array(start, np.int32), step, gain, end, np.array(loose, bool), pairs.reshape(len(kinds), 65536))


def likelihood(g: Grammar, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each span under each format; -inf where it isn't accepted."""
    n, k = len(start), len(g.kinds)
    out = np.full(n * k, -np.inf)
    item = np.repeat(np.arange(n), k)
    state = np.tile(g.start, n)
    total, slot = np.zeros(n * k), np.arange(n * k)
    at = start[item]
    while len(slot):
        over = at == end[item]
        if over.any():
            out[slot[over]] = total[over] + g.end[state[over]]
            go = ~over
            item, state, total, slot, at = item[go], state[go], total[go], slot[go], at[go]
        byte = data[at]
        total = total + g.gain[state, byte]
        state = g.step[state, byte]
        go = state >= 0
        item, state, total, slot, at = item[go], state[go], total[go], slot[go], at[go] + 1
    return out.reshape(n, k)


def base_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind number, start and end (bytes) of the base spans of a block's texts, in no order."""
    found: list[tuple[int, int, int]] = []
    raw = data.tobytes()
    if len(data) >= 4:
        at = []
        for a in range(0, len(data), tb.BLOCK_BYTES):
            low = _FOLD[data[a : a + tb.BLOCK_BYTES + 3]].astype(np.uint32)
            four = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
            at.append(np.flatnonzero(np.isin(four, _HEADS)) + a)
        at = np.concatenate(at)
        ends = off[1:][np.searchsorted(off[1:], at, side="right")].tolist() if len(at) else []
        last = -1
        for a, stop in zip(at.tolist(), ends):
            if a >= last and (m := ASSIGN.match(raw, a, stop)):
                last = m.end()
                if m.end(2) - m.start(2) >= MIN_ASSIGN:
                    found.append((0, a, last))
    if b"AKIA" in raw:
        bounds = off.tolist()
        heads = sorted({int(np.searchsorted(off, m.start(), side="right")) - 1 for m in re.finditer(rb"AKIA", raw)})
        for d in heads:
            for m in ACCESS.finditer(raw, bounds[d], bounds[d + 1]):
                if m.end() - m.start() >= MIN_ACCESS:
                    found.append((1, m.start(), m.end()))
    h = tb.runs(HEX[data], off)
    long = np.flatnonzero(h.end - h.start >= MIN_HEX)
    first = np.array(found, np.int64).reshape(-1, 3)
    kind = np.r_[first[:, 0], np.full(len(long), 2)]
    return kind, np.r_[first[:, 1], h.start[long]], np.r_[first[:, 2], h.end[long]]


def _accepted(g: Grammar, raw: bytes, at: int, stop: int, state: int, known: dict) -> tuple[int, float, int, float]:
    """Longest end (-1: none) and its score, likeliest end and its score, from a state at a place. known: answers in this run."""
    path = []
    while (at, state) not in known:
        to = int(g.step[state, raw[at]]) if at < stop else -1
        path.append((at, state, float(g.gain[state, raw[at]]) if to >= 0 else 0.0))
        if to < 0:
            break
        at, state = at + 1, to
    far, far_score, best, best_score = known.get((at, state), (-1, -np.inf, -1, -np.inf))
    for at, state, gain in reversed(path):
        here = float(g.end[state])
        far_score, best_score = far_score + gain, best_score + gain
        if far < 0 and here > -np.inf:
            far, far_score = at, here
        if here > best_score:
            best, best_score = at, here
        known[at, state] = far, far_score, best, best_score
    return far, far_score, best, best_score


def learned_spans(t: tb.Texts, g: Grammar, taken: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(kind number of the grammar, start, end) in bytes, in order, outside the bytes that are taken."""
    if len(t.data) < MIN_CANDIDATE or not g.kinds:
        return []
    inside = TOKEN[t.data] & ~taken
    c = tb.runs(inside, t.off)
    some = np.flatnonzero(c.end - c.start >= MIN_CANDIDATE)
    first, last = c.start[some], c.end[some]
    if not len(first):
        return []
    pair = t.data[:-1].astype(np.uint16) << np.uint16(8) | t.data[1:]
    at = np.flatnonzero(g.pairs.any(0)[pair] & inside[:-1])
    run = np.searchsorted(first, at, side="right") - 1
    fits = (run >= 0) & (at + MIN_CANDIDATE <= last[run])
    at, run = at[fits], run[fits]
    heads, tails = set(t.off[:-1].tolist()), set(t.off[1:].tolist())
    begun = []
    for k in range(len(g.kinds)):
        mine = np.flatnonzero(g.pairs[k][pair[at]])
        state = np.full(len(mine), g.start[k])
        for step in range(MIN_CANDIDATE):
            state = g.step[state, t.data[at[mine] + step]]
            mine, state = mine[state >= 0], state[state >= 0]
        begun += [(a, k, r) for a, r in zip(at[mine].tolist(), run[mine].tolist())]
    raw, known, of = t.data.tobytes(), {}, -1
    found = []
    for a, k, r in sorted(begun):
        if r != of:
            known, of = {}, r
        if g.loose[k] and a not in heads and ALNUM[raw[a - 1]]:
            continue
        far, score, best, best_score = _accepted(g, raw, a, int(last[r]), int(g.start[k]), known)
        end, score = (far, score) if score >= threshold else (best, best_score)
        if score >= threshold and end - a >= MIN_CANDIDATE and not (g.loose[k] and end not in tails and ALNUM[raw[end]]):
            found.append((a, -score, k, end))
    out, free = [], 0
    for a, _, k, end in sorted(found):
        if a >= free:
            out.append((k, a, end))
            free = end
    return out


def spans_of(t: tb.Texts, g: Grammar, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text number, kind number (base kinds, then the grammar's), start and end (bytes in the block), by text, start and kind."""
    kind, start, end = base_spans(t.data, t.off)
    taken = np.zeros(len(t.data), bool)
    for a, b in zip(start.tolist(), end.tolist()):
        taken[a:b] = True
    more = np.array(learned_spans(t, g, taken, threshold), np.int64).reshape(-1, 3)
    kind, start, end = np.r_[kind, more[:, 0] + len(BASE_KINDS)], np.r_[start, more[:, 1]], np.r_[end, more[:, 2]]
    order = np.lexsort((kind, start))
    kind, start, end = kind[order], start[order], end[order]
    return np.searchsorted(t.off, start, side="right") - 1, kind, start, end


def scan(documents: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, base kinds first, in code points."""
    shipped = documents.sparkSession.sparkContext.broadcast(grammar)  # a few hundred states
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        g = shipped.value
        names = [*BASE_KINDS, *g.kinds]
        for batch, t in tb.blocks(batches, "text"):
            doc, kind, start, end = spans_of(t, g, threshold)
            text, first, last = (tb.count_before(tb.char_starts(t), x) for x in (t.off[:-1][doc], start, end)) if len(doc) else (start,) * 3
            flat = pa.StructArray.from_arrays([pa.array([names[k] for k in kind], pa.string()), pa.array(first - text, pa.int64()), pa.array(last - text, pa.int64())], fields=list(kind_type))
            offsets = np.searchsorted(doc, np.arange(len(t) + 1)).astype(np.int32)
            yield tb.output(batch, ["doc_id"], {"spans": pa.ListArray.from_arrays(pa.array(offsets), flat)})

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ready.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(documents: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, with each secret replaced by its kind in angle brackets, and n_chars, if there, counted anew.

    Overlapping spans are replaced together, by the kind of the first. Null texts stay null.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(grammar)
    schema = documents.schema
    names = documents.columns

    def run(batches):
        g = shipped.value
        kinds = [*BASE_KINDS, *g.kinds]
        for batch, t in tb.blocks(batches, "text"):
            doc, kind, start, end = spans_of(t, g, threshold)
            text = batch.column(names.index("text"))
            if len(doc):
                new = text.to_pylist()
                raw = t.data.tobytes()
                for d in np.unique(doc).tolist():
                    a, b = np.searchsorted(doc, [d, d + 1])
                    out, at = [], int(t.off[d])
                    for k, s, e in zip(kind[a:b].tolist(), start[a:b].tolist(), end[a:b].tolist()):
                        if s >= at:
                            out += [raw[at:s], b"<", kinds[k].encode(), b">"]
                        at = max(at, e)
                    new[d] = b"".join([*out, raw[at : int(t.off[d + 1])]]).decode("utf-8", "replace")
                text = pa.array(new, text.type)
            columns = [text if c == "text" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = documents.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return out
