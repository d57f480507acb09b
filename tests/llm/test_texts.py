"""Operators on single documents against brute force."""

import hashlib
import math
import random
import re
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import bpe, language, quality_net, quality_rules, queries, secrets, simhash, unicode_tables
from dossier.llm import textbatch as tb
from dossier.llm.shared import training_rows
from conftest_llm import LONG, by_id

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def samples():
    rng = random.Random(3)
    frag = ["a", "bb", "word", "Word", "é", "日本", "#*", "$", "\n", "\n\n", " ", "\t", "\x0b", "\r\n", "token=", "AKIA", "ABCDEF0123456789XY", "0123456789abcdef", "password: ", '"', "'s", "'Re", "don't", "12", "…", " ", " ", "ſecret: aaaaaaaaaaaaaa", "api_key = ", "APIKEY:", "<|endoftext|>", "Σ", "İ"]
    return ["".join(rng.choice(frag) for _ in range(rng.randint(0, 60))) for _ in range(400)]


def texts_of(df):
    return df.select("doc_id", "text").toPandas().itertuples(index=False)


def brute_base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for k in range(len(words) - 2):
        count.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + d for places in count.values() if len(places) > 1 for k in places for d in range(3)}
    base = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(repeated)}
    return base | {"base_failed": len(words) < 50 or 100 * len(repeated) > 50 * len(words)}


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def rules(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules.fit(documents, labels)


def test_op1_counts(spark, rules, edges):
    texts = samples() + ["same line\nsame line\n\nsame line", "a b c a b c a b c " * 20]
    for r in by_id(quality_rules.judge(docs(spark, texts), rules)):
        want = brute_base(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["score"] <= 1
    got = by_id(quality_rules.judge(edges, rules))
    assert len(got) == 10 and [r["n_words"] for r in got[2:5]] == [0, 0, 0] and got[-1]["doc_id"] is None
    assert quality_rules.judge(edges.limit(0), rules).count() == 0


def thue_morse(n, flip=0):
    return "".join("ab"[(k.bit_count() + flip) & 1] for k in range(n))


#: Different strings that a polynomial hash modulo 2**64 can't tell apart.
TWINS = thue_morse(2048), thue_morse(2048, 1)


def block_of(texts):
    return next(t for _, t in tb.blocks([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], "text", 1 << 40))


def test_equal_hashes_of_different_strings(spark, rules, grammar):
    t = block_of(list(TWINS))
    h = tb.SpanHash(t.data)(t.off[:-1], t.off[1:])
    assert h[0] == h[1]
    texts = ["\n".join(TWINS), "\n".join([*TWINS, TWINS[0]]), " ".join(TWINS * 4), " ".join([*TWINS, "x"] * 3), TWINS[0]]
    for r in by_id(quality_rules.judge(docs(spark, texts), rules)):
        want = brute_base(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in by_id(bpe.encode(docs(spark, texts), path))] == [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert [[tuple(s) for s in r["spans"]] for r in by_id(secrets.scan(docs(spark, texts), grammar))] == list(map(brute_spans, texts))
    net = quality_net.fit_texts(["good words here", "###"] * 10, np.array([1.0, 0.0] * 10))
    assert len(by_id(quality_net.score(docs(spark, texts), net))) == 5


@pytest.mark.parametrize("text", ["word other é thing\n" * 900, "x" * 9000, "a\n" * 5000, "é" * 5000 + " 12 ghp_" + "a1B2" * 9])
def test_pieces_of_a_long_text_give_what_the_whole_gives(monkeypatch, rules, grammar, text):
    """Every operator's piecewise work, with pieces far smaller than the text."""
    net = quality_net.fit_texts(["good words here", "###"] * 10, np.array([1.0, 0.0] * 10))
    encoder, decoder = bpe._tools(public_tokenizers.path("word_bpe_49k.json"))

    def all_of(t):
        w, h = tb.words(t), tb.SpanHash(t.data)
        ids = encoder.encode_all(bpe._texts(t))[-1]
        return [
            *(x.tolist() for x in quality_rules.base_counts(t, w, h).values()), quality_rules.logits(rules, t, w, h).round(9).tolist(), quality_net.score_texts(net, t).round(9).tolist(), [x.tolist() for x in secrets.spans_of(t, grammar)],
            simhash.fingerprints(t).tolist(), ids.tolist(), decoder.decode(ids), [x.tolist() for x in language.text_grams(text)], h.raw(w.start, w.end).tolist(),
        ]

    want = all_of(block_of([text]))
    tb._tables()  # made for the usual size
    for module, name, size in ((tb, "CHUNK", 512), (tb, "BLOCK_BYTES", 300), (quality_net, "TOKENS", 7), (simhash, "_HASHES_AT_ONCE", 11), (bpe, "PART_CHARS", 50), (bpe, "PART_IDS", 13), (language, "GRAM_CHARS", 40)):
        monkeypatch.setattr(module, name, size)
    assert all_of(block_of([text])) == want


def test_what_a_worker_keeps_of_encodings_is_bounded_in_bytes():
    class Plain(bpe.Vocabulary):
        def __init__(self):
            self.special, self.compatible = {}, {}

        def encode_piece(self, piece):
            return [7] * 100

        def _fits(self, a, b):
            return True

    encoder = bpe.Encoder(Plain())
    for k in range(250_000):
        assert len(encoder[f"{k:06d}" + "日" * 50]) == 400
    assert sys.getsizeof(encoder) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in encoder.items()) < 64 << 20
    assert all(encoder.vocabulary.fits(1, k) for k in range(1_000_000))
    known = encoder.vocabulary.compatible
    assert sys.getsizeof(known) + sum(map(sys.getsizeof, known)) < 32 << 20


def test_dropping_what_is_kept_changes_no_encoding(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(path), [*samples(), "unhappily untied knots " * 40]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 9)
    encoder = bpe.Encoder(bpe.Vocabulary(path))
    got = [encoder.encode_all([x])[0].tolist() for x in texts]
    assert got == [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert encoder.held <= 1000 and len(encoder.vocabulary.compatible) <= 9


def test_training_rows_go_by_hash_up_to_both_bounds(spark):
    texts = [(k, "x" * (k % 50 + 1)) for k in range(300)] + [(7, "another"), (7, "a"), (1000, "y" * 500)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(9, 0), (1000, 1)], "doc_id long, quality int")
    place = {r[0]: r[1] for r in documents.select("doc_id", F.xxhash64("doc_id")).distinct().collect()}
    free = sorted((k for k in range(300) if k != 9 and zlib.crc32(str(k).encode()) % 5), key=place.get)[:100]
    size, want = 0, []
    for k in free:
        size += 1 if k == 7 else k % 50 + 1
        if size <= 1500:
            want.append((k, "a" if k == 7 else "x" * (k % 50 + 1), k % 2))
    got = training_rows(documents, labels, "quality", 5, 0, 100, 1500)
    assert list(got.itertuples(index=False, name=None)) == want and 0 < len(want) < 100


def test_op1_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in by_id(queries.op1_quality_rules(spark, sf))}
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    for d, text in texts_of(whole):
        want = brute_base(text)
        assert {k: got[d][k] for k in want} == want
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = {d for d in good if zlib.crc32(str(d).encode()) % 5 == 0}
    judged = [(good[d], r["kept"]) for d, r in got.items() if d in held and not r["base_failed"]]
    assert sum(q == k for q, k in judged) / len(judged) > 0.95


def test_op1_and_op9_without_usable_labels(spark, edges, no_labels):
    assert quality_rules.judge(edges, quality_rules.fit(edges, no_labels)).where("score < 0 or score > 1 or score is null").count() == 0
    assert quality_net.score(edges, quality_net.fit(edges, no_labels)).where("score < 0 or score > 1 or score is null").count() == 0


def test_op4_matches_the_library(spark, edges):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(9)
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x300, 0x370), *range(0x390, 0x450), 0x1F600, 0xAC00, 0x1100, 0x1161, 0x0E33, 0x2160)]
    texts = samples() + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["ab" * 500, "it's we'RE I'll 'dx ''s 's's"]
    for df, all_texts in ((docs(spark, texts), dict(enumerate(texts))), (edges, None)):
        for r, t in ((r, all_texts[r["doc_id"]]) for r in by_id(bpe.round_trip(df, path))) if all_texts else ():
            want = lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
            assert r["decoded"] == lib.decode(want, skip_special_tokens=False)
    by = {r["doc_id"]: r for r in by_id(bpe.round_trip(edges, path))}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["decoded"] == ""
    assert by[5]["n_tokens"] == len(lib.encode(LONG, add_special_tokens=False).ids)
    assert bpe.round_trip(edges.limit(0), path).count() == 0
    again = bpe.decode(bpe.encode(edges, path), path)
    assert sorted(map(str, again.select("doc_id", "decoded").collect())) == sorted(map(str, bpe.round_trip(edges, path).select("doc_id", "decoded").collect()))


def test_op4_code_points_and_marks(spark):
    """Every code point by itself, all marks after each other, and random texts of all planes."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    encoder, _ = bpe._tools(path)
    rng = random.Random(12)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assigned = [c for c in every if unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in every if unicodedata.combining(chr(c)) or chr(c) in unicode_tables.barriers()]
    texts = ["".join(f"a{chr(c)}A1 " for c in every[k : k + 500]) for k in range(0, len(every), 500)]
    some = rng.sample(marks, 60)  # every mark before and after 60 others
    texts += ["".join(f"e{chr(a)}{chr(b)} o{chr(b)}{chr(a)} " for a in marks) for b in some]
    texts += ["".join(chr(rng.choice(pool)) for _ in range(60)) for pool in (every, assigned, [c for c in assigned if c < 0x3000]) for _ in range(1000)]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_op4_query(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    got = {r["doc_id"]: r for r in by_id(queries.op4_bpe_encoding(spark, SF))}
    for d, text in texts_of(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[d]["n_tokens"] == len(ids)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def grammar():
    return secrets.compile_grammar(secrets.labelled_credentials())


def test_op5_base_spans(spark, grammar, edges):
    texts = samples()
    for r in by_id(secrets.scan(docs(spark, texts), grammar)):
        assert [tuple(s) for s in r["spans"] if s["kind"] in secrets.BASE_KINDS] == brute_spans(texts[r["doc_id"]])
    got = by_id(secrets.scan(edges, grammar))
    assert len(got) == 10 and got[2]["spans"] == got[3]["spans"] == []
    assert [s["kind"] for s in got[8]["spans"]] == ["assign", "hex", "github"]
    assert secrets.scan(edges.limit(0), grammar).count() == 0


def test_op5_grammar_finds_unseen_credentials_and_leaves_prose(grammar):
    held = secrets.labelled_credentials(60, seed=1234)
    data = np.frombuffer("".join(x for _, x in held).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(x) for _, x in held])]
    score = secrets.likelihood(grammar, data, off[:-1], off[1:])
    right = [grammar.kinds[k] == kind and s >= secrets.THRESHOLD for (kind, _), k, s in zip(held, score.argmax(1), score.max(1))]
    assert np.mean(right) > 0.95
    prose = ["mail7.example.com-and-more", "desleleenpa.90.and.some", "version-2.10.3-release-candidate", "2024-01-01T00.00.00.000000", "chapter_12_of_the_book_of_roads"]
    data = np.frombuffer("".join(prose).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(x) for x in prose])]
    assert (secrets.likelihood(grammar, data, off[:-1], off[1:]).max(1) < secrets.THRESHOLD).all()
    assert secrets.compile_grammar([]).kinds == []


def found_in(spark, grammar, texts):
    """The strings, by kind, that the scan finds in each text."""
    return [[(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] for r, text in zip(by_id(secrets.scan(docs(spark, texts), grammar)), texts)]


def test_op5_credentials_that_touch_other_characters(spark, grammar):
    held = [(kind, x) for kind, x in secrets.labelled_credentials(20, seed=77) if not re.search("[0-9a-f]{16}", x) and not x.endswith(("-", "_"))]
    for before, after in (("é use ", "."), ("GH_PAT=", ""), ("STRIPE=", "\n"), ("https://host/path/", ""), ("a/b?key=", "...")):
        got = found_in(spark, grammar, [before + x + after for _, x in held])
        assert np.mean([g == [want] for g, want in zip(got, held)]) > 0.95, (before, after)
    two = "ghp_" + "a1B2" * 9, "npm_" + "Zy9X" * 9
    assert found_in(spark, grammar, ["/".join(two)]) == [[("github", two[0]), ("npm", two[1])]]
    hexes = "0A1B2C3D4E" * 4
    assert found_in(spark, grammar, [f"id={hexes}.", f"x{hexes}", f"{hexes}x"]) == [[("upperhex", hexes)], [], []]
    assert found_in(spark, grammar, ["xoxb-1" * 20000, "glpat-" * 3 + "1", "v1/sk_live_2.com-and-more-text"]) == [[], [("gitlab", "glpat-" * 3 + "1")], []]


def test_op5_scan_finds_held_out_credentials_with_and_without_digits(spark, grammar):
    held = [(kind, x) for kind, x in secrets.labelled_credentials(60, seed=1234) if not re.search("[0-9a-f]{16}", x)]
    assert np.mean([g == [want] for g, want in zip(found_in(spark, grammar, [f"use {x} here" for _, x in held]), held)]) > 0.95
    bare = [(kind, x) for kind, x in secrets.labelled_credentials(500, seed=4321) if not re.search("[0-9]", x)]
    assert {kind for kind, _ in bare} >= {"gitlab", "stripe"}
    assert found_in(spark, grammar, [f"use {x} here" for _, x in bare]) == [[want] for want in bare]
    prose = ["a well-known/documented.example_of=prose", "npm_config_registry=something", "the task_live_view-and-others", "ACADEMY-OF-MOTION-PICTURES-AND-ARTS", "glossary_of_terms-and-phrases"]
    assert found_in(spark, grammar, prose) == [[]] * 5


def brute_learned(text, g):
    """All formats at all places, byte by byte; `text` is ASCII."""
    taken = {k for _, a, b in brute_spans(text) for k in range(a, b)}
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", "".join(" " if k in taken else c for k, c in enumerate(text))):
        alnum = lambda k: m.start() <= k < m.end() and text[k].isalnum() or 0 <= k < len(text) and text[k].isalnum()
        for a in range(m.start(), m.end() - 15):
            for k in range(len(g.kinds)):
                state, total, ends = int(g.start[k]), 0.0, []
                for at in range(a, m.end()):
                    byte = ord(text[at])
                    total += g.gain[state, byte]
                    state = int(g.step[state, byte])
                    if state < 0:
                        break
                    if g.end[state] > -math.inf:
                        ends.append((at + 1, total + g.end[state]))
                if not ends:
                    continue
                end, score = ends[-1] if ends[-1][1] >= secrets.THRESHOLD else max(ends, key=lambda x: x[1])
                whole = not g.loose[k] or not (alnum(a - 1) or alnum(end))
                if score >= secrets.THRESHOLD and end - a >= 16 and whole:
                    found.append((a, -round(score, 9), k, end))
    out, free = [], 0
    for a, _, k, end in sorted(found):
        if a >= free:
            out.append((g.kinds[k], a, end))
            free = end
    return out


def test_op5_learned_spans_against_all_candidates(spark, grammar):
    rng = random.Random(21)
    known = [x for _, x in secrets.labelled_credentials(6, seed=5)]
    glue = ["=", ".", "/", " ", "x", "https://h/", "-", "\n", "0A", "ghp_", "sk_live_"]
    texts = ["".join(rng.choice([rng.choice(known), rng.choice(glue), rng.choice(known)[: rng.randint(1, 30)]]) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    texts += [t.encode("ascii", "replace").decode() for _, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet")) if t and len(t) < 3000]
    for r, text in zip(by_id(secrets.scan(docs(spark, texts), grammar)), texts):
        assert [tuple(s) for s in r["spans"] if s["kind"] not in secrets.BASE_KINDS] == brute_learned(text, grammar)


def test_op5_redaction(spark, grammar, edges):
    got = {r["doc_id"]: r for r in by_id(secrets.redact(edges, grammar))}
    assert got[8]["text"] == "<assign>' <github>" and got[8]["n_chars"] == len(got[8]["text"])
    assert got[2]["text"] is None and got[2]["fp"] == "x" and got[5]["text"] == LONG
    assert secrets.redact(edges, grammar).columns == edges.columns


def test_op5_query(spark):
    got = {r["doc_id"]: r for r in by_id(queries.op5_secret_scans(spark, SF))}
    for d, text in texts_of(spark.read.parquet(f"{SF}/documents.parquet")):
        want = brute_spans(text or "")
        assert [got[d][f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(x == k for x, _, _ in want) for k in secrets.BASE_KINDS]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def brute_profile(texts):
    count = {}
    for text in texts:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            padded = "\0" + w + "\0"
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    g = padded[k : k + n]
                    if g != "\0":
                        count[g] = count.get(g, 0) + 1
    return count


def code(gram):
    out = 0
    for ch in gram:
        out = out << 21 | (ord(ch) or language.MARK)
    return out


def brute_top(counts):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.PROFILE]


def test_op6_profiles_and_distance():
    for text in ("Ab, ab!", "été 12 l'été\nÉTÉ", " x", "日本 語", "a1b"):
        want: dict[int, int] = {}
        for gram, c in brute_profile([text]).items():
            want[code(gram)] = want.get(code(gram), 0) + c
        assert dict(zip(*(x.tolist() for x in language.text_grams(text)))) == want, text
    part = language.part_from_texts({"x": ["aaa bbb " * 5], "y": ["ccc ddd " * 5], "z": ["ccc ddd " * 5]})
    own = lambda *texts: [language.profile(*language.text_grams(x)) for x in texts]
    assert [x for x, _ in language.nearest(own("aaa", "ddd ccc", "123", ""), [part])] == ["x", "y", "und", "und"]  # a tie goes to y
    assert language.nearest(own("aaa"), []) == [("und", 0.0)]


def test_op6_against_brute_force(spark):
    """Profiles, distances, ties and scores, in one part of languages and in several."""
    rng = random.Random(6)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(30)] for lang, letters in (("aa", "abc"), ("bb", "abd"), ("cc", "xyé"), ("dd", "pq"))}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(1, 40))), lang) for k, lang in enumerate(rng.choices(list(words), k=200))]
    rows += [(1000 + k, t, "ee" if lang == "aa" else lang) for k, t, lang in rows if lang == "aa"]  # as aa: ties
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    tops = {lang: {g: k for k, g in enumerate(brute_top(brute_profile([t for _, t, x in learned if x == lang])))} for lang in {r[2] for r in rows}}
    want = {}
    for d, text, _ in rows:
        own = brute_top(brute_profile([text]))
        far = {lang: sum(abs(top[g] - k) if g in top else language.PROFILE for k, g in enumerate(own)) for lang, top in tops.items()}
        best = min(far, key=lambda x: (far[x], x))
        want[d] = best, 1 / sum(math.exp(-(f - far[best]) / (len(own) * language.PROFILE / 100)) for f in far.values())
    for size in (2000, 1):
        got = by_id(language.predict(df, language.fit(df, part_languages=size)))
        assert all(r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-9 for r in got) and len(got) == len(rows)


def test_op6_learns_a_share_of_a_large_language(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5900, "ab ab").otherwise("cd cd").alias("text"), F.when(F.col("id") < 5900, "big").otherwise("small").alias("lang"))
    model = language.fit(df, 50)
    part = language._load(model.path, 0)
    assert part.names == ["big", "small"]
    assert {r[0] for r in language.predict(df, model).select("lang_pred").distinct().collect()} == {"big", "small"}


def test_op6_query(spark, edges):
    got = {r["doc_id"]: r for r in by_id(queries.op6_language_id(spark, "/root/testdata/sf0.01"))}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.97
    small = by_id(language.predict(edges, language.fit(edges)))
    assert len(small) == 10 and [r["lang_pred"] for r in small[2:5]] == ["und"] * 3 and small[-1]["held_out"] is False
    assert language.predict(edges.limit(0), language.fit(edges.limit(0))).count() == 0
    assert {r["lang_pred"] for r in by_id(language.predict(edges, language.fit(edges.limit(0))))} == {"und"}


def test_op9_query(spark, edges):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in by_id(queries.op9_quality_classifier(spark, sf))}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d in held) and all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert sum(got[d]["predicted"] == truth[d] for d in held) / len(held) > 0.95
    model = quality_net.fit_texts(["good words here", "###"] * 10, np.array([1.0, 0.0] * 10))
    assert len(by_id(quality_net.score(edges, model))) == 10
    assert quality_net.accept(edges, model).columns == edges.columns
    assert quality_net.score(edges.limit(0), model).count() == 0


def test_op9_score_against_plain_python():
    """Pooling and network over tokens one by one, from the fitted tables."""
    net = quality_net.fit_texts(samples()[:200], np.arange(200) % 3 > 0)
    letters = lambda c: c.isalnum() if ord(c) < 128 else True
    for text in samples()[200:260]:
        raw = (text or "").encode()
        shown = raw.decode("latin-1")
        toks = [m[0] for m in re.finditer(r"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", shown)]
        rows = []
        for x in toks:
            data = np.frombuffer(x.encode("latin-1"), np.uint8)
            row = int(tb.SpanHash(data)(np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - quality_net.TABLE_BITS))
            share = lambda some: (len(some) > 0) + (len(some) == len(x) and len(x) > 1)
            shape = min(len(x), 12) // 4 + 4 * share(re.findall("[A-Z]", x)) + 12 * share(re.findall("[0-9]", x)) if letters(x[0]) else 40 + min(len(x), 20)
            rows.append((row, row if net.known[row] else shape + (1 << quality_net.TABLE_BITS)))
        v = [net.vectors[k].astype(float) for _, k in rows]
        n, zero = max(len(v), 1), np.zeros(quality_net.DIMS)
        mean, square = sum(v, zero) / n, sum((x * x for x in v), zero) / n
        near = sum((a * b for a, b in zip(v, v[1:])), zero) / n
        same = sum(a[0] == b[0] for a, b in zip(rows, rows[1:])) / n
        x = np.r_[mean, square, near, near.sum(), same, mean @ mean, math.log1p(len(v)) / 10, not v]
        z = np.tanh((x - net.center) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2
        assert quality_net.score_texts(net, block_of([text]))[0] == pytest.approx(1 / (1 + math.exp(-z / net.temperature)), abs=1e-6)


def test_op1_verdict_against_plain_python(rules):
    """Every n-gram one by one, from the fitted weights."""
    for text in samples()[:60]:
        raw = text.encode()
        h = lambda b: tb.SpanHash(np.frombuffer(b, np.uint8)).raw(np.array([0]), np.array([len(b)]))
        words = [h(w.encode()) for w in WORD.findall(text)]
        pairs = [a * np.uint64(3) + b * np.uint64(0x9E3779B97F4A7C15) for a, b in zip(words, words[1:])]
        threes = [h(text[k : k + 3].encode()) for k in range(len(text) - 2)]
        z = rules.bias
        for weights, found in zip(rules.weights, (words, pairs, threes)):
            z += sum(float(weights[int(tb.mix(x)[0] >> np.uint64(64 - quality_rules.BITS))]) for x in found) / max(len(found), 1)
        t = block_of([text])
        assert raw == t.data.tobytes() and quality_rules.logits(rules, t, tb.words(t), tb.SpanHash(t.data))[0] == pytest.approx(z, abs=1e-6)


def test_scores_do_not_depend_on_the_batch(rules):
    texts = samples()[:50]
    net = quality_net.fit_texts(["good words here", "###"] * 10, np.array([1.0, 0.0] * 10))
    whole = next(t for _, t in tb.blocks([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], "text"))
    alone = [next(t for _, t in tb.blocks([pa.RecordBatch.from_arrays([pa.array([x])], names=["text"])], "text")) for x in texts]
    assert np.allclose(quality_net.score_texts(net, whole), np.concatenate([quality_net.score_texts(net, t) for t in alone]), atol=1e-6)
    z = lambda t: quality_rules.logits(rules, t, tb.words(t), tb.SpanHash(t.data))
    assert np.allclose(z(whole), np.concatenate([z(t) for t in alone]), atol=1e-6)
