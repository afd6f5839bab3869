"""Whitening, fill-in-middle and token counts against plain versions."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from undula.llm import infill, queries, tokencount, whitening

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- whitening -----------------------------------------------------------------------------------------------------


def plain_whitening(vectors, most=8):
    """From whole numbers: exact sums, exact centred products, then one eigendecomposition."""
    x = [[int(np.floor(np.float64(c) * 1024)) + 100000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x)]
    apart = [[n * c - s for c, s in zip(v, total)] for v in x]
    a = np.array(apart, object)
    v = np.array([[float(s) for s in r] for r in a.T @ a]) / float(n) ** 3
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return n, [sum(c * c for c in r) for r in apart], (a.astype(float) / n) @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def test_whitening_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = plain_whitening([r.embedding for r in table])
    out = queries.op11_whitening(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = sorted(out.collect(), key=lambda r: (r.vec_id, r.component))
    assert len(rows) == 8 * len(table) and {r.n for r in rows} == {n}
    assert [r.deviation for r in rows[::8]] == deviation
    got = np.array([r.whitened for r in rows]).reshape(-1, 8)
    assert np.abs(got - white * np.sign((got * white).sum(0))).max() < 1e-9
    assert np.allclose([r.explained for r in rows[:8]], explained, rtol=1e-12)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_merged_moments_are_those_of_all_rows():
    rng = np.random.default_rng(1)
    x = whitening.whole(rng.normal(size=(300, 5)) * [1, 1, 10, 100, 1e6])
    parts = [whitening.moments(p) for p in np.split(x, [1, 2, 90, 91, 250])]
    one = parts[0]
    for p in parts[1:]:
        one = whitening.merge(one, p)
    a = x.astype(object) * len(x) - x.astype(object).sum(0)
    exact = (a.T @ a).astype(float) / len(x) ** 2
    assert one.n == 300 and [*one.total] == [*x.astype(object).sum(0)]
    assert np.allclose(one.scatter, exact, rtol=1e-12, atol=1e-12 * np.sqrt(np.outer(exact.diagonal(), exact.diagonal())).max())


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 7), (1, [0.5, 1.0], 7), (None, [-1.0, 2.0], 7), (2, None, 7), (3, [None, 1.0], 7), (4, [nan, 1.0], 7), (5, [1.0, -inf], 7), (6, [1.0], 7), (7, [], 7), (8, [0.25, -3.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, whitened int")
    model = whitening.fit(df, "v")
    out = sorted(whitening.whiten(df, model, "id", "v").collect(), key=str)
    n, deviation, white, _ = plain_whitening([r[1] for r in (rows[0], rows[1], rows[2], rows[9])])
    assert model.n == n == 4 and sorted(r.deviation for r in out) == sorted(deviation) and sorted(str(r.id) for r in out) == ["1", "1", "8", "None"]
    assert np.allclose(sorted(abs(r.whitened[0]) for r in out), sorted(abs(white[:, 0])), atol=1e-12)
    assert whitening.identity_error(df, model, "v") < 1e-12
    none = df.filter("id = 99")
    model = whitening.fit(none, "v")
    assert model.n == 0 and whitening.identity_error(none, model, "v") == 0 and whitening.whiten(none, model, "id", "v").count() == 0
    same = df.filter("id = 1")  # no variance at all
    model = whitening.fit(same, "v")
    assert [list(r.whitened) for r in whitening.whiten(same, model, "id", "v").collect()] == [[0, 0], [0, 0]] and model.explained == [0, 0]
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "id long, v array<double>")
    model = whitening.fit(huge, "v")
    assert [r.deviation for r in whitening.whiten(huge, model, "id", "v").collect()] == [None, None]


# --- fill-in-middle ------------------------------------------------------------------------------------------------


def plain_infill(doc_id, text):
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    u = UNITS.findall(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    spm = h4 % 100 < 80
    return len(u), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    bits = ["<", "P", ">", "S>", "<M", "<P>", "<S", " ", "\n", "\t\x0b", "\x1c", " ", "é", "😀", "word", "a", "́", "Σ", "\x00", "<<P", "ß"]
    return [None, "", " ", "x", "<P", "P>", " \n", "x ", *("".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(n))]


def test_infill_of_odd_texts(spark):
    texts = odd_texts()
    rows = [*((k, t) for k, t in enumerate(texts)), (None, "no id here"), (None, "no id here"), (900001, " ".join(["long"] * 60000) + "<")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, n string").repartition(3)
    out = infill.transform(df, "id", "text")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain_infill(i, t)) for i, t in rows), key=str)
    back = infill.restore(out)
    assert sorted(((r.id, r.restored) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert infill.restore(infill.transform(df.filter("id = -5"), "id", "text")).count() == 0


def test_infill_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {(i, *p[:4], sha(p[4]), sha(t)) for i, t in docs.items() for p in [plain_infill(i, t)]}
    assert {tuple(r) for r in queries.op12_infill(spark, sf).collect()} == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_pieces_of_any_length():
    source = np.frombuffer(bytes(range(256)) * 1000, np.uint8)
    start, length = np.array([0, 5, 100, 3, 0]), np.array([0, 70_000, 7, 0, 66_000])
    assert infill.gather(source, start, length).tobytes() == b"".join(source[a : a + n].tobytes() for a, n in zip(start, length))
    assert infill.gather(source, start[:0], length[:0]).size == 0


def test_restoring_needs_every_mark():
    raw = pa.array(["<P>a<S>b"], pa.large_string())
    with pytest.raises(ValueError):
        infill.rebuild(np.frombuffer(raw[0].as_py().encode(), np.uint8), np.array([0, 8]), np.array([1]))


# --- token counts --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, tokencount.prove(path)


@pytest.fixture(scope="module")
def library(words):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(words[0])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_of_odd_texts_equal_the_library(words, library, monkeypatch):
    c = tokencount.Counter(*words)
    rng = random.Random(5)
    bits = ["'s", "'", "S", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", " ", "\n", " ", " ", "\x1c", "\x85", "é", "é", "́", "Σ", "ΑΣ ", "İ", "ǅ", "K", "Å", "ﬁ", "①", "²", "1234", "٣", "漢字", "한국", "ᄒ", "ᅡ", "😀", "👩‍🔬", "\U000e0041", "ꟋꟌ", "Ᲊ", "hello", "World", "_", "\x00", "﻿", "...", "ß", "ẞ", "क्", "̈́"]
    monkeypatch.setattr(tokencount, "MEMORY", 50)
    for k in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 12)))
        monkeypatch.setattr(tokencount, "BLOCK", rng.choice([1, 3, 1 << 20]))
        assert c.count(text) == library(text), ascii(text)
    long = "".join(rng.choices("abcdefgh", k=30_000)) + " x" * 1000 + "!" * 5000
    assert c.count(long) == library(long)


def test_steady_characters_are_taken_as_the_library_takes_them(words):
    from tokenizers import Tokenizer

    c, t = tokencount.Counter(*words), Tokenizer.from_file(words[0])
    known = sorted(c.steady)
    assert len(known) > 40_000 and set(map(chr, range(0x20, 0x250))) - c.steady <= {"İ"} | {x for x in map(chr, range(0x20, 0x250)) if unicodedata.normalize("NFC", x) != x}
    for k in range(0, len(known), 500):
        text = "".join(f" q{x}{x}!{x}Q {x}7" for x in known[k : k + 500])
        pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        assert [p for p, _ in pieces] == [level.pre_tokenize_str(w)[0][0] for w in c.split(tokencount._lower(text))]
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(known, k=200))
        assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids)


def test_whole_words_are_one_token_and_the_rest_is_merged(words, library):
    c = tokencount.Counter(*words)
    assert len(c.known) > 30_000 and all(library(w) == 1 for w in list(c.known)[::50] if c.split(w) == [w])
    before = c.known.merged
    assert c.count("the cat and the dog") == 5 and c.known.merged == before
    assert c.count("qzxvkjw") == library("qzxvkjw") > 1 and c.known.merged == before + 1


def test_token_count_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r.doc_id, len((r.text or "").encode()), n, n > 2048) for r in docs for n in [library(r.text or "")]}
    assert {tuple(r) for r in queries.op13_token_counts(spark, sf).collect()} == want


def test_counts_of_odd_rows(spark, words, library):
    rows = [(None, "a b"), (1, None), (1, ""), (1, "same"), (1, "same"), (2, "😀 " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id int, text string, n_tokens int")
    out = tokencount.counts(df, "id", "text", *words[:1], limit=2048, proof=words[1])
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((i, len((t or "").encode()), n, n > 2048) for i, t in rows for n in [library(t or "")]), key=str)
    assert tokencount.counts(df.filter("id = 9"), "id", "text", *words[:1], proof=words[1]).count() == 0


# --- what stages leave ---------------------------------------------------------------------------------------------


def test_near_dedup_with_clashing_columns(spark, sf):
    from undula.llm import stages

    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "h i j k l m n"), (2, "a b c d e f g")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, __f0_0 int, __F1_0 int")
    out = stages.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns and sorted(r.text[0] for r in out.collect()) == ["a", "h"]


def test_the_pipeline_deletes_what_its_stages_made(spark, sf):
    import corpus_pipeline
    from undula.llm import _store

    mark = _store.made()
    out = corpus_pipeline.run(spark, sf)
    left = [d for d in _store._MADE[mark:] if "undula-decontaminate-" in d._undula_path]
    assert out.count() > 0 and len(left) == 1 and sum(d is not left[0] for d in _store._MADE[mark:]) <= 1
