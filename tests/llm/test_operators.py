"""The operators against brute force, round trips and held-out rows, with odd inputs."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from undula.llm import _skew, bpe, chat, decontaminate, flac, language, minhash, quality, queries, sharding, shingles, stages, toxicity, warc
from undula.llm._arrow import slices, utf8
from undula.llm.shingles import shingle_sets

WORDS = "stone river light market window garden yellow paper engine winter letter bridge copper silver candle forest".split()
ODD = [None, "", " ", "\n\t", "a", "é", "🙂 ok", "x" * 20000, "word " * 5000, "the same", "the same"]


def say(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") + r.choice("klmnop") for _ in range(n))


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{i}", 0, "k", "v") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, score string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).union(frame(spark, ODD).filter("doc_id = 9")).union(frame(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))


# --- 1 sharding -------------------------------------------------------------------------------------------------


def test_shards_move_only_into_the_new_one(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    got = sharding.assign(df, "doc_id", {f"n{n}": sharding.build_tree(n) for n in (16, 17, 18)}).toPandas()
    for a, b, new in (("n16", "n17", 16), ("n17", "n18", 17)):
        moved = got[got[a] != got[b]]
        assert 0 < len(moved) < 4000 / 10 and set(moved[b]) == {new}
    assert got.n16.value_counts().min() > 4000 / 16 * 0.7


def test_weights_confine_movement_and_are_followed(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"))
    tree = sharding.build_tree(16)
    got = sharding.assign(df, "doc_id", {"a": tree, "b": sharding.reweight(tree, {3: 3.0}), "c": sharding.reweight(tree, {3: 0.0})}).toPandas()
    moved = got[got.a != got.b]
    assert set(moved.b) <= {0, 1, 2, 3}  # all within the region whose weight rose
    assert (got.c == 3).sum() == 0 and (got.b == 3).sum() > 1.5 * (got.a == 3).sum()


def test_slots_are_gapless_with_nulls_and_repeats(spark, odd):
    placed = sharding.assign(odd.select("doc_id", "text"), "doc_id", {"shard": sharding.build_tree(4)})
    got = sharding.number_slots(placed, "shard", "doc_id", buckets=3).toPandas()
    assert len(got) == len(ODD) + 2
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert sharding.number_slots(placed.limit(0), "shard", "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.assign(odd.withColumn("shard", F.lit(1)), "doc_id", {"shard": sharding.build_tree(4)})


def test_sharding_query(spark, sf):
    got, docs = queries.op1_sharding(spark, sf).toPandas(), spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(got) == len(docs)
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and (r.grown_shard in (r.shard, 16))


# --- 2 byte-level BPE -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path, pattern = queries._vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(spark, tokenizer):
    r = random.Random(0)
    chars = "ab '\n\t  \x1c\xa0 é9٣,.$sdSТß你🙂\r\x0b\x85"
    texts = ODD + ["a  's b", " 's", "don't we'll  ", "<|endoftext|>", "a" * 300, say(1, 80)]
    texts += ["".join(r.choice(chars) for _ in range(r.randint(1, 40))) for _ in range(300)]
    got = {x.doc_id: x for x in bpe.encode_decode(frame(spark, texts), "doc_id", "text", *queries._vocabulary()).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == tokenizer.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()


@pytest.mark.parametrize("n", [97, 1000, 20_000, 133_000, 1_000_000])
def test_long_pieces_equal_the_library(tokenizer, n):
    c, r = bpe.codec(*queries._vocabulary()), random.Random(n)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n)), "a" * n]
    texts += ["".join(r.choices("aehtio", k=n)), "abc" * (n // 3), "é" * (n // 2), "\n " * (n // 2), " " * n] if n < 10**6 else []
    ids, at = c.encode(*utf8(pa.array(texts)))
    for i, (t, raw) in enumerate(zip(texts, c.decode(ids, at))):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode_ordinary(t) and raw == t.encode()


def test_windows_without_a_common_token_are_joined(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "STRIDE", 3)
    monkeypatch.setattr(bpe, "SHORT_BYTES", 6)
    monkeypatch.setattr(bpe, "LONG_BYTES", 40)
    c, r = bpe.codec(*queries._vocabulary()), random.Random(1)
    for p in ("".join(r.choice("abcdefghij") for _ in range(400)), "ab" * 120, "é" * 90, "zzz" * 60, "abcdefg" * 30):
        assert c._stitched(p.encode()).tolist() == tokenizer.encode_ordinary(p)


def test_blocks_and_dropped_pieces_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 50)
    monkeypatch.setattr(bpe, "DECODE_IDS", 7)
    c, texts = bpe.codec(*queries._vocabulary()), [say(1, 60), "", "x" * 200 + " \u3000 y", " " * 130, None, "é\xa0 b \u2003 c"] * 2
    monkeypatch.setattr(c, "most", 1000)
    ids, at = c.encode(*utf8(pa.array(texts)))
    for i, (t, raw) in enumerate(zip(texts, c.decode(ids, at))):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode_ordinary(t or "") and raw == (t or "").encode()


def test_bpe_query(spark, sf, tokenizer):
    got = queries.op2_byte_bpe(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(got) == len(docs)
    for r in got.itertuples():
        ids = tokenizer.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_decode_by_ids(spark):
    path, pattern = queries._vocabulary()
    ids = bpe.encode_decode(frame(spark, ["héllo wörld", None, say(2, 20)]), "doc_id", "text", path, pattern).select("doc_id", F.when(F.col("doc_id") != 1, F.col("ids")).alias("ids"))
    got = {r.doc_id: r.decoded for r in bpe.decode(ids, "doc_id", "ids", path, pattern).collect()}
    assert bytes(got[0]) == "héllo wörld".encode() and got[1] is None
    with pytest.raises(ValueError):
        bpe.codec(path, pattern).decode(np.array([10**6]), np.array([0, 1]))


# --- 3 near-duplicates ------------------------------------------------------------------------------------------


def brute_components(ids, texts, width, percent):
    up = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in zip(ids, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                n = len(sets[i] & sets[j])
                if i != j and n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp, {i: len(s) for i, s in sets.items()}


def variants(seed, count, n, edits):
    r, base = random.Random(seed), say(seed, n).split()
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(n)] = f"x{r.random()}"
        out.append(" ".join(w))
    return out


def test_shingles_of_words():
    raw, off = utf8(pa.array(["A b\x0bc d e", "a B C D E", None, "x", "x x x x x x", "é\xa0f g"]))
    flat, at = shingle_sets(raw, off, 4)
    assert np.diff(at).tolist() == [2, 2, 0, 1, 1, 1] and (flat[:2] == flat[2:4]).all()


@pytest.mark.parametrize("small", [64, 4])
def test_components_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(_skew, "TOGETHER", 7)
    texts = [t for t in ODD if t is None or len(t) < 100] + variants(1, 60, 60, 6) + variants(2, 20, 120, 3) + [say(s, 50) for s in range(20)] + ["A b C d", "a B c D", "a b"]
    got = minhash.near_duplicates(frame(spark, texts), "doc_id", "text", 4, 80).toPandas().set_index("doc_id")
    comp, size = brute_components(range(len(texts)), texts, 4, 80)
    assert got.n_shingles.to_dict() == size and got.component_id.to_dict() == comp
    assert (got.kept == (got.component_id == got.index)).all()


def test_join_finds_all_pairs_under_the_distance():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**16, (300, 48))
    b = a.copy()
    for row in b:
        row[r.choice(48, minhash.MOST_ERRORS, replace=False)] ^= 1
    same = (a == b).reshape(300, minhash.CHUNKS, minhash.LANES).sum(2)
    assert (same.max(1) >= minhash.LANES - 1).all()


def test_near_duplicates_of_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd, "doc_id", "text").toPandas()
    assert len(got) == len(ODD) + 2 and got[got.doc_id == 10].component_id.tolist() == [9]
    assert minhash.near_duplicates(odd.limit(0), "doc_id", "text").count() == 0


# --- 4 WARC -----------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, html = "é" * 700, ["<p>1</p>", None, "", "x" * 999, "x" * 999]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate([*html, big, big, big, "z" * 3_000_000])] + [(None, None, "n")], "page_id long, url string, html string")
    got = warc.read(warc.write(pages, "page_id", "url", "html"), "page_id").toPandas().set_index("page_id")
    for i, h in enumerate([*html, big, big, big]):
        raw = (h or "").encode()
        r = got.loc[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, None if r.refers_to != r.refers_to else r.refers_to) == (("revisit", 7) if i in (5, 6) else ("response", None))
    assert len(got) == 10 and bytes(got.loc[7].payload) == big.encode()
    assert warc.read(warc.write(pages.limit(0), "page_id", "url", "html"), "page_id").count() == 0


def test_warc_of_frequent_pages_and_clashing_columns(spark, monkeypatch, tmp_path):
    import gzip

    monkeypatch.setattr(_skew, "TOGETHER", 5)
    big = [("y" if i % 3 else "z") * 1500 for i in range(60)] + ["w" * 2000, None, "s"]
    pages = spark.createDataFrame([(i, "u", h, "c", "d") for i, h in enumerate(big)], "page_id long, url string, html string, archive string, payload_digest string")
    archives = warc.write(pages, "page_id", "url", "html").cache()
    got = warc.read(archives, "page_id").toPandas().set_index("page_id")
    last = {h: max(i for i, x in enumerate(big) if x == h) for h in set(big)}
    for i, h in enumerate(big):
        want = last[h] if h and len(h) >= 1000 and last[h] != i else None
        assert (got.loc[i].record_type, None if got.loc[i].refers_to != got.loc[i].refers_to else got.loc[i].refers_to) == (("revisit", want) if want is not None else ("response", None))
    name = archives.first().archive
    warc.export(archives, name, str(tmp_path / "a.warc.gz"))
    assert gzip.open(tmp_path / "a.warc.gz").read().count(b"WARC/1.1\r\n") == warc.read(archives.filter(F.col("archive") == name), "page_id").count()


def test_warc_is_gzip_and_notices_damage():
    import gzip

    data = warc.record(warc.urn(-3), "u", b"hello" * 50) + warc.record(warc.urn(4), "v", b"")
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    for size in (1, 7, 1000):
        got = list(warc.read_records(io.BytesIO(data[i : i + size]).read() for i in range(0, len(data), size)))
        assert [warc.page_of(h["warc-record-id"]) for h, _ in got] == [-3, 4]
    with pytest.raises(warc.WarcError):
        list(warc.read_records([data[:-5]]))
    plain = gzip.decompress(warc.record(warc.urn(1), "u", b"hello")).replace(b"hello", b"jello")
    with pytest.raises(warc.WarcError):
        list(warc.read_records([gzip.compress(plain)]))


# --- 5, 6, 10 classifiers -----------------------------------------------------------------------------------------


def test_toxicity_learns_marked_words(spark, odd):
    texts = [say(i, 60) + (" foulword" if i % 3 == 0 else "") for i in range(240)]
    m = toxicity.fit(texts[:180], np.array([i % 3 == 0 for i in range(180)]))
    s = toxicity.score(m, texts[180:])
    assert ((s >= 0.3) == [i % 3 == 0 for i in range(180, 240)]).mean() > 0.95
    assert toxicity.score(toxicity.fit([], np.array([])), ["x", ""]).tolist() == [0.5, 0.5]
    got = toxicity.scores(odd, m, "doc_id", "text").toPandas()
    assert len(got) == len(ODD) + 2 and got.score.between(0, 1).all()
    assert toxicity.scores(odd.limit(0), m, "doc_id", "text").count() == 0


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(40)), *((i, 1) for i in range(1000, 5000))], "doc_id long, toxic int")
    texts, marks = toxicity.sample(docs, labels, "doc_id", "text", "toxic", rows=30)
    assert len(texts) == 30 and all(int(t.split()[1]) % 2 == m for t, m in zip(texts, marks))


def test_quality_learns_signs_from_text(spark, odd):
    texts = [say(i, 40) if i % 2 else say(i, 40).replace(" ", "$$$ ") for i in range(120)]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(120)] + [(5000, 1)], "doc_id long, quality int")
    m = quality.fit(quality.measure(docs, "doc_id", "text"), labels, "doc_id", "quality")
    got = quality.scores(quality.measure(docs.union(odd), "doc_id", "text"), m, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score[:120] >= 0.7) == [i % 2 for i in got.doc_id[:120]]).mean() > 0.95
    assert {r.doc_id for r in quality.keep(docs, m, "text", 0.7).collect()} == set(got[:120][got.score[:120] >= 0.7].doc_id)
    none = quality.fit(quality.measure(docs, "doc_id", "text"), labels.limit(0), "doc_id", "quality")
    assert quality.scores(quality.measure(odd, "doc_id", "text"), none, "doc_id").select("score").distinct().collect() == [(0.5,)]


def test_isotonic_levels():
    assert quality.isotonic(np.array([1, 1, 0, 2, 1]), np.array([0, 1, 0, 1, 1])).tolist() == pytest.approx([0, 2 / 3, 2 / 3, 2 / 3, 1])


def test_statistics_need_no_neighbours():
    texts = ["Ab, c 12!", "", None, "x\nx x"]
    whole = quality.statistics(*utf8(pa.array(texts)))
    assert np.allclose(whole, np.vstack([quality.statistics(*utf8(pa.array([t], pa.string()))) for t in texts]))


def test_language_of_two_alphabets(spark, odd):
    a, b = [say(i, 40) for i in range(60)], ["".join(random.Random(i).choices("éàçùôïëè ", k=200)) for i in range(60)]
    m = language.fit([t.encode() for t in a[:50] + b[:50]], ["x"] * 50 + ["y"] * 50)
    names, score = language.judge(m, pa.array(a[50:] + b[50:] + [None, "", "12 !", "🙂"]))
    assert names.to_pylist() == ["x"] * 10 + ["y"] * 10 + ["und"] * 4 and score.to_pylist()[20:] == [0] * 4
    got = language.identify(odd, m, "doc_id", "text").toPandas()
    assert len(got) == len(ODD) + 2 and got.score.between(0, 1).all()
    assert language.judge(language.fit([], []), pa.array(["abc"]))[0].to_pylist() == ["und"]


def test_network_gradient():
    r = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in language.start_params(3).items()}
    x, y = r.integers(0, 256, (4, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    g, _ = language.gradient(p, x, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), p[k].shape)
        old, ends = p[k][at], []
        for h in (1e-5, -1e-5):
            p[k][at] = old + h
            ends.append(-language.forward(p, x)[np.arange(4), y].mean())
        p[k][at] = old
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-3)


# --- 7 FLAC -----------------------------------------------------------------------------------------------------


def test_flac_round_trip_and_damage():
    r = random.Random(3)
    cases = [flac.pad(b""), flac.pad(bytes(64)), b"\x00\xff" * 320, bytes([127] * 63 + [255]) * 9, flac.pad(say(1, 300).encode())]
    cases += [flac.pad(r.randbytes(r.randint(0, 3000))) for _ in range(20)]
    streams = flac.encode(cases)
    assert flac.decode(streams) == cases and streams == [flac.encode([c])[0] for c in cases]
    assert flac.read_at(streams[4], 700, 600) == cases[4][700:1300] and flac.read_at(streams[4], 10**6, 5) == b""
    for _ in range(50):
        bad = bytearray(streams[4])
        bad[r.randrange(len(bad) - 600, len(bad))] ^= 1 << r.randrange(8)
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


def test_flac_columns(spark, odd):
    got = flac.load(flac.store(odd, "doc_id", "text"), "doc_id").toPandas()
    assert len(got) == len(ODD) + 2
    for r in got[got.doc_id.notna()].itertuples():
        raw = (ODD[int(r.doc_id)] or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.pcm) == flac.pad(raw) and sum(b["count"] for b in r.blocks) == len(r.pcm)
    assert flac.load(flac.store(odd.limit(0), "doc_id", "text"), "doc_id").count() == 0


# --- 8 chat -----------------------------------------------------------------------------------------------------


def test_escape_is_reversible_and_final():
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice(["a ", "\\", "<|im_end|>", "</s>", "[INST]", "\n", "%0A", "<", "|", "%"]) for _ in range(r.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and not chat._CONTROL.search(chat.escape(t)) and chat.unescape_role(chat.escape_role(t)) == t


@pytest.mark.parametrize("block", [3, 4096])
def test_windows_hold_each_turn_once(block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    r = random.Random(4)
    for _ in range(60):
        turns = [(r.choice(["user", "assistant", "system"]), say(r.random(), r.randint(0, 12))) for _ in range(r.randint(0, 30))]
        got, loss = [], ""
        system = turns[0][1] if turns and turns[0][0] == "system" else None
        for n, w in enumerate(chat.windows(turns, 60, 20)):
            own = chat.parse(w.text)
            assert system is None or own[0][:2] == ("system", system) and (not n or w.repeated)
            got += [(role, t) for role, t, _, _ in own[w.repeated :]]
            loss += "".join(chat.unescape(w.text[a:b]) for a, b in w.loss)
            if len(own) - w.repeated > 1:
                assert sum(chat.tokens(t) for _, t, _, _ in own) <= max(60, 40 + (0 if system is None else chat.tokens(system)))
        assert got == turns and loss == "".join(t for role, t in turns if role == "assistant")


def test_chat_digests_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi </s>"), (2, 0, None, "x"), (None, 0, "user", "n"), (3, 0, "assistant", "a\nb"), (3, 0, "assistant", "a\nb")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    got = chat.read_back(chat.format_windows(df, "conv_id", "turn", "role", "text"), "conv_id").toPandas().set_index("conv_id")
    assert got.loc[1].turns_sha256 == hashlib.sha256(b"user\nhi </s>\nassistant\n\n").hexdigest() and got.loc[1].loss_chars == 0
    assert got.loc[3].loss_sha256 == hashlib.sha256(b"a\nba\nb").hexdigest() and got.loc[3].n_turns == 2 and len(got) == 4
    assert chat.read_back(chat.format_windows(df.limit(0), "conv_id", "turn", "role", "text"), "conv_id").count() == 0


def test_chat_keeps_other_types_of_ids_and_large_system_turns(spark):
    rows = [("a", 0, "system", "word " * 3000), ("a", 1, "user", "hi"), ("a", 2, "assistant", "yo"), (None, 0, "assistant", "x")]
    made = chat.format_windows(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), "conv_id", "turn", "role", "text")
    assert all(r.formatted.count("word ") == 3000 for r in made.collect() if r.conv_id == "a")
    got = {r.conv_id: r for r in chat.read_back(made, "conv_id").collect()}
    assert got["a"].n_turns == 3 and got[None].loss_chars == 1 and got["a"].loss_sha256 == hashlib.sha256(b"yo").hexdigest()


@pytest.mark.parametrize("size", [100, 700, 768, 800, 1100, 5000])
def test_every_window_holds_the_system_turn(spark, size):
    turns = [(0, "system", "word " * size), *((n, "user" if n % 2 else "assistant", say(n, 40)) for n in range(1, 60))]
    df = spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn int, role string, text string")
    made = chat.format_windows(df, "conv_id", "turn", "role", "text")
    windows = [chat.parse(r.formatted) for r in made.collect()]
    assert len(windows) > 2 and all(w[0][:2] == ("system", "word " * size) for w in windows)
    assert all(sum(chat.tokens(t) for _, t, _, _ in w) <= max(chat.BUDGET, size + chat.TURN_TOKENS + 2 * chat.HISTORY) for w in windows)
    got = chat.read_back(made, "conv_id").first()
    assert got.n_turns == 60 and got.loss_sha256 == hashlib.sha256("".join(t for _, r, t in turns if r == "assistant").encode()).hexdigest()


def test_chat_query(spark, sf):
    got = queries.op8_chat_format(spark, sf).toPandas().set_index("conv_id")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    said = "</s>[INST] ok [/INST]"
    turns = {c: [(r.role or "", r.text or "") for r in g.sort_values("turn", kind="stable").itertuples()] for c, g in rows.groupby("conv_id")}
    turns[-1] = [("user", said), ("assistant", said)]
    assert set(got.index) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = got.loc[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss)) and r.formatted_chars > sum(len(t) for _, t in own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- 9 decontamination ------------------------------------------------------------------------------------------


def test_leaks_with_edits_are_found(spark, odd):
    r = random.Random(5)
    items = [say(1000 + i, 12 + i) for i in range(20)] + ["brevity", None]

    def edit(t, n):
        t = list(t)
        for _ in range(n):
            at, how = r.randrange(len(t)), r.random()
            t[at : at + (how < 0.7)] = "q" if how < 0.4 else "zz" if how > 0.7 else ""
        return "".join(t)

    leaks = [say(i, 40) + "\n " + edit(items[i % 20], int(0.04 * len(items[i % 20]))).upper() + "!! " + say(i + 99, 30) for i in range(40)]
    clean = [say(5000 + i, 80) for i in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, leaks + clean)
    got = {(m.doc_id, m.item_id): m for m in decontaminate.matches(docs, bench, "doc_id", "text", "item_id", "text").collect()}
    assert set(got) == {(i, i % 20) for i in range(40)}
    m = got[3, 3]
    assert items[3][:6].upper() in leaks[3].encode()[m.start : m.end].decode() or m.edits > 0
    assert {d.doc_id for d in decontaminate.keep(docs, bench, "text", "item_id", "text").collect()} == set(range(40, 80))
    assert decontaminate.matches(odd, bench, "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.matches(odd, bench.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.keep(docs.limit(0), bench, "text", "item_id", "text").count() == 0


def brute_edits(text, item):
    """The fewest edits over all places if they are within the budget, by the plain recurrence over normalised bytes."""
    plain = lambda t: decontaminate.normalise(raw := np.frombuffer(t.encode(), np.uint8), np.array([0, len(raw)]))[0].tobytes()
    t, i = plain(text), plain(item).lstrip(b" ")
    if len(i) < decontaminate.Q:
        return 0 if i and b" " + i + b" " in b" " + t + b" " else None
    budget, j = min(len(i) // 10, (len(i) - 8) // 8), np.arange(len(t) + 1)
    row, chars = np.zeros(len(t) + 1, int), np.frombuffer(t, np.uint8)
    for n, c in enumerate(i, 1):
        row = np.minimum.accumulate(np.concatenate(([n], np.minimum(row[:-1] + (chars != c), row[1:] + 1))) - j) + j
    return int(row.min()) if row.min() <= budget else None


@pytest.mark.parametrize("lot", [40, 1 << 18])
def test_search_equals_all_places(lot, monkeypatch):
    monkeypatch.setattr(decontaminate, "LOT", lot)
    monkeypatch.setattr(decontaminate, "HITS", lot)
    r = random.Random(8)

    def edit(t, n):
        t = list(t)
        for _ in range(n):
            at, how = r.randrange(len(t)), r.random()
            t[at : at + (how < 0.7)] = "q" if how < 0.4 else "zz" if how > 0.7 else ""
        return "".join(t)

    for trial in range(12):
        items = [say(100 * trial + i, n) for i, n in enumerate((1, 1, 2, 3, 5, 9, 40, 90))] + ["a", "42", "yes no", "?!", "a" * 30, "ab" * 40, "twenty bytes of text", None]
        texts = [None, "", "a" * 300, "ab" * 200, "Yes -- no", "42", "x 42y", "all: Twenty bytes, of text!"]
        for _ in range(14):
            own = r.choice([i for i in items if i])
            texts.append(say(r.random(), r.randint(0, 6)) + r.choice([" ", "", "\n- "]) + edit(own, r.randint(0, len(own) // 8 + 1)) + r.choice([" ", "!! "]) + say(r.random(), 3))
        index = decontaminate.build(items)
        got = {(t, i): (e, a, b) for t, i, e, a, b in decontaminate.search(index, *utf8(pa.array(texts, pa.string())))}
        want = {(t, i): e for t, x in enumerate(texts) for i, y in enumerate(items) if (e := brute_edits(x or "", y or "")) is not None}
        assert {k: v[0] for k, v in got.items()} == want
        for (t, i), (e, a, b) in got.items():
            if not e:
                assert brute_edits(texts[t].encode()[a:b].decode(), items[i]) == 0


def test_whole_items_have_the_budget_however_long():
    item = say(3, 110)
    for part, found in ((item, True), (item[: len(item) - len(item) // 12], True), (item[:160], False), (item[: len(item) // 2], False)):
        assert bool(decontaminate.search(decontaminate.build([item]), *utf8(pa.array([say(1, 20) + " " + part + " " + say(2, 20)])))) == found


def test_blocks_of_a_benchmark_find_the_same(spark, sf, monkeypatch):
    bench, docs = spark.read.parquet(f"{sf}/benchmark.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    find = lambda: sorted(map(tuple, decontaminate.matches(docs, bench, "doc_id", "text", "item_id", "text").collect()))
    clean = lambda: sorted(r.doc_id for r in decontaminate.keep(docs, bench, "text", "item_id", "text").collect())
    one, kept = find(), clean()
    texts, items = docs.toPandas().set_index("doc_id").text, bench.toPandas().set_index("item_id").text
    assert one and set(kept) == set(texts.index) - {m[0] for m in one}
    for d, i, e, _, _ in one:
        assert brute_edits(texts[d], items[i]) == e
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2_000)
    assert len(decontaminate.blocks(bench, "item_id", "text")) > 1 and find() == one and clean() == kept


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_slices_keep_all_rows():
    batch = pa.record_batch([pa.array(range(50)), pa.array([None if i % 7 == 0 else "x" * i for i in range(50)])], ["a", "b"])
    parts = list(slices([batch, batch.slice(0, 0), batch.slice(10, 5)], 1, 40))
    assert pa.Table.from_batches(parts).num_rows == 55


def test_samples_are_bounded_and_the_least_by_hash(spark):
    from undula.llm._sample import drawn

    rows = spark.range(3000).selectExpr("id % 500 as key", "if(id < 1500, concat('t', id % 500), 'same') as text", "cast(id % 2 as int) as label")
    order = [r.key for r in rows.select("key").distinct().orderBy(F.xxhash64("key")).collect()]
    kinds = {(f"t{k}", k % 2) for k in range(500)} | {("same", 0), ("same", 1)}
    for most in (1, 7, 40, 5000):
        got = drawn(rows, most, 1 << 20)
        assert len(got) == min(most, 1000) and set(got) <= kinds
        assert {t for t, _ in got if t != "same"} >= {f"t{k}" for k in order[: most // 2]} and not {t for t, _ in got} - {"same", *(f"t{k}" for k in order[: most // 2 + 1])}
    assert len(drawn(rows, 100, 10)) < 5 and len(drawn(rows, 100, 0)) == 1 and drawn(rows.limit(0), 5, 5) == []


def test_stages_keep_columns_and_odd_rows(spark, sf):
    docs = frame(spark, ODD + [say(1, 60), say(1, 60)], extra=False).union(frame(spark, ["null id"], extra=False).withColumn("doc_id", F.lit(None).cast("long")))
    for stage in (stages.quality_filter, stages.language_filter, stages.near_dedup, stages.decontaminate_filter):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = {r.doc_id for r in stages.near_dedup(spark, docs, sf).collect()}
    assert 11 in kept and 12 not in kept and None in kept


def test_near_dedup_keeps_other_texts_of_an_id(spark, sf):
    a, b, c = say(1, 60), say(2, 60), say(3, 60)
    rows = [(1, a), (1, b), (2, a), (3, c), (4, c), (4, b), (5, None), (5, ""), (6, b), (1, b), (1, a.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, (r.text or "").lower()) for r in stages.near_dedup(spark, docs, sf).collect())
    assert got == sorted([(1, a), (1, b), (3, c), (5, "")])


def test_near_dedup_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = docs.toPandas().set_index("doc_id").text
    comp, _ = brute_components(list(texts.index), list(texts), 5, 80)
    assert {r.doc_id for r in stages.near_dedup(spark, docs, sf).collect()} == {i for i, c in comp.items() if i == c}


def test_long_texts_in_small_blocks_change_nothing(monkeypatch):
    texts = [say(1, 300), None, "", "x" * 5000, "a b\nc " * 200, "é ü\u3000" * 90, "end"]
    model = toxicity.fit([say(i, 30) + " foulword" * (i % 3 == 0) for i in range(60)], np.arange(60) % 3 == 0)
    names = language.fit([say(i, 30).encode() for i in range(10)] + ["éàçù".encode() * 9] * 10, ["a"] * 10 + ["b"] * 10)
    tones = [flac.pad((t or "").encode()) for t in texts]

    def all_():
        u = utf8(pa.array(texts))
        yield [x.tolist() for x in shingle_sets(*u, 4)]
        yield quality.statistics(*u).tolist()
        yield toxicity.score(model, [t or "" for t in texts]).tolist()
        yield [x.round(5).tolist() for x in language.predict(names, *u)]
        yield flac.encode(tones), flac.decode(flac.encode(tones)), [flac.feature(t) for t in tones]

    whole = list(all_())
    for module, name, value in ((shingles, "BLOCK", 37), (quality, "BLOCK", 41), (toxicity, "PART", 50), (language, "BLOCK", 3), (flac, "SLICE_BYTES", 700)):
        monkeypatch.setattr(module, name, value)
    assert list(all_()) == whole


def test_pipeline_tokens_equal_the_library(spark, sf, tokenizer):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    assert 0 < len(got) < len(docs)
    for r in got.head(40).itertuples():
        ids = tokenizer.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
