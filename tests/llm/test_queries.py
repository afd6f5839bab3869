"""Whole queries of the smallest tables against plain versions, written from the definitions, row by row."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from undula.llm import decontaminate, flac, language, quality, queries, stages, toxicity
from undula.llm._arrow import utf8


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")


def held(ids, parts, part):
    return {i: zlib.crc32(str(i).encode()) % parts == part for i in ids}


# --- FLAC: a decoder and an encoder bit by bit ---------------------------------------------------------------------


def crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> bits - 1 else c << 1) & (1 << bits) - 1
    return c


class Bits:
    def __init__(self, data):
        self.s, self.at = bin(int.from_bytes(b"\x01" + data))[3:], 0

    def take(self, n, signed=False):
        v = int(self.s[self.at : self.at + n], 2) if n else 0
        self.at += n
        return v - (1 << n) if signed and n and v >> n - 1 else v

    def unary(self):
        end = self.s.index("1", self.at)
        n, self.at = end - self.at, end + 1
        return n


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def decode(data):
    """(samples, bytes of each frame) of an 8-bit mono stream, all checks by hand."""
    assert data[:4] == b"fLaC"
    at, last, total, md5 = 4, False, 0, b""
    while not last:
        head = struct.unpack_from(">I", data, at)[0]
        last, kind, size = head >> 31, head >> 24 & 127, head & 0xFFFFFF
        if kind == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            assert (packed >> 41 & 7, packed >> 36 & 31) == (0, 7)
            total, md5 = packed & (1 << 36) - 1, data[at + 22 : at + 38]
        at += 4 + size
    out, frames = [], []
    while at < len(data):
        b = Bits(data[at : at + 20000])
        assert b.take(14) == 0x3FFE and b.take(1) == 0
        variable, code, rate = b.take(1), b.take(4), b.take(4)
        assert b.take(4) == 0 and b.take(3) in (0, 1) and b.take(1) == 0
        first = b.take(8)
        ones = next((i for i in range(8) if not first >> (7 - i) & 1), 8)
        number = first if ones == 0 else first & (0x7F >> ones)
        for _ in range(max(0, ones - 1)):
            number = number << 6 | b.take(8) & 63
        n = b.take(8) + 1 if code == 6 else b.take(16) + 1 if code == 7 else 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
        assert rate not in (12, 13, 14)
        assert number == (len(out) if variable else len(frames))
        head = b.at // 8
        assert b.take(8) == crc(data[at : at + head], 7, 8)
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0
        if kind == 0:
            x = [b.take(8, True)] * n
        elif kind == 1:
            x = [b.take(8, True) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x, shift, coef = [b.take(8, True) for _ in range(order)], 0, FIXED.get(order)
            if kind >= 32:
                precision = b.take(4) + 1
                shift = b.take(5)
                coef = [b.take(precision, True) for _ in range(order)]
            wide = 4 + b.take(2)
            parts = b.take(4)
            for p in range(1 << parts):
                k = b.take(wide)
                raw = b.take(5) if k == (1 << wide) - 1 else None
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    if raw is not None:
                        r = b.take(raw, True)
                    else:
                        u = b.unary() << k
                        u |= b.take(k)
                        r = u >> 1 ^ -(u & 1)
                    x.append(r + (sum(c * v for c, v in zip(coef, reversed(x[len(x) - order :]))) >> shift if order else 0))
        b.at = -(-b.at // 8) * 8
        body = b.at // 8
        assert b.take(16) == crc(data[at : at + body], 0x8005, 16)
        frames.append(body + 2)
        out += x
        at += body + 2
    assert len(out) == total and hashlib.md5(bytes(v & 255 for v in out)).digest() == md5
    return out, frames


def put(v, n):
    return format(v & (1 << n) - 1, f"0{n}b") if n else ""


def frame(samples, number, kind, coef=(), precision=0, shift=0, parts=0, wide=4, escape=None):
    """A frame whose subframe is what the arguments say; ``escape``: width of raw residuals."""
    n, order = len(samples), len(coef)
    s = put(0, 1) + put(kind, 6) + put(0, 1) + "".join(put(v, 8) for v in samples[:order])
    if kind >= 32:
        s += put(precision - 1, 4) + put(shift, 5) + "".join(put(c, precision) for c in coef)
    s += put(wide - 4, 2) + put(parts, 4)
    res = [samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coef)) >> shift if order else 0) for i in range(order, n)]
    at = 0
    for p in range(1 << parts):
        own = res[at : at + (n >> parts) - (order if p == 0 else 0)]
        at += len(own)
        if escape is not None:
            s += put((1 << wide) - 1, wide) + put(escape, 5) + "".join(put(r, escape) for r in own)
            continue
        u = [r << 1 if r >= 0 else -2 * r - 1 for r in own]
        k = min(max(0, (max(u, default=0) // 8).bit_length()), (1 << wide) - 2)
        s += put(k, wide) + "".join("0" * (v >> k) + "1" + put(v, k) for v in u)
    body = int("1" + s + "0" * (-len(s) % 8), 2).to_bytes(-(-len(s) // 8) + 1, "big")[1:]
    head = bytes([0xFF, 0xF9, 0x74, 2]) + flac._number(number) + struct.pack(">H", n - 1)
    head += bytes([crc(head, 7, 8)])
    return head + body + struct.pack(">H", crc(head + body, 0x8005, 16))


def stream(cuts, frames):
    samples = [v for c in cuts for v in c]
    starts, offsets = np.cumsum([0, *map(len, cuts)]), np.cumsum([0, *map(len, frames)])
    table = b"".join(struct.pack(">QQH", int(a), int(o), len(c)) for a, o, c in zip(starts, offsets, cuts))
    sizes = list(map(len, cuts))
    info = struct.pack(">HH", min(sizes), max(sizes)) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(bytes(v & 255 for v in samples)).digest()
    return b"fLaC" + struct.pack(">I", 34) + info + struct.pack(">I", 0x83 << 24 | len(table)) + table + b"".join(frames)


@pytest.mark.parametrize("kind", ["fixed", "linear"])
def test_decoder_reads_every_order(kind):
    r = random.Random(1)
    for order in range(5) if kind == "fixed" else range(1, 33):
        cuts = [[r.randint(-128, 127) if r.random() < 0.2 else int(60 * np.sin(i / 5)) for i in range(n)] for n in (192, 64, 128)]
        frames, at = [], 0
        for f, c in enumerate(cuts):
            coef = FIXED[order] if kind == "fixed" else [r.randint(-7, 7) for _ in range(order)]
            frames.append(frame(c, at, (8 if kind == "fixed" else 31) + order, coef, 5, 0 if kind == "fixed" else 4, parts=f, wide=4 + f % 2, escape=12 if f == 2 and order % 2 else None))
            at += len(c)
        data = stream(cuts, frames)
        want = bytes(v + 128 for c in cuts for v in c)
        assert decode(data)[0] == [v for c in cuts for v in c]
        assert flac.decode([data, data]) == [want, want] and flac.read_at(data, 100, 150) == want[100:250]


def test_flac_query(spark, sf, docs):
    got = queries.op7_flac_media(spark, sf).toPandas().set_index("doc_id")
    media = {r.doc_id: bytes(r.media) for r in flac.store(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text").collect()}
    assert set(got.index) == set(docs.index) == set(media)
    for i, text in docs.text.items():
        raw = (text or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        s = np.frombuffer(pay, np.uint8).astype(int) - 128
        assert r.feature == f"rms={np.sqrt((s**2).mean()):.4f};zcr={((s[1:] < 0) != (s[:-1] < 0)).sum() / len(s):.5f};step={np.abs(np.diff(s)).mean():.4f}"
    for i in list(docs.index)[:60]:
        raw = (docs.text[i] or "").encode()
        samples, frames = decode(media[i])
        assert bytes(v + 128 for v in samples) == flac.pad(raw) and len(flac.open_stream(media[i])[2]) == len(frames)


# --- classifiers -----------------------------------------------------------------------------------------------------


def grams(text):
    """Buckets of a text's n-grams, one by one."""
    low = f" {(text or '').lower()} "
    c = [32 if ord(x) < 128 and not x.isalnum() else ord(x) for x in low]
    out = set()
    for n in toxicity.SIZES:
        for a in range(len(c) - n + 1):
            h = sum(v * int(toxicity._MUL[j + 1]) for j, v in enumerate(c[a : a + n])) % 2**64
            out.add(max(1, ((h ^ h >> 29) * int(toxicity._MUL[0]) % 2**64) >> 64 - toxicity.BITS))
    return out


def test_toxicity_query(spark, sf, docs):
    got = queries.op5_toxicity(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().dropna(subset=["toxic"]).set_index("doc_id").toxic
    out = held(docs.index, 4, 2)
    assert got.held_out.to_dict() == out
    learn = [i for i in labels.index if i in docs.index and not out[i]]
    own = {i: grams(t) for i, t in docs.text.items()}
    y = labels[learn].to_numpy(float)
    every = sorted({g for i in learn for g in own[i]})
    place = {g: k for k, g in enumerate(every)}
    x = np.zeros((len(learn), len(every)), np.float32)
    for row, i in enumerate(learn):
        x[row, [place[g] for g in own[i]]] = 1
    size = 1 << toxicity.BITS
    p, q = x[y == 1].sum(0) + 1.0, x[y == 0].sum(0) + 1.0
    absent = size - len(every)
    r = np.log(p / (p.sum() + absent)) - np.log(q / (q.sum() + absent))
    total = x.sum(0)
    worth = np.where(total >= toxicity.LEAST_DOCS, np.abs(r) * np.sqrt(total), 0)
    order = np.lexsort((every, -worth))[: toxicity.FEATURES]
    chosen = order[worth[order] > 0]
    z = (x[:, chosen] * r[chosen]).astype(float)
    weight = np.where(y > 0.5, toxicity.TOXIC_WEIGHT, 1.0) / len(y)
    m = toxicity.fit([docs.text[i] or "" for i in learn], y)
    w = np.array([m.weight[every[k]] for k in chosen]) / r[chosen]
    slope = (1 / (1 + np.exp(-(z @ w + m.bias))) - y) * weight
    start = (y.mean() - y) * weight
    grad, first = np.append(z.T @ slope + toxicity.RIDGE * w, slope.sum()), np.append(z.T @ start, start.sum())
    assert np.linalg.norm(grad) < 5e-3 * np.linalg.norm(first)  # the fit is at the least of the loss
    assert np.count_nonzero(m.weight) <= len(chosen)
    for i in docs.index:
        s = 1 / (1 + np.exp(-(sum(float(m.weight[g]) for g in own[i]) + m.bias)))
        assert got.score[i] == pytest.approx(s, abs=2e-4) and got.predicted[i] == (got.score[i] >= 0.3)


def plain_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    kinds = [sum(f(c) for c in raw) for f in (
        lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57,
        lambda c: c < 128 and not chr(c).isalnum() and chr(c) not in " \t\n\x0b\x0c\r,.'", lambda c: chr(c) in ",.'" and c < 128, lambda c: c == 32 or 9 <= c <= 13, lambda c: c >= 128)]
    sign = lambda c: c < 128 and not chr(c).isalnum() and chr(c) not in " \t\n\x0b\x0c\r,.'"
    sizes, n, w = [len(x) for x in words], max(len(raw), 1), max(len(words), 1)
    lines = raw.count(b"\n") + (len(raw) > 0)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(np.mean(sizes) if sizes else 0), np.log1p(np.std(sizes) if sizes else 0), *(k / n for k in kinds),
        sum(any(map(sign, x)) for x in words) / w, sum(sum(65 <= c <= 90 for c in x) >= 2 for x in words) / w, np.log1p(len(set(lower))) / np.log1p(w),
        sum(a == b for a, b in zip(lower, lower[1:])) / w, np.log1p(lines), np.log1p(len(raw) / max(lines, 1)),
    ]


def plain_quality(texts, labels):
    """Scores of ``texts`` by dense algebra from {id: label}: ridge, then isotonic levels by the max-min formula."""
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    ids = sorted(labels)
    a, y = np.array([x[i] for i in ids]), np.array([labels[i] for i in ids], float)
    mean, sd = a.mean(0), a.std(0)
    sd = np.where(sd > 1e-9, sd, 1)
    f = lambda v: quality.fourier((np.atleast_2d(v) - mean) / sd)
    h = f(a)
    ridge = np.eye(h.shape[1]) * quality.RIDGE * len(y) / quality.FEATURES
    ridge[-1, -1] = 1e-9 * len(y)
    w = np.linalg.solve(h.T @ h + ridge, h.T @ y)
    b = quality.bins(h @ w)
    full = sorted(set(b.tolist()))
    n, ones = np.array([(b == k).sum() for k in full]), np.array([y[b == k].sum() for k in full])
    level = [max(min(ones[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(full))) for j in range(i + 1)) for i in range(len(full))]
    at = lambda k: level[max(0, int(np.searchsorted(full, k, "right")) - 1)]
    return {i: at(int(quality.bins(f(v) @ w)[0])) for i, v in x.items()}


def test_quality_query(spark, sf, docs):
    got = queries.op6_quality(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().dropna(subset=["quality"]).set_index("doc_id").quality
    out = held(docs.index, 4, 2)
    assert got.held_out.to_dict() == out
    assert np.allclose(quality.statistics(*utf8(pa.array(docs.text.tolist()))), [plain_statistics(t) for t in docs.text])
    want = plain_quality(docs.text, {i: v for i, v in labels.items() if i in out and not out[i]})
    near = sum(got.score[i] == pytest.approx(want[i], abs=1e-9) for i in docs.index)
    assert near >= 0.99 * len(docs)  # a score at a bin's edge may round to the next one
    assert (got.predicted == (got.score >= 0.7)).all()


def plain_network(model, raw):
    """Mean log-probabilities over the windows of a text, filter by filter, place by place."""
    p = model.params
    logs = []
    for a in range(0, len(raw), language.WINDOW):
        x = list(raw[a : a + language.WINDOW])
        x += [0] * (language.WINDOW - len(x))
        h = []
        for w in language.WIDTHS:
            best = [max(float(np.concatenate([p["embed"][v] for v in x[s : s + w]]) @ p[f"w{w}"][:, f]) for s in range(language.WINDOW - w + 1)) for f in range(language.FILTERS)]
            h += [max(0.0, v + float(p[f"b{w}"][f])) for f, v in enumerate(best)]
        z = np.array(h) @ p["out"] + p["bias"]
        logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
    mean = np.mean(logs, 0)
    return np.exp(mean) / np.exp(mean).sum()


def test_language_query(spark, sf, docs):
    got = queries.op10_language_id(spark, sf).toPandas().set_index("doc_id")
    out = held(docs.index, 3, 1)
    assert got.held_out.to_dict() == out
    learn = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(*language.sample(learn, "doc_id", "text", "lang", ~toxicity.held_out("doc_id", 3, 1)))
    assert model.names == sorted({v for i, v in docs.lang.items() if v and not out[i]})
    short = sorted(docs.index, key=lambda i: len(docs.text[i] or ""))[:12]
    for i in docs.index:
        letters = any(c.isalpha() for c in docs.text[i] or "")
        assert (got.lang_pred[i] in model.names) == letters and 0 <= got.score[i] <= 1
    for i in short:
        if any(c.isalpha() for c in docs.text[i] or ""):
            q = plain_network(model, (docs.text[i] or "").encode()[:2000]) if len((docs.text[i] or "").encode()) <= 2000 else None
            if q is not None:
                assert got.lang_pred[i] == model.names[int(q.argmax())] and got.score[i] == pytest.approx(q.max(), abs=1e-4)
    known = [i for i in docs.index if docs.lang[i] and out[i] and len(docs.text[i] or "") > 200]
    assert np.mean([got.lang_pred[i] == docs.lang[i] for i in known]) > 0.95


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, sf, docs):
    """Which documents each stage drops, and every digest, by plain versions of the five stages."""
    import tiktoken

    import corpus_pipeline
    from test_operators import brute_components, brute_edits

    source = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().dropna(subset=["quality"]).set_index("doc_id").quality
    out = held(docs.index, 4, 2)
    score = plain_quality(docs.text, {i: v for i, v in labels.items() if i in out and not out[i]})
    left = [i for i in docs.index if score[i] >= stages.LEAST_QUALITY]
    kept = source.filter(source.doc_id.isin([int(i) for i in left]))
    assert sorted(r.doc_id for r in stages.quality_filter(spark, source, sf).collect()) == sorted(left)
    model = language.fit(*language.sample(kept, "doc_id", "text", "lang", ~toxicity.held_out("doc_id", 3, 1)))
    names, scores = language.judge(model, pa.array([docs.text[i] for i in left]))
    chance = 1 / len(model.names)
    left = [i for i, n, s in zip(left, names.to_pylist(), scores.to_pylist()) if n != "und" and s >= chance + stages.LEAST_LANGUAGE * (1 - chance)]
    comp, _ = brute_components(left, [docs.text[i] for i in left], 5, 80)
    left = [i for i in left if comp[i] == i]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text
    q = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    plain = lambda t: decontaminate.normalise(raw := np.frombuffer((t or "").encode(), np.uint8), np.array([0, len(raw)]))[0].tobytes()
    coded = [(t, q(plain(t))) for t in items]
    clean = [i for i in left if not any(g & q(plain(docs.text[i])) and brute_edits(docs.text[i], t) is not None for t, g in coded)]
    assert len(clean) < len(left) < len(docs)
    path, pattern = queries._vocabulary()
    from undula.llm.bpe import read_ranks

    tk = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    want = {}
    for i in clean:
        ids = tk.encode_ordinary(docs.text[i])
        want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs.text[i].encode()).hexdigest()
    assert got == want
