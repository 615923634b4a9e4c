"""The registered queries themselves against their contracts, on the smallest tables, by plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boardlake.llm import packing, toxicity, url_filter
from boardlake.llm.common import text_slices
from boardlake.llm.queries import QUERIES
from boardlake.llm.tokens import TokenIds, public_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """(doc_id, text) of all documents."""
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    df = QUERIES[name](spark, SF)
    return dict(df.dtypes), df.collect()


def test_op1_digests(spark, rows):
    types, out = run(spark, "op1_decontamination")
    assert types == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    items = [(r.item_id, word.findall(lower(r.text or ""))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    for i, w in items:
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in out}
    for doc_id, text in rows:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def plain_base(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split(".")))]
    kinds += [("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)]
    for order, (kind, pattern, holds) in enumerate(kinds):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if holds(m.group())]
    return [s for _, _, s in sorted(out)]


def test_op2_spans(spark, rows):
    types, out = run(spark, "op2_pii")
    assert [types[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")] == ["bigint"] * 5 and types["base_sha256"] == types["spans"] == "string"
    got = {r.doc_id: r for r in out}
    for doc_id, text in rows:
        base, r = plain_base(text), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in base) for k in ("email", "ip", "card", "phone"))
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        order = {"email": 0, "ip": 1, "card": 2, "phone": 3, "secret": 4}
        keys = [(int(s.split(":")[1]), order[s.split(":")[0]]) for s in spans]
        assert keys == sorted(keys) and all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(text) for s in spans)


@pytest.mark.parametrize("name, mod, rest, threshold", [("op3_toxicity", 5, 0, 0.5), ("op10_quality", 4, 2, 0.7)])
def test_op3_op10_scores(spark, rows, name, mod, rest, threshold):
    types, out = run(spark, name)
    assert types == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} and len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_op4_rules(spark):
    _, out = run(spark, "op4_url_filter")
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(out) == len(urls)
    for r in out:
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_op5_sequences(spark, rows):
    _, out = run(spark, "op5_packing")
    enc = TokenIds(public_path("word_bpe_49k.json"))
    want = {}
    for doc_id, text in rows:
        ids = np.append(np.frombuffer(enc.whole(text), "<u4"), 0).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc_id, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(x[1] for x in want.values()) // 2048) + 1


def test_op6_op9_ids(spark, rows):
    enc, plain = TokenIds(public_path("byte_bpe_50k.json")), TokenIds(public_path("byte_bpe_50k.json"), plain=True)
    start, want = 0, {}
    for doc_id, text in sorted(rows):
        ids = np.append(np.frombuffer(enc.whole(text), "<u4"), 2).astype("<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op6_token_files")[1]} == want
    assert {r.doc_id: r.n_tokens for r in run(spark, "op9_token_counts")[1]} == {i: len(plain.whole(t)) // 4 for i, t in rows}


def test_op7_edited_texts(spark, rows):
    _, out = run(spark, "op7_order_minhash")
    got, order = {r.doc_id: r for r in out}, sorted(rows, reverse=True)
    for k, (doc_id, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for i, t in rows:
        prints.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_op8_components(spark, rows):
    _, out = run(spark, "op8_simhash")
    fps = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c.group().lower(), text))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{f:016x}", find(i)) for i, f in fps.items()}


# --- the learners against plain ones -------------------------------------------------------------


def test_ftrl_is_the_plain_one():
    import pyarrow as pa

    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["red", "green", "blue", "bad", "awful", "fine"], 12)) for _ in range(200)]
    y = [int("awful" in t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(y, pa.int32()), pa.array(texts)], ["doc_id", "y", "text"])
    feats = list(toxicity._hash_rows(iter([batch])))
    model = next(toxicity._fit(1.0, 1.0, 0.5, 0.1, 2, toxicity.BITS)(iter(feats)))
    got = dict(zip(np.frombuffer(model.column(0)[0].as_py(), "<u4").tolist(), np.frombuffer(model.column(1)[0].as_py(), "<f4").tolist(), strict=True))
    order = sorted(range(200), key=lambda i: int(toxicity.mix(np.array([i], np.uint64))[0]))
    own = {}
    for _, data, offs in text_slices(batch):
        place, doc = toxicity.features(data, offs)
        for p, d in zip(place.tolist(), doc.tolist(), strict=True):
            own.setdefault(d, set()).add(p)
    z, n = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= 0.5 else -(v - np.sign(v) * 0.5) / (1.0 + np.sqrt(n.get(i, 0.0)) + 0.1)

    for _ in range(2):
        for d in order:
            places = [0, *own[d]]
            w = {i: weight(i) for i in places}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[d]
            for i in places:
                was = n.get(i, 0.0)
                n[i] = was + g * g
                z[i] = z.get(i, 0.0) + g - (np.sqrt(n[i]) - np.sqrt(was)) * w[i]
    want = {i: w for i in z if (w := weight(i))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_url_weights_follow_the_gradient(spark):
    rows = [(f"a{i % 7}.com", f"/ads/{i}", "block") for i in range(60)] + [(f"b{i % 5}.org", f"/news/{i}", "allow") for i in range(90)]
    labelled = spark.createDataFrame(rows, "host string, path string, verdict string")
    w, bias = url_filter.fit(labelled, rounds=400)

    def loss(w, bias):
        texts = [f"^{h}\x01{p}$".encode() for h, p, _ in rows]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        p = url_filter.probability((w, bias), np.frombuffer(b"".join(texts), np.uint8), offs)
        y = np.array([v == "block" for _, _, v in rows])
        return -np.log(np.where(y, p, 1 - p)).mean() + 0.5e-5 * (w * w).sum()

    base = loss(w, bias)
    assert base < 0.05
    r = np.random.default_rng(1)
    for _ in range(5):  # no small step away from the origin's side makes it much better
        step = np.where(w != 0, r.normal(0, 0.01, len(w)), 0)
        assert loss(w + step, bias) > base - 0.005


@pytest.mark.parametrize("seed", range(12))
def test_small_plans_are_near_the_optimum(seed):
    r = np.random.default_rng(seed)
    capacity, lengths = 10, sorted(r.integers(1, 11, 9).tolist(), reverse=True)

    def fits(bins, left):
        if not left:
            return True
        tried = set()
        for i, b in enumerate(bins):
            if b >= left[0] and b not in tried:
                tried.add(b)
                if fits(bins[:i] + [b - left[0]] + bins[i + 1 :], left[1:]):
                    return True
        return False

    least = next(n for n in range(1, 10) if fits([capacity] * n, lengths))
    used = sum(n for _, n in packing.plan(np.bincount(lengths, minlength=capacity + 1), capacity))
    assert least <= used <= least + (1 if least > 3 else 0)


def test_labels_of_a_row_are_no_inputs(spark):
    """The same text scores the same, whatever its id, language and source."""
    docs = spark.createDataFrame([(i, "some words here", "en" if i % 2 else "de", str(i)) for i in range(6)], "doc_id long, text string, lang string, source string")
    w = np.zeros(1 << toxicity.BITS, np.float32)
    w[0] = 0.3
    assert toxicity.score(docs, w).select(F.count_distinct("score")).first()[0] == 1
