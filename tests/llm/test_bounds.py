"""Limits that decide, samples that stay bounded, and fits that see whole texts."""

import random

import numpy as np
import pytest

from boardlake.llm import decontamination, pii, quality, toxicity, url_filter
from boardlake.llm.common import Words, labelled_texts


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("most_words", [10**6, 20])
def test_the_length_limit_decides(spark, most_words):
    item, short = words(12, 1), words(4, 2)
    text = " ".join([*words(60, 3), *item, *words(40, 4), *short, *words(40, 5)])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", " ".join(short)), ("c", " ".join(words(15, 6)))], "item_id string, text string")

    def cleaned(least):
        return decontamination.remove_contamination(docs, bench, min_span_words=least, most_words=most_words).first().text

    assert " ".join(item) in cleaned(13) and " ".join(short) not in cleaned(13)
    assert " ".join(item) not in cleaned(12) and " ".join(short) not in cleaned(12)


def test_a_labelled_sample_is_bounded(spark):
    rows = [(1, "copy " * 50)] * 3000 + [(i, f"text {i}") for i in range(2, 60)] + [(2, f"other {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, y int")
    got = labelled_texts(docs, sample, 1000, 10**6).collect()
    assert len(got) == len(set(rows)) and max(r.doc_id for r in got) == 59
    assert len(labelled_texts(docs, sample, 40, 10**6).collect()) == 40
    some = labelled_texts(docs, sample, 1000, 500).collect()
    assert 0 < sum(len(r.text) for r in some) <= 500
    assert labelled_texts(docs.limit(0), sample, 10, 100).count() == 0


def test_copies_of_a_text_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(i, "mail a.b@example.com now") for i in range(2000)] + [(-1, "nothing")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "mail a.b@example.com now"), (2, "nothing")], "doc_id long, text string")
    a, b = pii.fit(docs), pii.fit(one)
    assert a.thresholds == b.thresholds and pii.fit(docs, most_examples=3).thresholds


def test_repeated_urls_are_one_row_of_the_fit(spark):
    rows = [("a.com", "/en/1", "block")] * 500 + [("b.net", f"/de/{i}", "allow") for i in range(300)]
    w, bias = url_filter.fit(spark.createDataFrame(rows, "host string, path string, verdict string"), most=100)
    texts = [b"^a.com\x01/en/1$", b"^b.net\x01/de/7$"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p = url_filter.probability((w, bias), np.frombuffer(b"".join(texts), np.uint8), offs)
    assert p[1] < 0.5


def test_quality_learns_from_passages_late_in_a_text(spark):
    r = random.Random(1)
    plain = [" ".join(words(64, k)) for k in range(20)]
    docs, labels = [], []
    for i in range(300):
        bad = i % 2
        passages = [r.choice(plain) for _ in range(90)]
        if bad:
            passages[80 + r.randint(0, 9)] = "!!! " * 64
        docs.append((i, " ".join(passages)))
        labels.append((i, 1 - bad))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, labels, label="quality")
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    right = sum((got[i] > 0.5) == (i % 2 == 0) for i in range(300))
    assert right > 285


def test_words_of_a_very_long_text():
    text = ("the quick brown fox jumps " * 80_000).encode()
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), stems=(3,))
    few = Words(np.frombuffer(text[:26], np.uint8), np.array([0, 26]), stems=(3,))
    assert len(w.hash) == 400_000 and (w.hash.reshape(-1, 5) == few.hash).all() and (w.stems[0].reshape(-1, 5) == few.stems[0]).all()


def test_scores_without_labels_are_nought(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-40 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())


def test_personal_data_in_a_very_long_text():
    parts = []
    for i in range(20_000):
        parts.append(f"so mail a{i}@b.com or token=Ab12cd34ef{i} at 10.0.{i % 250}.7 and " + "words " * 20)
    text = "".join(parts)
    model = pii.Model(sorted(x for i in range(0, 100_000, 500) for x in pii.examples(text[i : i + 500])))
    base, spans = model.spans(text)
    assert len(base) == 40_000 and len(spans) >= 59_000 and sorted(set(spans)) == sorted(spans)


def test_code_points_of_hits_in_a_long_text(spark):
    item = " ".join(words(12, 1))
    text = f"é日 {item} ü " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    r = decontamination.find_contamination(docs, bench).first()
    assert len(r.spans) == 3000 and all(text[s.start : s.end] == item for s in r.spans)
