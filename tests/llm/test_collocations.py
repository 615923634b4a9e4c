"""Operator 11 against a plain version: counts of all phrases, cuts, coverage and ranks."""

import random
import re
from collections import Counter

import pytest

from boardlake.llm import collocations
from boardlake.llm.collocations import collocations as mined

SCHEMA = "doc_id bigint, text string, lang string, extra string, TEXT_ string"


def plain(rows, most, least, covered):
    grams, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    grams.setdefault(lang, Counter())[tuple(ws[i : i + n])] += 1
    out = []
    for lang, f in grams.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def some(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "ßa", "a\x00b", "x", "y", "z", *[f"w{i}" for i in range(30)]]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " "]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        text = text + " new york city hall new york" * rng.randint(0, 2)
        rows.append((text, [None, "und", "en", "de"][i % 4]))
    return [*rows, (None, "en"), ("", "fr"), ("one", "fr"), *rows[:7]]


def result(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, g, "e", "c") for i, (t, g) in enumerate(rows)], SCHEMA).toDF("doc_id", "text", "lang", "extra", "TEXT").repartition(5)
    return sorted(tuple(r) for r in mined(df, **kw).collect())


@pytest.mark.parametrize(("most", "first"), [(4, 1), (25, 3), (2000, None)])
def test_equals_plain(spark, most, first):
    """Small first thresholds fall several times until a language is settled."""
    rows = some(most, 120)
    assert result(spark, rows, most=most, least=5, first_size=first) == plain(rows, most, 5, 50)


def test_blocks(spark, monkeypatch):
    """A text that takes many blocks, and one without any end of a piece."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 200)
    rng = random.Random(5)
    one = "".join(rng.choice("ab") + rng.choice([" ", " ", ". ", "\t"]) for _ in range(3000))
    rows = [(one, "en"), ("long run of words " * 400, "en"), ("q" * 1000, None)]
    got = [b for r in rows for b in _blocks(r)]
    assert len(got) > 15
    assert result(spark, rows) == plain(rows, 2000, 10, 50)


def _blocks(row):
    import pyarrow as pa

    return list(collocations._blocks(pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.string())], ["text", "lang"])))


def test_full_filter(spark, monkeypatch):
    """A filter that is far too small lets everything through; counts stay exact."""
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = some(9, 60)
    assert result(spark, rows, most=10, least=4, first_size=2) == plain(rows, 10, 4, 50)


def test_large_counts(spark):
    """Products beyond 64 bits are exact."""
    from pyspark.sql import functions as F

    cases = [(10**13 - 7, 10**14 - 3, 10**13 + 11), (987654321987, 987654321989, 999999999999999), (10, 10, 10)]
    got = spark.createDataFrame(cases, "a bigint, l bigint, r bigint").select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in cases]


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, None), ("", "en"), ("a b c", "en")]) == []


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
def test_query(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert sorted(tuple(r) for r in collocations.op11_collocations(spark, SF).collect()) == plain(rows, 2000, 10, 50)
