"""Operator 4: URL filter: path rules, then logistic regression on hashed character n-grams of host and path.

A rule (host, path) fits its host and all subdomains when the URL's path starts with the rule's; the longest fitting rule
decides. URLs that no rule fits are judged by a classifier trained from a small labelled URL table, here the URLs that
rules decide: at most about ``MOST_FIT`` of them (a documented bound, taken by a hash of the URL).

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the
classifier; without labelled URLs, or with those of one verdict only, the classifier gives that verdict (``allow`` if
there are none); repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm.common import mix, only, table, text_slices

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BITS = 16
SIZES = (3, 4, 5)
MOST_FIT = 5000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def judged_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; rule and verdict are null where no rule fits."""
    host, path = parts(F.col("url"))
    df = only(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return df.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of each character n-gram that lies within one text."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    x = mix(data.astype(np.uint64) + _C[0])
    places, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in SIZES:
        if len(x) < n:
            continue
        h = sum((x[j : len(x) - n + 1 + j] * _C[j] for j in range(1, n)), x[: len(x) - n + 1] * np.uint64(2 * n + 1))
        within = row[: len(x) - n + 1] == row[n - 1 :]
        places.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int64)[within])
        rows.append(row[: len(x) - n + 1][within])
    return np.concatenate(places), np.concatenate(rows)


def _url_text(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^"), host, F.lit("\x01"), path, F.lit("$"))


def fit(labelled: DataFrame, most: int = MOST_FIT, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept from ``labelled`` (host, path, verdict), by full-batch logistic regression on a bounded sample of
    distinct texts, weighed by how often they come."""
    rows = labelled.filter("verdict is not null").select(_url_text(F.col("host"), F.col("path")).alias("text"), (F.col("verdict") == "block").cast("int").alias("y"))
    n = rows.agg(F.approx_count_distinct("text", 0.02)).first()[0]
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    got = sorted((r.text, r.y, r["count"]) for r in rows.groupBy("text", "y").count().toLocalIterator())
    weights = np.zeros(1 << BITS)
    y, times = np.array([v for _, v, _ in got], float), np.array([c for _, _, c in got], float)
    times /= max(1.0, times.sum())
    if not len(y) or y.min() == y.max():
        return weights, 35.0 if len(y) and y[0] else -35.0
    texts = [t.encode("utf-8", "surrogatepass") for t, _, _ in got]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place, row = ngrams(np.frombuffer(b"".join(texts), np.uint8), offs)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    bias, step = 0.0, np.full(1 << BITS, 1e-6)
    for _ in range(rounds):  # per-coordinate rates
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[place], minlength=len(y)) * scale + bias, -35, 35)))
        g = np.bincount(place, ((p - y) * times * scale)[row], minlength=1 << BITS) + 1e-5 * weights
        step += g * g
        weights -= 0.5 * g / np.sqrt(step)
        bias -= 0.5 * float(((p - y) * times).sum())
    return weights, bias


def probability(model: tuple[np.ndarray, float], data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    weights, bias = model
    place, row = ngrams(data, offs)
    n = len(offs) - 1
    total = np.bincount(row, weights[place], minlength=n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def classify(rows: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """``rows`` (page_id, host, path, rule, verdict) with the classifier's verdict where rules gave none, and its score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in text_slices(batch):
                p = probability(shared.value, data, offs)
                own = part.column("verdict").to_pylist()
                verdict = [v or ("block" if x >= threshold else "allow") for v, x in zip(own, p.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "host", "path", "rule")], pa.array(verdict), pa.array(p)], ["page_id", "host", "path", "rule", "verdict", "block_score"])

    return rows.withColumn("text", _url_text(F.col("host"), F.col("path"))).mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, block_score double")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every page judged. ``labelled``: a small table (url, verdict) to learn from; by default the pages that rules decide."""
    rows = judged_by_rules(pages, rules)
    if labelled is None:
        table_ = rows
    else:
        host, path = parts(F.col("url"))
        table_ = labelled.select(host.alias("host"), path.alias("path"), "verdict")
    return classify(rows, fit(table_))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
