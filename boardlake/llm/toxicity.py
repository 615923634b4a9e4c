"""Operator 3: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, the words' first four to six bytes (inflected and misspelt forms share them), bigrams and skip-grams of a
text, hashed to ``2^BITS`` places; each counts once a text. Training follows McMahan et al. (2013): every coordinate has
its own rate, and L1 keeps most weights at zero, so the model is a small broadcast: at most ``2^BITS`` places.

The fit uses at most ``MOST_FIT`` distinct labelled rows of at most ``MOST_FIT_CHARS`` characters in all (documented bounds,
taken by a hash); their texts and all scored ones are whole. Texts of the fit are hashed to features where they are; one
task receives the bounded sample.

Defined cases: null and empty texts get the score of a text without words (the intercept); rows with a null ``doc_id``
are scored and never fitted; rows whose label is null are not fitted; of several labels of one id the largest counts;
with no labelled rows all scores are 0.0 (below 1e-40); other columns are ignored or, in ``drop_toxic``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlake.llm.common import Words, held_out_bucket, labelled_texts, mix, only, table, text_slices

BITS = 20
MOST_FIT = 8000
MOST_FIT_CHARS = 64_000_000
THRESHOLD = 0.5
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.0, 4
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]
#: Bytes of a word that its stems keep.
STEMS = (4, 5, 6)


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every feature occurrence of a run of texts; place 0 is kept for the intercept."""
    w = Words(data, offs, stems=STEMS)
    h = w.hash
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(w.doc))
    found = [(h, doc), *[(x, doc) for x in w.stems]]
    for gap in (1, 2):  # bigrams, and skip-grams over one word
        within = doc[:-gap] == doc[gap:]
        found.append(((h[:-gap] * _SALT[-gap] + h[gap:])[within], doc[:-gap][within]))
    places = [(mix(x ^ salt) >> np.uint64(64 - bits)).astype(np.int64) for (x, _), salt in zip(found, _SALT, strict=True)]
    docs = [d for _, d in found]
    place = np.concatenate(places)
    return np.where(place == 0, 1, place), np.concatenate(docs)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in text_slices(batch):
            place, doc = features(data, offs)
            key = np.unique((doc << BITS) | place)
            cut = np.searchsorted(key, np.arange(rows.num_rows + 1) << BITS)
            place = (key & ((1 << BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), pa.array([place[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "y", "places"])


def _fit(alpha: float, beta: float, l1: float, l2: float, epochs: int, bits: int):
    """FTRL-proximal over the rows of a task, in order of a hash; gives one row: places and weights that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, p) for b in batches for i, y, p in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        rows.sort(key=lambda r: (int(mix(np.array([r[0] & (2**63 - 1)], np.uint64))[0]), r[2]))
        z, n = np.zeros(1 << bits), np.zeros(1 << bits)

        def weight(at):
            zi = z[at]
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

        for _ in range(epochs):
            for _, y, places in rows:
                at = np.concatenate([[0], np.frombuffer(places, "<u4")])
                w = weight(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                n2 = n[at] + g * g
                z[at] += g - (np.sqrt(n2) - np.sqrt(n[at])) / alpha * w
                n[at] = n2
        w = weight(np.arange(1 << bits)) if rows else np.zeros(0)
        at = np.flatnonzero(w)
        if not rows:
            at, w = np.zeros(1, np.int64), np.array([-99.0])
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()]), pa.array([w[at].astype("<f4").tobytes()])], ["places", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, label: str = "toxic", usable: Column | None = None, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by place (place 0: the intercept). ``usable`` picks the labelled ids that may be learnt from."""
    sample = labelled_sample(labels, label, most, usable)
    rows = labelled_texts(docs, sample, most, MOST_FIT_CHARS).mapInArrow(_hash_rows, "doc_id bigint, y int, places binary")
    model = rows.repartition(1).mapInArrow(_fit(ALPHA, BETA, L1, L2, epochs, BITS), "places binary, weights binary").first()
    w = np.zeros(1 << BITS, np.float32)
    if model is None:
        w[0] = -99.0
    else:
        w[np.frombuffer(model.places, "<u4")] = np.frombuffer(model.weights, "<f4")
    return w


def labelled_sample(labels: DataFrame, label: str, most: int, usable: Column | None = None) -> DataFrame:
    """(doc_id, y): about ``most`` labelled ids at most, by a hash of the id; so few that they can be broadcast."""
    own = only(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    if usable is not None:
        own = own.filter(usable)
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = own.count()
    return own if n <= most else own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))


def score_texts(weights: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    place, doc = features(data, offs)
    near = weights[place] != 0
    key = np.unique((doc[near] << BITS) | place[near])
    total = np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], minlength=len(offs) - 1) + float(weights[0])
    return 1 / (1 + np.exp(-np.maximum(total, -700)))


def _score_with(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                own = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in own], pa.array(score_texts(shared.value, data, offs))], [*own, "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_score_with(docs.sparkSession.sparkContext.broadcast(weights)), "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; columns and their order stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            keep = [score_texts(shared.value, data, offs) < threshold for _, data, offs in text_slices(plain)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), held_out_bucket(5) == 0
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), usable=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
