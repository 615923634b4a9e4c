"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by its format statistics and by hashed word
features; a learnt layer embeds the code; gated attention (Ilse et al., 2018), a softmax over ``w . (tanh(V h) * sigmoid(U h))``,
weighs the passages; the weighted passage representation is scored. Only documents are labelled; the weights of passages
are learnt from those labels. All passages of a text take part, in fitting and in scoring.

The fit uses at most ``MOST_FIT`` distinct labelled rows of at most ``MOST_FIT_CHARS`` characters in all (documented bounds, by
a hash); what reaches the driver is the codes of all their passages, some 100,000. Scoring takes whole texts, too.

Defined cases: null and empty texts are one passage without words; rows with a null ``doc_id`` are scored and never
fitted; of several labels of one id the largest counts; with no labelled rows all scores are 0.5; repeated rows are
scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm.common import SPACED, Words, held_out_bucket, labelled_texts, only, table, text_slices
from boardlake.llm.toxicity import labelled_sample

PASSAGE = 64
MOST_FIT = 3000
MOST_FIT_CHARS = 40_000_000
HASHED = 32
STATS = 14
HIDDEN = 16
THRESHOLD = 0.7


def passage_codes(data: np.ndarray, offs: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): a row for each passage of a run of texts, and the first passage of each text."""
    w = Words(data, offs, SPACED)
    n_docs, n_words = len(offs) - 1, len(w.hash)
    per_doc = np.diff(w.doc)
    n_pass = np.maximum(1, -(-per_doc // size))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(first[-1])
    doc = np.repeat(np.arange(n_docs), per_doc)
    within = np.arange(n_words) - np.repeat(w.doc[:-1], per_doc)
    of = first[doc] + within // size  # passage of each word
    words = np.bincount(of, minlength=total).astype(float)
    at_least = np.maximum(words, 1)
    lens = (w.end - w.start).astype(float)
    byte_of = np.repeat(of, w.end - w.start)
    spot = np.repeat(w.start - np.concatenate([[0], np.cumsum(w.end - w.start)[:-1]]), w.end - w.start) + np.arange(len(byte_of))
    raw = data[spot]
    sums = lambda m: np.bincount(byte_of, m, minlength=total)
    size_b = np.maximum(sums(np.ones(len(raw))), 1)
    mean = np.bincount(of, lens, minlength=total) / at_least
    spread = np.sqrt(np.maximum(np.bincount(of, lens * lens, minlength=total) / at_least - mean**2, 0))
    same = np.zeros(n_words)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    pair = np.stack([of, (w.hash >> np.uint64(20)).astype(np.int64)], axis=1) if n_words else np.zeros((0, 2), np.int64)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    new = np.ones(n_words)
    if n_words:
        new[1:] = (pair[order][1:] != pair[order][:-1]).any(axis=1)
    distinct = np.bincount(pair[order][:, 0], new, minlength=total)
    end = data[w.end - 1] if n_words else np.zeros(0, np.uint8)
    head = data[w.start] if n_words else np.zeros(0, np.uint8)
    at = lambda m: np.bincount(of, m, minlength=total) / at_least
    stats = np.stack([
        np.log1p(words), mean / 10, spread / 10, distinct / at_least, np.bincount(of, same, minlength=total) / at_least,
        sums((raw >= 65) & (raw <= 90)) / size_b, sums((raw >= 48) & (raw <= 57)) / size_b, sums(raw == 33) / size_b,
        sums(((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))) / size_b,
        sums(raw >= 128) / size_b, at((end == 46) | (end == 63)), at(end == 33), at((head >= 65) & (head <= 90)), at(lens <= 1),
    ], axis=1)
    place = (w.hash >> np.uint64(40)).astype(np.int64)
    sign = np.where((w.hash & np.uint64(1)).astype(bool), 1.0, -1.0)
    hashed = np.bincount(of * HASHED + place % HASHED, sign, minlength=total * HASHED).reshape(total, HASHED) / np.sqrt(at_least)[:, None]
    return np.concatenate([stats, 0.2 * hashed], axis=1).astype(np.float32), first


class AttentionModel:
    """Passage encoder, gated attention and scorer; trained by Adam on whole bags."""

    NAMES = ("E", "e", "V", "U", "w", "c", "b")

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.p = {"E": g(inputs, hidden), "e": np.zeros(hidden), "V": g(hidden, hidden), "U": g(hidden, hidden), "w": g(hidden), "c": g(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray):
        p, of = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first[:-1])[of])
        a /= np.add.reduceat(a, first[:-1])[of]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30))), (x, h, t, s, a, z, of)

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, bags: int = 128, rate: float = 0.01, decay: float = 1e-3) -> AttentionModel:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        r = np.random.Generator(np.random.PCG64(11))
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), bags):
                pick = order[at : at + bags]
                sizes = first[pick + 1] - first[pick]
                cut = np.concatenate([[0], np.cumsum(sizes)])
                rows = np.repeat(first[pick] - cut[:-1], sizes) + np.arange(cut[-1])
                grads = self._gradients(x[rows], cut, y[pick])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x, first, y):
        prob, (x, h, t, s, a, z, of) = self.forward(x, first)
        p, d = self.p, (prob - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[of] * h).sum(axis=1)
        dlogit = a * (da - np.add.reduceat(a * da, first[:-1])[of])
        dt, ds = dlogit[:, None] * s * p["w"] * (1 - t * t), dlogit[:, None] * t * p["w"] * s * (1 - s)
        dh = a[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - h * h)
        return {"E": x.T @ dpre, "e": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dlogit, "c": z.T @ d, "b": np.array([d.sum()])}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in text_slices(batch):
            codes, first = passage_codes(data, offs)
            out = [codes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), pa.array(out, pa.binary())], ["doc_id", "y", "codes"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, label: str = "quality", usable: Column | None = None) -> AttentionModel | None:
    sample = labelled_sample(labels, label, most, usable)
    texts = labelled_texts(docs, sample, most, MOST_FIT_CHARS)
    rows = sorted((r.doc_id, r.y, bytes(r.codes)) for r in texts.mapInArrow(_encode, "doc_id bigint, y int, codes binary").toLocalIterator())
    if not rows:
        return None
    bags = [np.frombuffer(c, np.float32).reshape(-1, STATS + HASHED) for _, _, c in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    x, y = np.concatenate(bags).astype(float), np.array([v for _, v, _ in rows], float)
    return AttentionModel(STATS + HASHED).fit(x, first, y)


def score(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                if shared.value is None:
                    p = np.full(rows.num_rows, 0.5)
                else:
                    p = shared.value.forward(*passage_codes(data, offs))[0]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id bigint, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bucket = table(spark, sf_dir, "documents"), held_out_bucket(4)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), usable=bucket != 2))
    return scored.select("doc_id", (bucket == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
