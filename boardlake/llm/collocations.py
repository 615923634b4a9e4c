"""Operator 11: phrase collocations, by best-first branch-and-bound growth.

Words are grown to phrases of two and three words. A node of the search is a counted prefix, and its count bounds what can grow
from it: no phrase that begins with the words ``x y`` scores above f(x y) / f(x), as its first cut already says. The nodes whose
bound (or own score) reaches a language's threshold are the frontier; it is expanded by counting, over the whole corpus, the
phrases that begin with one of its nodes, and those that decide whether one of them survives. A language is settled once as many
phrases as asked for, with all ties, survive at or above its threshold, or nothing is left below it. Otherwise its threshold
falls to a frontier of four times the size. The first threshold takes twice as many two-word phrases as are asked for.

A level that is not frequent enough cannot grow: only frequent words are joined to pairs, only frequent pairs to triples. Tasks know
the frontier from a Bloom filter of at most ``MOST_BITS`` bits, whatever the corpus; what it lets through wrongly is counted
exactly all the same. Texts are cut and counted in numpy, block by block, and the counts are summed by Spark by the words
themselves, so no hash decides a result. Products are decimals of 38 digits, enough for counts below 10^15 (beyond: an error).

Defined cases: null text is empty; null ``lang`` is ``und`` (one language with rows that say so); repeated rows count as often as
they occur; equal scores rank by count, then phrase; an empty table gives no rows; texts of any length are taken in blocks that
end where a piece ends; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.llm.common import _hashed, materialize, mix, only, table, text_slices

MOST = 2000
LEAST = 10
#: A phrase goes if a longer candidate that holds it has so many per cent of its count.
COVERED = 50
SCALE = 1_000_000
BLOCK_BYTES = 2 << 20
MOST_BITS = 1 << 27
_PROBES = 4

_BREAK, _SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CLASS = np.array([2 if b in _BREAK else 1 if b in _SPACE else 0 for b in range(256)], np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EDGE, _OWN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


# --- words of a block ---------------------------------------------------------------------------


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch in blocks; a longer text in several blocks, cut at ends of pieces."""
    for rows, data, offs in text_slices(batch, "text", BLOCK_BYTES):
        if rows.num_rows > 1 or len(data) <= BLOCK_BYTES:
            yield rows, data, offs
            continue
        at = 0
        while at < len(data):
            to = min(at + BLOCK_BYTES, len(data))
            while to < len(data):  # on to the next end of a piece
                ends = np.flatnonzero(_CLASS[data[to : to + BLOCK_BYTES]] == 2)
                if len(ends):
                    to += int(ends[0])
                    break
                to = min(to + BLOCK_BYTES, len(data))
            yield rows, data[at:to], np.array([0, to - at])
            at = to


class _Block:
    """The words of a block in order: ``ids`` of (language, word), and whether the next word stands in the same piece."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        kind = _CLASS[data]
        word = kind == 0
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        first[inner] = word[inner]
        last[:-1] &= ~word[1:]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        n = len(starts)
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[word]])]).dictionary_encode()
        langs = pc.fill_null(rows.column("lang").cast(pa.string()), "und").dictionary_encode()
        doc = np.searchsorted(offs, starts, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.joined = np.zeros(n, bool)
        if n:
            self.joined[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        self.words, self.langs = words.dictionary, langs.dictionary
        size = max(1, len(self.words))
        key = langs.indices.to_numpy()[doc].astype(np.int64) * size + words.indices.to_numpy()
        if len(self.langs) * size <= max(4 * n, 1 << 20):
            counts = np.bincount(key, minlength=len(self.langs) * size)
            found = np.flatnonzero(counts)
            self.counts = counts[found]
            place = np.zeros(len(counts), np.int64)
            place[found] = np.arange(len(found))
            self.ids = place[key]
        else:
            found, self.ids, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.lang_of, self.word_of = found // size, found % size

    def hashes(self) -> np.ndarray:
        """Of each (language, word)."""
        langs = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        return mix(langs[self.lang_of] + _word_hashes(self.words)[self.word_of] * _STEP) if len(self.lang_of) else np.zeros(0, np.uint64)

    def rows(self, counts: np.ndarray, *ids: np.ndarray) -> pa.RecordBatch:
        names = ["lang", *[f"w{i + 1}" for i in range(len(ids))], "n"]
        cols = [self.langs.take(pa.array(self.lang_of[ids[0]])), *[self.words.take(pa.array(self.word_of[x])).cast(pa.string()) for x in ids]]
        return pa.RecordBatch.from_arrays([*cols, pa.array(counts.astype(np.int64))], names)


def _word_hashes(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.large_string())
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return _hashed(np.frombuffer(words.buffers()[2], np.uint8), offs[:-1], offs[1:], ())[0] if len(words) else np.zeros(0, np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + b)


# --- the frontier as tasks know it --------------------------------------------------------------


class Bloom:
    """Membership of hashes, without false negatives."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for pos in _positions(h, len(self.bits) * 64):
            out &= (self.bits[pos >> np.uint64(6)] >> (pos & np.uint64(63))) & np.uint64(1) == 1
        return out


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(1, _PROBES + 1):
        yield mix(h + np.uint64(i * int(_STEP) % (1 << 64))) & np.uint64(bits - 1)


def bloom(keys: DataFrame, flags: dict[str, np.uint64] | None = None) -> Bloom:
    """Of the rows (lang, w1) or (lang, w1, w2) of ``keys``; each of ``flags`` is a boolean column, which marks more of them under
    a hash of its own. What reaches the driver is the filter: 16 bits a row, and ``MOST_BITS`` bits at most."""
    flags = flags or {}
    pairs = "w2" in keys.columns
    bits = min(MOST_BITS, 1 << max(10, int(16 * max(1, keys.count()) * (1 + len(flags)) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array([xxhash.xxh64_intdigest(x) for x in b.column("lang").to_pylist()], np.uint64)
            h = mix(langs + _word_hashes(b.column("w1")) * _STEP)
            if pairs:
                h = _pair(h, mix(langs + _word_hashes(b.column("w2")) * _STEP))
            all_ = np.concatenate([h, *[h[b.column(c).to_numpy(zero_copy_only=False)] ^ salt for c, salt in flags.items()]])
            pos = np.unique(np.concatenate(list(_positions(all_, bits)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pos)], ["pos"])

    set_ = keys.select("lang", "w1", *(["w2"] if pairs else []), *flags).mapInArrow(run, "pos bigint")
    words = set_.groupBy(F.shiftright("pos", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Bloom(out)


# --- counting -----------------------------------------------------------------------------------


def _ones(b: _Block) -> Iterator[pa.RecordBatch]:
    ids = np.arange(len(b.counts))
    yield b.rows(b.counts, ids)
    totals = np.bincount(b.lang_of, b.counts, len(b.langs)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([b.langs, pa.nulls(len(b.langs), pa.string()), pa.array(totals)], ["lang", "w1", "n"])


def _twos(b: _Block, words: Bloom) -> Iterator[pa.RecordBatch]:
    keep = words.has(b.hashes())[b.ids]
    at = np.flatnonzero(b.joined[:-1] & keep[:-1] & keep[1:])
    key, n = np.unique(b.ids[at] << 32 | b.ids[at + 1], return_counts=True)
    if len(key):
        yield b.rows(n, key >> 32, key & 0xFFFFFFFF)


def _threes(b: _Block, pairs: Bloom) -> Iterator[pa.RecordBatch]:
    h = b.hashes()[b.ids]
    two = np.flatnonzero(b.joined[:-1])
    own = _pair(h[two], h[two + 1])
    frequent = pairs.has(own)
    two, own = two[frequent], own[frequent]
    ok = np.flatnonzero(two[1:] == two[:-1] + 1)  # pairs side by side, both frequent
    ok = ok[pairs.has(own[ok] ^ _EDGE) | pairs.has(own[ok + 1] ^ _OWN)]
    at = two[ok]
    pair, number = np.unique(b.ids[at] << 32 | b.ids[at + 1], return_inverse=True)
    key, n = np.unique(number.astype(np.int64) << 32 | b.ids[at + 2], return_counts=True)
    if len(key):
        first = pair[key >> 32]
        yield b.rows(n, first >> 32, first & 0xFFFFFFFF, key & 0xFFFFFFFF)


def _counted(base: DataFrame, words: int, of: Callable, shared: Broadcast | None = None) -> DataFrame:
    """(lang, w1.., n): the phrases that ``of`` takes from each block, summed."""
    names = [f"w{i + 1}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                got = _Block(*block)
                if len(got.ids):
                    yield from of(got, shared.value) if shared else of(got)

    rows = base.mapInArrow(run, f"lang string, {', '.join(f'{w} string' for w in names)}, n bigint")
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n"))


# --- the search ---------------------------------------------------------------------------------


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(``SCALE`` * a * a / (left * right)), exactly."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * d(a) * d(a), d(left) * d(right))


def _thresholds(pairs: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """(lang, t): a score that at least ``size`` pairs of the language reach, near the highest such; 0 if it has fewer."""
    buckets = pairs.groupBy("lang", F.floor(F.log2(F.col("score") + 1) * 8).alias("b")).agg(F.count("*").alias("n"), F.min("score").alias("t"))
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("b")))
    reached = buckets.withColumn("n", so_far).filter(F.col("n") >= size).groupBy("lang").agg(F.max("t").alias("t"))
    return materialize(open_.join(reached, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).alias("t")), "thresholds")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, covered: int = COVERED, first_size: int | None = None) -> DataFrame:
    """Each language's ``most`` best phrases: lang, rank, phrase, a (its count), l and r (of the parts at the lowest-scoring cut),
    n (words of the language) and score. ``first_size`` two-word phrases set the first threshold (twice ``most`` by default)."""
    spark = docs.sparkSession
    base = only(docs, "text", "lang").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ones = materialize(_counted(base, 1, _ones).filter(F.col("w1").isNull() | (F.col("n") >= least)), "words")
    totals, words = ones.filter("w1 is null").select("lang", "n"), ones.filter("w1 is not null")
    shared = spark.sparkContext.broadcast(bloom(words))
    twos = materialize(_counted(base, 2, _twos, shared).filter(F.col("n") >= least), "pairs")
    shared.destroy()
    x, y = words.select("lang", "w1", F.col("n").alias("fx")), words.select("lang", F.col("w1").alias("w2"), F.col("n").alias("fy"))
    twos = twos.withColumnRenamed("n", "a").join(x, ["lang", "w1"]).join(y, ["lang", "w2"])
    bound = F.call_function("div", F.col("a").cast("decimal(15,0)") * SCALE, F.col("fx").cast("decimal(15,0)"))
    pairs = materialize(twos.withColumns({"score": score(F.col("a"), F.col("fx"), F.col("fy")), "bound": bound}), "scored-pairs")

    settled, open_, size = [], totals.select("lang"), first_size or 2 * most
    while open_.limit(1).count():
        at = _thresholds(pairs, open_, size)
        found = materialize(_expanded(base, pairs, at, least, covered), "survivors")
        counts = materialize(at.join(found.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").withColumn("done", (F.col("t") == 0) | (F.col("n") >= most)), "settled")
        settled.append(found.join(counts.filter("done").select("lang"), "lang", "left_semi"))
        open_, size = counts.filter("not coalesce(done, false)").select("lang"), 4 * size
    if not settled:
        return totals.filter("false").selectExpr("lang", "0L rank", "'' phrase", "0L a", "0L l", "0L r", "n", "0L score")
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _expanded(base: DataFrame, pairs: DataFrame, at: DataFrame, least: int, covered: int) -> DataFrame:
    """All surviving phrases (lang, phrase, a, l, r, score) of the languages of ``at`` (lang, t) that score ``t`` or more."""
    spark = base.sparkSession
    live = pairs.join(at, "lang").withColumns({"own": F.col("score") >= F.col("t"), "edge": (F.col("bound") >= F.col("t")) | (F.col("score") >= F.col("t"))})
    shared = spark.sparkContext.broadcast(bloom(live.select("lang", "w1", "w2", "edge", "own"), {"edge": _EDGE, "own": _OWN}))
    threes = materialize(_counted(base, 3, _threes, shared).filter(F.col("n") >= least), "triples")
    shared.destroy()
    # cut after one word: f(x) and f(y z); after two: f(x y) and f(z)
    head = pairs.select("lang", "w1", "w2", F.col("fx").alias("l1"), F.col("a").alias("l2"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("fy").alias("r2"))
    grown = threes.withColumnRenamed("n", "a").join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).join(at, "lang")
    one, two = score(F.col("a"), F.col("l1"), F.col("r1")), score(F.col("a"), F.col("l2"), F.col("r2"))
    grown = grown.withColumns({"s1": one, "s2": two}).filter(F.least("s1", "s2") >= F.col("t"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    out3 = grown.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    parts = threes.select("lang", "n", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longest = parts.groupBy("lang", "p.w1", "p.w2").agg(F.max("n").alias("longest"))
    left = live.filter("own").join(longest, ["lang", "w1", "w2"], "left").filter(F.coalesce(100 * F.col("longest") < covered * F.col("a"), F.lit(True)))
    out2 = left.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    return out2.unionByName(out3)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
seqs AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM seqs) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS g FROM seqs WHERE len(ws) >= 2) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g FROM seqs WHERE len(ws) >= 3) GROUP BY ALL HAVING count(*) >= 10),
cover AS (SELECT lang, w1, w2, max(a) AS longest FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
s2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * f2.a * f2.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2 LEFT JOIN cover c ON c.lang = f2.lang AND c.w1 = f2.w1 AND c.w2 = f2.w2
  WHERE c.longest IS NULL OR 100 * c.longest < 50 * f2.a),
c3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.a, x.f AS l1, yz.a AS r1, xy.a AS l2, z.f AS r2, 1000000::HUGEINT * f3.a * f3.a // (x.f::HUGEINT * yz.a) AS s1, 1000000::HUGEINT * f3.a * f3.a // (xy.a::HUGEINT * z.f) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w = f3.w3
  JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3),
alive AS (SELECT * FROM s2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, CAST(least(s1, s2) AS BIGINT) FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alive)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
