"""Operator 7 [native]: Order MinHash fingerprints, which are sensitive to edit distance and word order.

A text's k-mers (five words in a row; a shorter text is one k-mer) are numbered by occurrence, so the second time a k-mer
comes it is another item than the first. The items' hashes deal them to ``SLOTS`` slots, and each slot selects its two
minimal items (the one-permutation form of MinHash: each item is hashed once rather than once a slot). A slot's two
k-mers are put back into text order and their tuple is hashed. Two fingerprints are as alike as the share of slots,
among those that are filled in either, in which they hold the same tuple.

All is SQL expressions on one row's arrays and one shuffle, by ranges of (``doc_id``, hash of the text), for a document and its
successor.

Defined cases: null text is empty; a text without words has an empty fingerprint, and two of those are alike (1.0);
rows with a null ``doc_id`` come last in descending order; rows that repeat an id follow one another in order of their texts'
XXH64 (as a signed number), whatever the sizes of tables and ranges; an id, or one text of it, with more rows than a range is dealt to
several tasks; a single row is its own successor; an empty table gives no rows; other columns, whatever their names, are ignored.
Positions take 30 bits, so a text may have 2^30 words; no string in Spark holds more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.llm.common import only, table

KMER = 5
SLOTS = 64
_POS = (1 << 30) - 1


def _high(x: Column) -> Column:
    """What is packed above the position: 34 bits of a hash."""
    return F.shiftrightunsigned(x, 30)


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, 58)


def _pos(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_POS))


def signed(df: DataFrame, text: str, out: str, k: int = KMER) -> DataFrame:
    """``df`` with the signature of column ``text``: ascending slot << 32 | 32 bits of the tuple's hash, for filled slots."""
    keep = [F.col(c) for c in df.columns]
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    df = df.select(*keep, words.alias("_w"))
    # packed: a k-mer's hash above its position; sorted, so equal k-mers are side by side, in text order
    packed = lambda h, i: F.shiftleft(h, 30).bitwiseOR(i.cast("long"))
    whole = F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).otherwise(F.array(packed(F.xxhash64("_w"), F.lit(0))))
    kmers = F.transform(F.slice("_w", 1, F.size("_w") - (k - 1)), lambda w, i: packed(F.xxhash64(F.slice("_w", i + 1, k)), i))
    df = df.select(*keep, F.sort_array(F.when(F.size("_w") < k, whole).otherwise(kmers)).alias("_p"))

    def item(x: Column, i: Column) -> Column:
        """The hash of a k-mer and the number of equal ones before it: slot and rank, above the position."""
        same = lambda back: _high(F.get("_p", i - back)) == _high(x)
        steps = F.array(*[F.lit(1 << b) for b in range(29, -1, -1)])
        earlier = F.aggregate(steps, F.lit(0), lambda n, s: F.when((i - n - s >= 0) & same(n + s), n + s).otherwise(n))
        g = F.xxhash64(_high(x), F.when((i > 0) & same(F.lit(1)), earlier).otherwise(F.lit(0)))
        return F.shiftleft(g, 30).bitwiseOR(x.bitwiseAND(F.lit(_POS)))

    df = df.select(*keep, F.sort_array(F.transform("_p", item)).alias("_s"))
    df = df.select(*keep, F.filter("_s", lambda x, i: (i < 2) | (_slot(F.get("_s", i - 2)) != _slot(x))).alias("_t"))

    def slot(x: Column, i: Column) -> Column:
        """A slot's one or two items in text order, hashed; null for its second item."""
        y = F.get("_t", i + 1)
        two = F.when(_pos(x) < _pos(y), F.xxhash64(_high(x), _high(y))).otherwise(F.xxhash64(_high(y), _high(x)))
        tuple_ = F.when(_slot(y) == _slot(x), two).otherwise(F.xxhash64(_high(x)))
        first = (i == 0) | (_slot(F.get("_t", i - 1)) != _slot(x))
        return F.when(first, F.shiftleft(_slot(x), 32).bitwiseOR(F.shiftrightunsigned(tuple_, 32)))

    return df.select(*keep, F.array_sort(F.array_compact(F.transform("_t", slot))).alias(out))


def rendered(sig: Column) -> Column:
    """Ten hexadecimal digits for each filled slot: its number, then its hash."""
    return F.lower(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    slots = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, 32)), F.transform(b, lambda v: F.shiftright(v, 32))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / slots)


def _range_of(ord_: Column, bounds: Column) -> Column:
    """The number of ascending ``bounds`` (arrays of some of them each) that are at most ``ord_``, found in two steps."""
    coarse = F.size(F.filter(bounds, lambda b: b[0] <= ord_))
    fine = F.size(F.filter(F.get(bounds, coarse - 1), lambda b: b <= ord_))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * F.size(bounds[0]) + fine)


def with_next(docs: DataFrame, columns: list[str], ranges: int | None = None, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` with ``next_<column>``: the values of the next row in descending order of ``ord``, then ascending order of the hash of
    ``text`` (after the last: the first).

    Rows are dealt by ranges of ``ord``, cut at quantiles, and each range also gets the row that comes after it. A value of ``ord``
    that takes several quantiles has a range of its own, which is cut into ranges of hashes; copies of one text that still are
    more than a range are dealt by row numbers, as it makes no difference which copy is next to which. What reaches the
    driver, and is broadcast, is a row or a number for each range, of which there are some four for each shuffle partition. ``then``
    adds columns to rows that know their range, so that it is not run for the rows that are only looked through.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    cuts = [(i + 1) / ranges for i in range(ranges - 1)]
    got, total = docs.select(F.percentile_approx("ord", cuts or [0.5], 20 * ranges), F.count("*")).first()
    got = got or []
    hot = {v: got.count(v) for v in got if got.count(v) > 1}
    bounds = sorted({*got, *(v + 1 for v in hot if v < (1 << 63) - 1)}) or [0]
    step = max(1, int(len(bounds) ** 0.5))
    table_of = lambda rows, ddl: F.broadcast(spark.createDataFrame(rows, ddl))
    cut = table_of([([bounds[i : i + step] for i in range(0, len(bounds), step)],)], "bounds array<array<bigint>>")
    dealt = docs.crossJoin(cut).withColumn("range", _range_of(F.col("ord"), F.col("bounds"))).drop("bounds")
    part, copy = F.lit(0), F.lit(0)
    if hot:
        dealt = dealt.join(table_of([(v, n + 1) for v, n in hot.items()], "ord bigint, parts int"), "ord", "left")
        place = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 33)  # of the hash among all, in 31 bits
        part = F.coalesce(F.shiftright(place * F.col("parts"), 31).cast("int"), F.lit(0))
        many = dealt.filter("parts is not null").groupBy("ord", "h").agg(F.count("*").alias("n")).filter(F.col("n") * ranges > total).collect()
        if many:
            dealt = dealt.join(table_of([(r.ord, r.h, -(-r.n * ranges // total)) for r in many], "ord bigint, h bigint, copies int"), ["ord", "h"], "left")
            copy = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("copies")).cast("int"), F.lit(0))
    dealt = dealt.withColumns({"part": part, "copy": copy}).select(*docs.columns, "range", "part", "copy")
    # of each task's rows the first, and to which task it goes beside its own: the one before
    key = ["range", "part", "copy"]
    first = F.min_by(F.struct("ord", "h"), F.struct(F.bitwise_not("ord"), "h")).alias("f")
    tops = dealt.groupBy(*key).agg(first).collect()
    tops = sorted(tops, key=lambda r: (-r["range"], r.part, ~r.f.ord, r.f.h, r["copy"]))
    lent = [(b.f.ord, b.f.h, a["range"], a.part, a["copy"]) for a, b in zip(tops, tops[1:] + tops[:1], strict=True)]
    wanted = table_of(lent, "ord bigint, h bigint, to_range int, to_part int, to_copy int")
    rest = [c for c in docs.columns if c not in ("ord", "h")]
    one = docs.join(F.broadcast(wanted.select("ord", "h").distinct()), ["ord", "h"]).groupBy("ord", "h").agg(F.min(F.struct(*rest)).alias("r"))
    borrowed = one.join(wanted, ["ord", "h"]).select(*[F.col(c if c in ("ord", "h") else f"r.{c}").alias(c) for c in docs.columns], F.col("to_range").alias("range"), F.col("to_part").alias("part"), F.col("to_copy").alias("copy"), F.lit(True).alias("lent"))
    both = then(dealt.withColumn("lent", F.lit(False))).unionByName(then(borrowed))
    w = Window.partitionBy(*key).orderBy("lent", F.desc("ord"), "h")
    both = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return both.filter("not lent").drop("lent", "h", *key)


def fingerprints(docs: DataFrame, k: int = KMER) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, both fingerprints and the likeness to the edited and the next text."""
    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    pairs = with_next(base, ["text", "sig"], then=lambda df: signed(df, "text", "sig", k))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sig", "edited", "next_sig")
    pairs = signed(pairs, "edited", "edited_sig", k)
    return pairs.select("doc_id", "n_chars", "edited_sha256", rendered(F.col("sig")).alias("fingerprint"), rendered(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
