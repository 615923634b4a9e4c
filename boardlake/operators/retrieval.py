"""Index documents, chunks, lexical and vector search, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from boardlake.functions.vectorized import cosine_top_k
from boardlake.sources.scratch import written

RRF = 60


def _or_dash(c: Column) -> Column:
    return F.when(F.coalesce(c.cast("string"), F.lit("")) == "", "-").otherwise(c.cast("string"))


def _lines(*parts: tuple[str, Column]) -> Column:
    """``label: value`` lines; null values leave their line out."""
    return F.concat_ws("\n", *[F.concat(F.lit(label), value.cast("string")) for label, value in parts])


def _yes(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")


def run_documents(rows: DataFrame, runs: DataFrame, most: int = 240) -> DataFrame:
    """(run, content): a head of each run (run, type, metric, header, status) and a line for each of its first ``most``
    rows (run, rank, name, alliance, metric_raw, value, status) by rank, then value, largest first. A row without a rank shows
    its place."""
    w = Window.partitionBy("run").orderBy(F.asc_nulls_last("rank"), F.desc_nulls_first("value"), "id")
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    line = F.concat(F.coalesce("rank", "_n").cast("string"), F.lit(". "), F.coalesce("name", F.lit("")), F.lit(" | alliance="), _or_dash(F.col("alliance")), F.lit(" | metric="), F.coalesce(F.col("value").cast("string"), F.col("metric_raw"), F.lit("")), F.lit(" | status="), F.coalesce("status", F.lit("")))
    lines = first.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("_l"))
    head = _lines(("Ranking Run ", F.col("run")), ("Type: ", F.col("type")), ("Metric Key: ", F.col("metric")), ("Header: ", _or_dash(F.col("header"))), ("Status: ", F.col("status")))
    body = F.transform(F.coalesce("_l", F.array().cast("array<struct<_n:int,line:string>>")), lambda x: x["line"])
    return runs.join(lines, "run", "left").select("run", F.array_join(F.concat(F.array(head), body), "\n").alias("content"))


def player_documents(players: DataFrame, aliases: DataFrame, most: int = 120) -> DataFrame:
    """(player, content): name, id, alliance and the first ``most`` aliases (player, alias, created_at) that are not blank."""
    w = Window.partitionBy("player").orderBy("created_at", "alias")
    first = aliases.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= most) & (F.trim("alias") != ""))
    own = first.groupBy("player").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "alias"))), lambda x: x["alias"]), " | ").alias("_a"))
    content = _lines(("Governor: ", F.col("name")), ("Governor ID: ", F.col("player")), ("Alliance: ", _or_dash(F.col("alliance"))), ("Aliases: ", _or_dash(F.col("_a"))))
    return players.join(own, "player", "left").select("player", content.alias("content"))


def event_documents(events: DataFrame) -> DataFrame:
    """(event, content) of events (event, name, type, description, week, closed, starts_at, ends_at)."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("-"))
    content = _lines(("Event: ", F.col("name")), ("Type: ", F.col("type")), ("Description: ", _or_dash(F.col("description"))), ("Week Key: ", _or_dash(F.col("week"))), ("Closed: ", _yes(F.col("closed"))), ("Starts: ", iso("starts_at")), ("Ends: ", iso("ends_at")))
    return events.select("event", content.alias("content"))


def extraction_documents(rows: DataFrame) -> DataFrame:
    """(id, content) of extractions (id, player_raw, name_raw, confidence, low_confidence, engine, and as JSON text or null:
    normalized, fields, failures); empty JSON has no line."""
    some = lambda c: F.when(~F.coalesce(F.regexp_replace(c, r"\s", ""), F.lit("")).isin("", "{}", "[]", "null"), F.col(c))
    content = _lines(
        ("OCR Extraction ", F.col("id")), ("Governor ID: ", _or_dash(F.col("player_raw"))), ("Governor Name: ", _or_dash(F.col("name_raw"))), ("Confidence: ", F.col("confidence")), ("Low confidence: ", _yes(F.col("low_confidence"))),
        ("Engine: ", _or_dash(F.col("engine"))), ("Normalized: ", some("normalized")), ("Fields: ", some("fields")), ("Failure reasons: ", some("failures")),
    )
    return rows.select("id", content.alias("content"))


def chunks(docs: DataFrame, size: int = 1400, most: int | None = None) -> DataFrame:
    """R2: (doc_id, chunk, content, hash): fixed-width chunks of the text with collapsed white space; empty texts have none."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    n = F.ceil(F.length("_t") / size).cast("int")
    n = F.least(n, F.lit(most)) if most else n
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_t"), i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    out = docs.select("doc_id", text.alias("_t")).select("doc_id", F.posexplode(parts).alias("chunk", "content"))
    return out.withColumn("hash", F.sha1("content"))


def index_actions(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, update (other hash), keep or delete for each key; only inserts and updates need a new embedding."""
    both = existing.select(*keys, F.col("hash").alias("old")).join(incoming.select(*keys, F.col("hash").alias("new")), keys, "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def vector_search(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """Exact cosine top-k of (query_id, vector) among (doc_id, vector)."""
    return cosine_top_k(queries, docs, k)


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's words (of two characters or more) that the content has."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda w: F.length(w) >= 2))
    have = F.size(F.filter(words, lambda w: F.lower(content).contains(w)))
    return F.when(F.size(words) > 0, have / F.size(words)).otherwise(0.0)


#: Grams are numbers of 24 bits, so a set of them is a bitmap of two megabytes, whatever there is.
_GRAMS = 1 << 24
#: Where grams of one and two bytes begin; no text has a byte of F8 or above, so they stand apart from those of three.
_SHORT = {1: 0xF80000, 2: 0xF90000, 3: 0}


def _grams(text: str | None, size: int) -> np.ndarray:
    """The distinct runs of ``size`` bytes (1 to 3) of a text, as numbers."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    n = len(data) - size + 1
    return np.unique(sum(data[i : i + n] << 8 * (size - 1 - i) for i in range(size))) + _SHORT[size] if n > 0 else np.zeros(0, np.int64)


def _known_grams(text: str, bits: np.ndarray) -> np.ndarray:
    """The distinct grams of all sizes of a text that ``bits`` holds; most are not held, so they are told apart last."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    held = []
    for size, first in _SHORT.items():
        n = len(data) - size + 1
        if n > 0:
            own = sum(data[i : i + n] << 8 * (size - 1 - i) for i in range(size)) + first
            held.append(own[bits[own]])
    return np.unique(np.concatenate(held)).astype(np.int64) if held else np.zeros(0, np.int64)


def _set_of(grams: DataFrame) -> np.ndarray:
    """The grams of a table as a bitmap."""
    out = np.zeros(_GRAMS, bool)
    out[grams.select("gram").distinct().toArrow().column("gram").to_numpy()] = True
    return np.packbits(out)


def lexical_search(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """Documents that contain the whole query, without regard to case; the ``k`` newest of each.

    No query meets all documents. Of each query's trigrams (of bytes, in lower case; of a shorter query the query itself) the one that
    the fewest documents hold is its key; documents are joined by the keys they hold, and only those pairs are looked at. Two
    passes over the documents: one counts the queries' grams, one lists keys. Tasks know which from a bitmap of fixed size.
    Queries without text find nothing, and neither do they match texts that are null.
    """
    spark = docs.sparkSession
    lists = ArrayType(LongType())

    @F.pandas_udf(lists)
    def grams_of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _grams(t, min(3, len(t.encode("utf-8", "surrogatepass")))))

    asked = queries.withColumn("_query", F.lower("query")).filter(F.length("_query") > 0)
    grams = written(asked.select("query_id", F.explode(grams_of("_query")).alias("gram")), "query-grams")
    texts = docs.withColumn("_text", F.lower("content")).filter("_text is not null")
    known = spark.sparkContext.broadcast(_set_of(grams))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(known.value).astype(bool)
        for b in batches:
            found = [np.zeros(0, np.int64)]
            for t in b.column(0):
                found.append(_known_grams(t.as_py(), bits))
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    held = texts.select("_text").mapInArrow(counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = grams.join(held, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    keys = written(rarest.join(asked, "query_id"), "query-keys")
    known.destroy()
    wanted = spark.sparkContext.broadcast(_set_of(keys))

    @F.pandas_udf(lists)
    def keys_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.unpackbits(wanted.value).astype(bool)
        for text in texts:
            yield text.map(lambda t: _known_grams(t, bits))

    pairs = texts.withColumn("gram", F.explode(keys_of("_text"))).join(keys, "gram")
    w = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), "doc_id")
    found = pairs.filter(F.contains("_text", "_query")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return found.select("query_id", "doc_id", lexical_score(F.col("query"), F.col("content")).alias("score"), "place")


def fused(vector: DataFrame, lexical: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal ranks of two ranked lists (query_id, doc_id, score, place); by fused score, then similarity."""
    v = vector.select("query_id", "doc_id", F.col("score").alias("similarity"), F.col("place").alias("v"))
    x = lexical.select("query_id", "doc_id", F.col("score").alias("lexical"), F.col("place").alias("l"))
    part = lambda c: F.coalesce(1 / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    both = v.join(x, ["query_id", "doc_id"], "full_outer").withColumn("fused", F.round(part("v") + part("l"), 8))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc(F.coalesce("similarity", F.lit(0.0))), "doc_id")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("v", "l")
