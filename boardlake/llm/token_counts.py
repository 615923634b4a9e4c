"""Operator 9: tokens of each document in flat, unindexed token files, by a separator scan.

A flat file is nothing but 16-bit ids, each document's followed by the end-of-document id. Files of any size are read in
byte ranges, many tasks to a file: Spark's line reader cuts them behind bytes that equal the end id's lower one, so a range
knows neither documents nor, as it may begin in the middle of an id, its alignment. Its bytes are put together again to
blocks, and each block is searched for the end id in one vectorised comparison for either alignment, and summed up: ids
before its first end, ids after its last, and the counts between. A prefix scan over the blocks of a file gives every block
its place, so its alignment; another one, and one over the files (a row each), carries the open document from block to
block and gives every document its whole count.

``write_flat`` writes such files from a table: an id stream per task, through Spark's text sink with the end id as its
line end. Special tokens' strings in texts are ordinary text there, so the end id occurs as an end only.

Defined cases: null and empty texts count 0; ids after the last end of all are a document without an end, counted too if
there are any; repeated rows are counted one by one; empty tables and files give no rows; other columns are ignored; files
of an odd number of bytes and ids above 65,535 are errors; files whose name begins with ``_`` or ``.`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.llm.common import materialize, only, scratch, table
from boardlake.llm.token_files import file_order
from boardlake.llm.tokens import public_path, token_ids

TOKENIZER = "byte_bpe_50k.json"
END_ID = 50256
BLOCK_IDS = 1 << 18
DOCS_A_FILE = 5000


#: Texts that are tokenised in one go.
_TEXTS = 256


def _in_16_bits(ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("flat files hold ids below 65,536")
    raw, offs = ids.astype("<u2").tobytes(), (2 * offs).tolist()
    return [raw[a:z] for a, z in zip(offs[:-1], offs[1:], strict=True)]


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, docs_a_file: int = DOCS_A_FILE) -> None:
    """Flat files of the texts of ``docs``, task by task, in the order of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer, plain=True)
        for b in batches:
            for at in range(0, b.num_rows, _TEXTS):
                ids, offs = encode.many(b.column(0).slice(at, _TEXTS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(_in_16_bits(ids, offs), pa.binary())], ["value"])

    rows = only(docs, "doc_id", "text").select(F.col("text").cast("string").alias("text")).mapInArrow(run, "value binary")
    end = np.asarray([end_id], "<u2").tobytes().decode("latin-1")
    rows.select(F.col("value").cast("string")).write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", docs_a_file).text(path)


def summarise(ids: np.ndarray, end_id: int) -> tuple[int, int, np.ndarray, int]:
    """(ends, ids before the first end, counts between ends, ids after the last); without ends all ids are ``after``."""
    ends = np.flatnonzero(ids == end_id)
    if not len(ends):
        return 0, 0, ends, len(ids)
    return len(ends), int(ends[0]), np.diff(ends) - 1, len(ids) - int(ends[-1]) - 1


#: What a file that begins with it loses to Spark's line reader.
_MARK = b"\xef\xbb\xbf"
_SUMMARY = pa.struct([("ends", pa.int64()), ("head", pa.int64()), ("inner", pa.list_(pa.int64())), ("tail", pa.int64())])


def scan_blocks(spark: SparkSession, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, size, at, nth, n_bytes, found) of every block, of about ``block_ids`` ids: the file's size, the range that the
    block is of and its number there, and its sums if it begins with a whole id, with the second half of one, or with a
    byte-order mark that was taken from it."""
    low = end_id & 0xFF
    last = bytes([low])

    def block(file, size, at, nth, raw: bytes) -> tuple:
        forms = [raw, last + raw, *([_MARK + raw] if at == nth == 0 else [])]
        found = [summarise(np.frombuffer(f, "<u2", len(f) // 2), end_id) for f in forms]
        return file, size, at, nth, len(raw), [dict(zip(("ends", "head", "inner", "tail"), (e, h, i.tolist(), t), strict=True)) for e, h, i, t in found]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(_SUMMARY)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "size", "at", "nth", "n_bytes", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nth, held, n = None, 0, [], 0
        for b in batches:
            done = []
            ranges = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            for key, value in zip(ranges, b.column(3).to_pylist(), strict=True):
                if held and (key != own or n >= 2 * block_ids):
                    done.append(block(*own, nth, last.join([*held, b""])))
                    held, n, nth = [], 0, nth + 1
                if key != own:
                    own, nth = key, 0
                held.append(value)
                n += len(value) + 1
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([block(*own, nth, last.join([*held, b""]))])

    lines = spark.read.option("lineSep", last.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, "file string, size bigint, at bigint, nth bigint, n_bytes bigint, found array<struct<ends:bigint,head:bigint,inner:array<bigint>,tail:bigint>>")


def aligned(blocks: DataFrame) -> DataFrame:
    """(file, at, nth, ends, head, inner, tail) of the rows of ``scan_blocks``: of each, the sums that fit its place."""
    whole, before = Window.partitionBy("file"), Window.partitionBy("file").orderBy("at", "nth").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.col("size") - F.sum("n_bytes").over(whole)  # the end of a file counts one byte more if it has no line end
    rows = blocks.withColumns({"lost": lost, "before": F.coalesce(F.sum("n_bytes").over(before), F.lit(0))})
    marked = F.col("lost").isin(2, 3)
    odd = (F.col("before") + F.when(marked, 3).otherwise(0)) % 2 == 1
    form = F.when(marked & (F.col("before") == 0), 2).when(odd, 1).otherwise(0)
    sound = (F.col("size") % 2 == 0) & F.col("lost").isin(-1, 0, 2, 3)
    own = F.when(sound, F.get("found", form)).otherwise(F.raise_error(F.concat(F.lit("not a flat file of 16-bit ids: "), "file")))
    return rows.select("file", "at", "nth", own.alias("own")).select("file", "at", "nth", "own.*")


def _carried(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``carry``: ids of the document that is open where a row begins; ``first``: ends before it. A prefix scan."""
    rows = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("seen", F.sum("ends").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy(*by, "seen").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("open", F.sum("tail").over(since))
    return df.withColumn("carry", F.coalesce(F.lag("open").over(rows), F.lit(0))).withColumn("first", F.col("seen") - F.col("ends"))


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(ordinal, file, in_file, n_tokens): every document of the files, in order of the numbers in their names and of place."""
    blocks = materialize(scan_blocks(spark, path, end_id, block_ids), "blocks")
    per_block = _carried(aligned(blocks), ["file"], ["at", "nth"])
    # a file as a whole: its ends, the ids before its first end, and those after its last
    last = F.max_by(F.struct("open", "seen"), F.struct("at", "nth"))
    files = per_block.groupBy("file").agg(F.sum("ends").alias("ends"), last.alias("last")).select("file", "ends", F.col("last.open").alias("tail"))
    files = files.withColumn("place", F.row_number().over(Window.orderBy(*file_order())))
    files = _carried(files.withColumn("all", F.lit(0)), ["all"], ["place"]).select("file", "place", F.col("carry").alias("file_carry"), F.col("first").alias("before"))
    placed = per_block.join(files, "file")
    start = F.col("carry") + F.col("head") + F.when(F.col("first") == 0, F.col("file_carry")).otherwise(0)
    docs = placed.filter("ends > 0").select("file", "first", F.posexplode(F.concat(F.array(start), "inner")).alias("k", "n_tokens"), (F.col("before") + F.col("first")).alias("base"))
    docs = docs.select((F.col("base") + F.col("k")).alias("ordinal"), "file", (F.col("first") + F.col("k")).alias("in_file"), "n_tokens")
    # what follows the last end of all
    rest = placed.groupBy().agg(F.max_by(F.struct((F.col("before") + F.col("seen")).alias("ordinal"), "file", F.col("seen").alias("in_file"), (F.col("open") + F.when(F.col("seen") == 0, F.col("file_carry")).otherwise(0)).alias("n_tokens")), F.struct("place", "at", "nth")).alias("r"))
    return docs.unionByName(rest.filter("r.n_tokens > 0").select("r.ordinal", "r.file", "r.in_file", "r.n_tokens"))


def count_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens) of every row: its flat files are written and scanned, and places matched to rows by task.

    The rows' order within tasks must be stable, as that of a table read from files is; counts per file are compared.
    """
    spark = docs.sparkSession
    path = scratch(spark, "flat-tokens")
    write_flat(docs, path, tokenizer, end_id)
    task = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")
    piece = F.regexp_extract("file", r"-c(\d+)\.[^/]*$", 1).cast("long")
    counted = count_tokens(spark, path, end_id).select(task.alias("task"), (piece * DOCS_A_FILE + F.col("in_file")).alias("nth"), "n_tokens")
    at = F.monotonically_increasing_id()
    ids = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("task"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    matched = ids.join(counted, ["task", "nth"], "full_outer")
    known = F.when(F.col("n_tokens").isNull() | F.col("task").isNull(), F.raise_error(F.lit("files and rows do not match"))).otherwise(F.col("n_tokens"))
    return matched.select("doc_id", known.cast("long").alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"), public_path(TOKENIZER))
