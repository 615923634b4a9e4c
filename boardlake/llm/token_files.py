"""Operator 6: token-id files, coded by an adaptive context-mixing range coder.

Documents are dealt by ranges of ``doc_id`` and sorted, tokenised, and written as binary files of records, in ascending
order of ``doc_id`` over the files by the numbers in their names. A record holds up to about ``RECORD_IDS`` ids: a header,
its documents' ids and lengths with a checksum, the order-0 counts that its blocks start from, and the ids in
independently reset, checksummed blocks (``context_coder``). Spark's text sink writes the records as they are (with a line
end after each), so files lie in any store that Spark reaches and a task that is repeated leaves no half-written file; its
binary source reads them back.

Record, little-endian: ``ATF2``, documents u32, bytes of counts u32, bytes of blocks u64, then per document a flag (0: its
id is null) u8, id i64, length u64, then the counts, then crc32 of these tables and counts u32, then the blocks.

Defined cases: null text is empty, so a document of the end id alone; rows with a null ``doc_id`` come first; rows that
repeat an id follow one another, in order of text within a file; an id of however many rows is dealt to several tasks; an
empty table gives files without records; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.llm.common import only, scratch, table
from boardlake.llm.context_coder import Prior, decode_blocks, encode_blocks
from boardlake.llm.tokens import public_path, token_ids

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
RECORD_IDS = 8 << 20
RECORDS_A_FILE = 8
MAGIC = b"ATF2"
#: Texts that are tokenised in one go.
_TEXTS = 256


def pack_record(docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """A record of ``docs`` (id, number of token ids) and all their token ids."""
    known = np.array([i is not None for i, _ in docs], np.uint8)
    names, sizes = np.array([i or 0 for i, _ in docs], "<i8"), np.array([n for _, n in docs], "<u8")
    tables = known.tobytes() + names.tobytes() + sizes.tobytes()
    prior = Prior.of(ids) if len(ids) else Prior.even()
    counts, blocks = prior.to_bytes() if len(ids) else b"", b"".join(encode_blocks(ids, prior))
    tables += counts
    return struct.pack("<4sIIQ", MAGIC, len(docs), len(counts), len(blocks)) + tables + struct.pack("<I", zlib.crc32(tables)) + blocks


def read_records(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, token ids) of each record of a file."""
    at = 0
    while at < len(data):
        magic, n, counts, size = struct.unpack_from("<4sIIQ", data, at)
        tables = data[at + 20 : at + 20 + 17 * n + counts]
        at += 20 + len(tables)
        if magic != MAGIC or zlib.crc32(tables) != struct.unpack_from("<I", data, at)[0]:
            raise ValueError("damaged record")
        known, names = np.frombuffer(tables, np.uint8, n), np.frombuffer(tables, "<i8", n, n)
        sizes = np.frombuffer(tables, "<u8", n, 9 * n).astype(np.int64)
        ids = decode_blocks(data[at + 4 : at + 4 + size], Prior.from_bytes(tables[17 * n :]) if counts else None)
        yield [int(i) if k else None for i, k in zip(names, known, strict=True)], sizes, ids
        at += 4 + size + 1  # and the line end


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, record_ids: int = RECORD_IDS) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer)
        held: list[tuple[int | None, int]] = []
        parts: list[np.ndarray] = []
        n = 0

        def record() -> pa.RecordBatch:
            nonlocal held, parts, n
            data = pack_record(held, np.concatenate(parts))
            held, parts, n = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for b in batches:
            for at in range(0, b.num_rows, _TEXTS):
                rows = b.slice(at, _TEXTS)
                ids, offs = encode.many(rows.column(1).to_pylist(), end_id)
                parts.append(ids)
                held += zip(rows.column(0).to_pylist(), np.diff(offs).tolist(), strict=True)
                n += len(ids)
                if n >= record_ids:
                    yield record()
        if held:
            yield record()

    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = base.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange("doc_id", "row_no").select("doc_id", "text")
    coded = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, "value binary")
    coded.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, little-endian u32)."""
    names = ["file", "doc_id", "within", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                before = 0
                for doc_ids, sizes, ids in read_records(content.as_buffer().to_pybytes()):
                    cut = np.concatenate([[0], np.cumsum(sizes)])
                    if cut[-1] != len(ids):
                        raise ValueError("a record's lengths do not sum to its ids")
                    raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    cols = [pa.array([file] * len(raw), pa.string()), pa.array(doc_ids, pa.int64()), pa.array(before + cut[:-1]), pa.array(sizes), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, *([pa.array(raw, pa.binary())] if keep_ids else [])], names)
                    before += int(cut[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = files.mapInArrow(run, "file string, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else ""))
    return rows


def file_order() -> list[Column]:
    """Files by the numbers that Spark names them by: the task's, then that of the file among the task's."""
    number = lambda p: F.regexp_extract("file", p, 1).try_cast("long")
    return [number(r"part-(\d+)[^/]*$"), number(r"-c(\d+)(?:\.[^/]*)?$"), F.col("file")]


def with_start(rows: DataFrame) -> DataFrame:
    """``within`` its file -> ``start`` among all files; the window has a row for each file."""
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy(*file_order()).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(before, "file").withColumn("start", F.col("before") + F.col("within")).drop("file", "before", "within")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardlake.llm.common import materialize

    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_path(TOKENIZER))
    return with_start(materialize(read_token_files(spark, path), "decoded")).select("doc_id", "start", "n_tokens", "ids_crc32")
