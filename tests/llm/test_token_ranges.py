"""Flat files read in byte ranges; files ordered by number; the coder against order-0 entropy and zlib."""

import random
import struct
import zlib

import numpy as np
import pytest

from boardlake.llm import context_coder, token_counts, token_files
from boardlake.llm.tokens import TokenIds, public_path


def counts(stream, end):
    out, n = [], 0
    for x in stream:
        if x == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


@pytest.mark.parametrize("end", [50256, 0x5050, 9, 0xBBEF, 0x00EF])
def test_one_file_in_many_ranges(spark, tmp_path, end):
    r = random.Random(end)
    near = [end, end ^ 0x100, end ^ 1, (end & 255) << 8 | end >> 8, (end & 255) * 257, 7]
    stream = [r.choice(near) for _ in range(3000)]
    (tmp_path / "tokens.bin").write_bytes(np.array(stream, "<u2").tobytes())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301")
    try:
        assert token_counts.scan_blocks(spark, str(tmp_path), end, 20).select("at").distinct().count() > 4
        out = token_counts.count_tokens(spark, str(tmp_path), end, 20).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x.n_tokens for x in out] == counts(stream, end)


@pytest.mark.parametrize("first", [[0xBBEF, 0x12BF, 5], [0xBBEF, 0x50BF], [0xBBEF, 0xC450, 1]])
def test_a_file_that_begins_like_a_byte_order_mark(spark, tmp_path, first):
    stream = [*first, 50256, 3, 4, 50256, 0x5050]
    (tmp_path / "a.bin").write_bytes(np.array(stream, "<u2").tobytes())
    out = token_counts.count_tokens(spark, str(tmp_path), 50256, 2).orderBy("ordinal").collect()
    assert [x.n_tokens for x in out] == counts(stream, 50256)


def test_odd_files_and_large_ids_are_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="16-bit"):
        token_counts.count_tokens(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="65,536"):
        token_counts._in_16_bits(np.array([70000]), np.array([0, 1]))


def test_files_go_by_number(spark, tmp_path):
    names = ["part-99999-x-c999.txt", "part-99999-x-c1000.txt", "part-100000-x-c000.txt"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(np.array([1] * (k + 1) + [50256], "<u2").tobytes())
    assert [r.n_tokens for r in token_counts.count_tokens(spark, str(tmp_path)).orderBy("ordinal").collect()] == [1, 2, 3]
    rows = spark.createDataFrame([(f"/a/{n}", 0, 10 + k) for k, n in enumerate(names)], "file string, within long, n_tokens long")
    assert sorted((r.start, r.n_tokens) for r in token_files.with_start(rows).collect()) == [(0, 10), (10, 11), (21, 12)]


def test_coder_beats_order_0_entropy_and_zlib(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids, _ = TokenIds(public_path(token_files.TOKENIZER)).many(texts, 2)
    prior = context_coder.Prior.of(ids)
    data = b"".join(context_coder.encode_blocks(ids, prior))
    n, p = len(ids), np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    size = 8 * (len(data) + len(prior.to_bytes())) / n
    assert size < -(p * np.log2(p)).sum() and size < 8 * len(zlib.compress(ids.astype("<u2").tobytes())) / n
    assert (context_coder.decode_blocks(data, context_coder.Prior.from_bytes(prior.to_bytes())) == ids).all()


def test_all_orders_enter_the_mix():
    r = np.random.default_rng(5)
    frequent = np.where(r.random(2048) < 0.9, 3, r.integers(0, 60000, 2048))
    after_one = np.repeat(r.integers(0, 60000, 16), 1)[np.arange(2048) % 16]
    after_two = np.array([[1, 2, 3, 1, 4, 5], [2, 1, 3]][0] * 400)[:2048]
    for ids in (frequent, after_one, after_two):
        with_prior = len(context_coder.encode_blocks(ids, context_coder.Prior.of(ids))[0])
        assert with_prior * 8 < 2048 * 2.5


def test_records_are_verified():
    ids = np.arange(5000) % 700
    data = token_files.pack_record([(1, 2000), (None, 3000)], ids) + b"\n"
    got = list(token_files.read_records(data))
    assert got[0][0] == [1, None] and (got[0][2] == ids).all()
    bad = bytearray(data)
    bad[struct.calcsize("<4sIIQ") + 40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_records(bytes(bad)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_many_texts_at_once(name):
    r, e = random.Random(3), TokenIds(public_path(name))
    signs = "ab's tTrevlmd'' \n\t 12,.!é×ß\xa0\x85日<|ñ³ª"
    for _ in range(300):
        texts = [None, "".join(r.choice(signs[: r.choice([9, 22, 40])]) for _ in range(r.randint(0, 25))), "", "ab cd " * r.randint(0, 3)]
        ids, offs = e.many(texts, 7)
        for t, a, z in zip(texts, offs[:-1], offs[1:], strict=True):
            assert ids[a:z].astype("<u4").tobytes() == e.whole(t or "") + b"\7\0\0\0"


def test_a_very_long_text(monkeypatch):
    e = TokenIds(public_path("byte_bpe_50k.json"))
    text = "the quick brown fox, 12 " * 120_000
    ids, offs = e.many([text, "x"], 2)
    assert offs[-1] == len(ids) and ids[offs[1] :].tolist() == [87, 2]
    assert ids[: offs[1] - 1].astype("<u4").tobytes() == e.whole(text)


def test_numbers_are_read_behind_the_job_id(spark):
    names = ["part-00001-1a2b-c001-4abc-c010.txt", "part-00001-1a2b-c001-4abc-c009.txt", "part-00000-1a2b-c001-4abc-c1000.txt", "tokens.bin"]
    df = spark.createDataFrame([(f"/a/{n}",) for n in names], "file string").orderBy(*token_files.file_order())
    assert [r.file.rsplit("/", 1)[1] for r in df.collect()] == [names[3], names[2], names[1], names[0]]
