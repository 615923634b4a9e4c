"""Operator 1: benchmark decontamination with a generalised suffix automaton.

The normalised test items, a small table, become one suffix automaton over word numbers. It is broadcast, and every
document's words stream through it: at each word the automaton knows the longest suffix of the document so far that
occurs in some item. Where that length reaches ``window`` words (or a whole item that is shorter), the words are hit.
Only runs of words that all occur in items enter the automaton; no match can cross any other word.

The items are checked against ``MOST_WORDS`` first. A larger table is split into shards by item, each with an automaton
of its own, built and released in turn. The documents stream past each as they are; what the shards hit is put together
before anything is cut or judged.

Defined cases: null and empty texts have no words; null or empty items have no windows; items without an id hit like any
other and are counted as one, but listed under no id; repeated rows are judged one by one; items with the same text are
counted one by one; other columns pass ``remove_contamination`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlake.llm.common import ALNUM, Words, materialize, only, table, text_slices

WINDOW = 10
#: Words of one automaton; it takes some 300 bytes a word.
MOST_WORDS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences, and which items own what of it."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        owns: list[set[int]] = [set()]
        self.ids = sorted({i for i, w in items if w}, key=lambda i: (i is None, i or ""))
        number = {x: k for k, x in enumerate(self.ids)}
        ends: dict[int, list[tuple[int, int]]] = {}
        self.shortest = window
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, vocab.setdefault(w, len(vocab)), owns)
                owns[last].add(number[item])
            if 0 < len(words) < window:
                ends.setdefault(self._walk([vocab[w] for w in words]), []).append((len(words), number[item]))
                self.shortest = min(self.shortest, len(words))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                owns[self.link[s]] |= owns[s]
        #: Items of the states that hold a string of exactly ``window`` words; others need none.
        self.items = [frozenset(o) if s and self.len[self.link[s]] < window <= self.len[s] else None for s, o in enumerate(owns)]
        #: Short items that end wherever a state is reached: its own and those of its suffixes, longest first.
        self.short: list[tuple] = [()] * len(self.len)
        for s in reversed(order):
            own = tuple(sorted(ends.get(s, ()), reverse=True))
            self.short[s] = own + self.short[self.link[s]] if own else self.short[self.link[s]]
        self.words = sorted(vocab, key=vocab.__getitem__)
        buf = b" ".join(self.words)
        h = Words(np.frombuffer(buf, np.uint8), np.array([0, len(buf)])).hash if buf else np.zeros(0, np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def _walk(self, ids: list[int]) -> int:
        s = 0
        for c in ids:
            s = self.next[s][c]
        return s

    def _extend(self, last: int, c: int, owns: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, owns)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        owns.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, owns)
        return cur

    def _clone(self, p: int, c: int, q: int, owns: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        owns.append(set())  # it gets those of the states that link to it
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def match(self, ids: list[int], at: int, hit: list[tuple[int, int, bool]], found: set[int]) -> None:
        """Stream ``ids``, the words from word ``at`` on; add hit word ranges (from, to, whether it is a short item) and items."""
        nxt, link, length, w = self.next, self.link, self.len, self.window
        s = n = 0
        for k, c in enumerate(ids, at + 1):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s].get(c, 0)
            n = n + 1 if s else 0
            if n >= w:
                q = s
                while length[link[q]] >= w:
                    q = link[q]
                found |= self.items[q]
                hit.append((k - w, k, False))
            for size, item in self.short[s]:
                if size <= n:
                    found.add(item)
                    hit.append((k - size, k, True))

    def scan(self, w: Words, d: int) -> tuple[list[tuple[int, int, bool]], set[int]]:
        """Hit word ranges (from, to, whether a short item is within), merged and ascending, and item numbers of text ``d``."""
        a, b = w.doc[d], w.doc[d + 1]
        hit: list[tuple[int, int, bool]] = []
        found: set[int] = set()
        if b - a < self.shortest or not len(self.hashes):
            return hit, found
        at = np.minimum(np.searchsorted(self.hashes, w.hash[a:b]), len(self.hashes) - 1)
        known = np.concatenate([[False], self.hashes[at] == w.hash[a:b], [False]])
        turn = np.flatnonzero(known[1:] != known[:-1])
        for x, y in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if y - x >= self.shortest:
                self.match(self._checked(w, a, x, y, at), x, hit, found)
        hit.sort()
        merged: list[tuple[int, int, bool]] = []
        for x, y, short in hit:
            if merged and x <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(y, merged[-1][1]), short or merged[-1][2])
            else:
                merged.append((x, y, short))
        return merged, found

    def _checked(self, w: Words, a: int, x: int, y: int, at: np.ndarray) -> list[int]:
        """Word numbers of the run [x, y); -1 where only the hash is that of an item's word."""
        ids = self.order[at[x:y]].tolist()
        return [i if w.lower[s:e].tobytes() == self.words[i] else -1 for i, s, e in zip(ids, w.start[a + x : a + y].tolist(), w.end[a + x : a + y].tolist(), strict=True)]


def _item_rows(benchmark: DataFrame) -> DataFrame:
    return only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")


def shard_count(items: DataFrame, most_words: int = MOST_WORDS) -> int:
    size = items.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    return -(-int(size) // most_words) or 1


def automaton(items: DataFrame, k: int, shards: int, window: int = WINDOW) -> SuffixAutomaton:
    """That of shard ``k``, or of all items if there is one shard only."""
    part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
    return SuffixAutomaton([(r.item_id, words_of(r.text)) for r in part.toLocalIterator()], window)


_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("short", pa.bool_())]))
HITS = "doc_id bigint, n_words bigint, hits array<struct<first:bigint,last:bigint,short:boolean>>, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _char_spans(data: np.ndarray, w: Words, d: int, hits: list[tuple], base: int) -> list[tuple[int, int]]:
    """Code-point offsets [start, end) of hit word ranges in text ``d``, whose bytes begin at ``base``."""
    out, at, lead = [], base, 0
    count = lambda a, b: int(((data[a:b] & 0xC0) != 0x80).sum())
    for x, y, *_ in hits:
        s, e = int(w.start[w.doc[d] + x]), int(w.end[w.doc[d] + y - 1])
        first = lead + count(at, s)
        at, lead = e, first + count(s, e)
        out.append((first, lead))
    return out


def _scan_with(automaton) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = automaton.value
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                w = Words(data, offs)
                hits, spans, items = [], [], []
                for d in range(rows.num_rows):
                    h, f = sam.scan(w, d)
                    hits.append([{"first": x, "last": y - 1, "short": z} for x, y, z in h])
                    spans.append([{"start": s, "end": e} for s, e in _char_spans(data, w, d, h, int(offs[d]))])
                    items.append([sam.ids[i] for i in sorted(f)])
                span = _RANGES, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                own = [rows.column(c) for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(w.doc), pa.int64()), pa.array(hits, span[0]), pa.array(spans, span[1]), pa.array(items, pa.list_(pa.string()))], [*[c for c in rows.schema.names if c != "text"], "n_words", "hits", "spans", "items"])

    return run


def _sharded_hits(rows: DataFrame, items: DataFrame, shards: int, window: int) -> DataFrame:
    """(row_no, hits, items) of the rows of ``rows`` (row_no, text) that any shard hits, hits merged over the shards. A shard's
    findings are written before the next automaton is built."""

    def run_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = shared.value
            for batch in batches:
                for part, data, offs in text_slices(batch):
                    w = Words(data, offs)
                    found = [(i, *sam.scan(w, d)) for d, i in enumerate(part.column(0).to_pylist())]
                    found = [x for x in found if x[1]]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([[{"first": a, "last": b - 1, "short": z} for a, b, z in x[1]] for x in found], _RANGES), pa.array([[sam.ids[i] for i in sorted(x[2])] for x in found], pa.list_(pa.string()))], ["row_no", "hits", "items"])

        return run

    merged = None
    for k in range(shards):
        sam = automaton(items, k, shards, window)
        shared = rows.sparkSession.sparkContext.broadcast(sam)
        part = materialize(rows.mapInArrow(run_with(shared), "row_no bigint, hits array<struct<first:bigint,last:bigint,short:boolean>>, items array<string>"), "shard-hits")
        shared.destroy()
        merged = part if merged is None else merged.union(part)
    return merged.groupBy("row_no").agg(
        _union_of(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (doc_id, text, hits, items): the rows of HITS."""
    for batch in batches:
        for rows, data, offs in text_slices(batch):
            w = Words(data, offs)
            hits = [h or [] for h in rows.column("hits").to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in _char_spans(data, w, d, [(x["first"], x["last"] + 1) for x in h], int(offs[d]))] for d, h in enumerate(hits)]
            items = pa.array([i or [] for i in rows.column("items").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(w.doc), pa.int64()), pa.array(hits, _RANGES), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), items], ["doc_id", "n_words", "hits", "spans", "items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, hits (word ranges, both ends within), spans (code points) and items."""
    spark = docs.sparkSession
    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _item_rows(benchmark)
    shards = shard_count(items, most_words)
    if shards == 1:
        return base.mapInArrow(_scan_with(spark.sparkContext.broadcast(automaton(items, 0, 1, window))), HITS)
    # each shard sees every document; a row number that survives retries brings a row's findings together
    rows = materialize(base.withColumn("row_no", F.monotonically_increasing_id()), "documents")
    merged = _sharded_hits(rows.select("row_no", "text"), items, shards, window)
    return rows.join(merged, "row_no", "left").select("doc_id", "text", "hits", "items").mapInArrow(_placed, HITS)


def _union_of(ranges):
    """Merged ascending ranges of an array of hits; at most one entry a shard and range, so the array is small."""
    start = F.array().cast("array<struct<first:bigint,last:bigint,short:boolean>>")

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), (last["short"] | x["short"]).alias("short"))
        return F.when((F.size(acc) > 0) & (last["last"] + 1 >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(ranges), start, step)


def n_hit(hits):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, min_span_words: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` without contamination; columns and their order stay, ``n_chars`` (if present) follows the text.

    Spans of at least ``min_span_words`` hit words, and spans with a whole item that is shorter than a window, are cut out of the
    text; other spans stay, though their words count as hit. A document of
    which more than ``max_coverage`` of the words are hit goes altogether. Both are decided once, by the hits of all items
    in the text as it came, however many shards the items take.
    """
    names = docs.columns
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    items = _item_rows(benchmark)
    shards = shard_count(items, most_words)
    if shards == 1:
        sam = automaton(items, 0, 1, window)
        return docs.mapInArrow(_clean_with(names, max_coverage, min_span_words, docs.sparkSession.sparkContext.broadcast(sam)), schema)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = materialize(plain.withColumn("row_no", F.monotonically_increasing_id()), "documents")
    merged = _sharded_hits(rows.select("row_no", F.col(f"_c{names.index('text')}").cast("string").alias("text")), items, shards, window)
    return rows.join(merged.select("row_no", "hits"), "row_no", "left").select(*plain.columns, "hits").mapInArrow(_clean_with(names, max_coverage, min_span_words), schema)


def _clean_with(names: list[str], max_coverage: float, least: int, shared=None):
    """Over batches of the columns ``names``: hits of at least ``least`` words or with a short item are cut. They are those of the automaton
    ``shared``, or without one those that a last column of the batches holds."""
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            given = None if shared else batch.column(len(names)).to_pylist()
            texts, keep = {}, np.ones(batch.num_rows, bool)
            for rows, data, offs in text_slices(plain):
                w = Words(data, offs)
                for d, row in enumerate(rows.column(1).to_pylist()):
                    hits = shared.value.scan(w, d)[0] if shared else [(x["first"], x["last"] + 1, x["short"]) for x in given[row] or ()]
                    if not hits:
                        continue
                    if sum(y - x for x, y, _ in hits) > max_coverage * (w.doc[d + 1] - w.doc[d]):
                        keep[row] = False
                        continue
                    cut = [(int(w.start[w.doc[d] + x] - offs[d]), int(w.end[w.doc[d] + y - 1] - offs[d])) for x, y, short in hits if short or y - x >= least]
                    raw, done, out = data[offs[d] : offs[d + 1]].tobytes(), 0, []
                    for s, e in cut:
                        out.append(raw[done:s])
                        done = e
                    texts[row] = b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")
            cols = list(batch.columns)[: len(names)]
            if texts:
                cols[at] = pa.array([texts.get(i, t) for i, t in enumerate(cols[at].to_pylist())], cols[at].type)
                if chars is not None:
                    cols[chars] = pa.array([len(texts[i]) if i in texts else n for i, n in enumerate(cols[chars].to_pylist())], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return run


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


#: The same rows in DuckDB.
ORACLE = r"""
WITH word(c) AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT c FROM word)) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT c FROM word)) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, i, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.r, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
