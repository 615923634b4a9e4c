"""The few helpers that Spark has no expressions for: Unicode folding, name similarity, vector top-k, context packing."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from boardlake.sources.scratch import written

# Letters that decomposition leaves as they are.
_FOLD = str.maketrans({"ß": "ss", "ẞ": "ss", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ı": "i", "İ": "i"})
_QUOTES = str.maketrans({"’": "'", "‘": "'", "´": "'", "“": '"', "”": '"'})
_KEPT_SIGNS = frozenset(" _-[]()#.'\":|/\\*+&!?@,`~^")


def alias_key(name: str | None) -> str:
    """Lower-case letters and digits of a name, without marks and number signs."""
    text = unicodedata.normalize("NFKC", (name or "").replace("№", "")).translate(_FOLD)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M")).lower()
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN")


def display_name(name: str | None, most: int = 64) -> str:
    """A name fit for display: folded quotes, no control characters, known signs only, single spaces, cut."""
    text = unicodedata.normalize("NFKC", name or "").translate(_QUOTES)
    text = "".join(" " if unicodedata.category(c).startswith("C") else c for c in text)
    text = "".join(c for c in text if c in _KEPT_SIGNS or unicodedata.category(c)[0] in "LNM")
    return re.sub(r"\s+", " ", text).strip()[:most]


@F.pandas_udf(StringType())
def normalize_alias(names: pd.Series) -> pd.Series:
    return names.map(alias_key)


@F.pandas_udf(StringType())
def nfkc_sanitize(names: pd.Series) -> pd.Series:
    return names.map(display_name)


def jaro(a: str, b: str) -> float:
    """The share of letters that two names have in common near the same place, and of those in the same order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def containment(query: str, other: str) -> float:
    """What one name's being within the other scores at least."""
    if len(query) >= 3 and other.startswith(query):
        return 0.95
    if len(other) >= 3 and query.startswith(other):
        return 0.94
    return 0.9 if (len(query) >= 4 and query in other) or (len(other) >= 4 and other in query) else 0.0


def name_score(query: str, other: str) -> float:
    """Jaro-Winkler, at least .95 to .90 where one name contains the other; four decimals."""
    if not query or not other:
        return 0.0
    if query == other:
        return 1.0
    j = jaro(query, other)
    same = 0
    while same < min(4, len(query), len(other)) and query[same] == other[same]:
        same += 1
    score = max(j + same * 0.1 * (1 - j), containment(query, other))
    return math.floor(score * 10000 + 0.5) / 10000


def score_bound(query: str, count: Counter, other: str) -> float:
    """At least ``name_score``: letters in common however placed, and no swaps."""
    m = sum((count & Counter(other)).values())
    if not m:
        return 0.0
    j = (m / len(query) + m / len(other) + 1) / 3
    return max(j + 0.4 * (1 - j), 0.95 if query in other or other in query else 0.0)


#: Longest name of the vectorised comparison; longer ones are compared one by one.
_LONGEST = 64
#: Pairs that are scored in one go; it bounds the memory taken.
_PAIRS = 1 << 15
#: Numbers of a table of products that are held in one go, for the same reason.
_CELLS = 1 << 18


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths) of names of at most ``_LONGEST`` letters, padded with 0."""
    size = np.array([len(x) for x in names], np.int64)
    out = np.zeros((len(names), max(1, int(size.max(initial=0)))), np.uint32)
    for i, x in enumerate(names):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    return out, size


def _counts(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often each name has letters of each of 64 kinds; letters of one kind may differ, so common counts are bounds."""
    out = np.zeros((len(letters), 64), np.uint8)
    for j in range(letters.shape[1]):
        rows = np.flatnonzero(size > j)
        out[rows, letters[rows, j] & 63] += 1
    return out


def jaro_pairs(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """``jaro`` of many pairs of names that are neither empty nor equal, as code points."""
    pairs, every = len(a), np.arange(len(a))
    place = np.arange(b.shape[1])
    reach = (np.maximum(n_a, n_b) // 2 - 1)[:, None]
    free = place < n_b[:, None]
    hit = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i : i + 1]) & (np.abs(place - i) <= reach) & (n_a > i)[:, None]
        first = fits.argmax(axis=1)
        hit[:, i] = fits[every, first]
        free[every, first] &= ~hit[:, i]
    taken = (place < n_b[:, None]) & ~free
    m = hit.sum(axis=1)
    left, right = np.zeros((pairs, max(1, int(m.max(initial=0)))), np.uint32), np.zeros((pairs, max(1, int(m.max(initial=0)))), np.uint32)
    for own, letters, out in ((hit, a, left), (taken, b, right)):
        row, col = np.nonzero(own)
        out[row, (np.cumsum(own, axis=1) - 1)[row, col]] = letters[row, col]
    swaps = (left != right).sum(axis=1) / 2
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / n_a + m / n_b + (m - swaps) / some) / 3, 0.0)


def scored_pairs(queries: list[str], keys: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, key, score), by number, of all pairs of distinct ``queries`` and ``keys`` whose ``name_score`` is ``least`` or more.

    For each query, letters in common and the common beginning bound the score of all keys at once; pairs within the bound are
    scored together, in parts of bounded size.
    """
    long_q, long_k = ({i for i, x in enumerate(xs) if len(x) > _LONGEST} for xs in (queries, keys))
    kq = [x if i not in long_q else "" for i, x in enumerate(queries)]
    kk = [x if i not in long_k else "" for i, x in enumerate(keys)]
    (a, n_a), (b, n_b) = _letters(kq), _letters(kk)
    c_a, c_b = _counts(a, n_a), _counts(b, n_b)
    head_a, head_b = (np.pad(x[:, :4], ((0, 0), (0, max(0, 4 - x.shape[1])))) for x in (a, b))
    size_b = np.maximum(n_b, 1)

    def score(q: np.ndarray, k: np.ndarray, same: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        j = jaro_pairs(a[q][:, : int(n_a[q].max())], n_a[q], b[k][:, : int(n_b[k].max())], n_b[k])
        out = j + same * 0.1 * (1 - j)
        for i in np.flatnonzero(full).tolist():  # one may contain the other
            out[i] = max(out[i], containment(queries[q[i]], keys[k[i]]))
        out = np.floor(out * 10000 + 0.5) / 10000
        out[[queries[x] == keys[y] for x, y in zip(q.tolist(), k.tolist(), strict=True)]] = 1.0
        keep = out >= least
        return q[keep], k[keep], out[keep]

    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for i, query in enumerate(queries):
        if i in long_q or not query:
            continue
        m = np.minimum(c_b, c_a[i]).sum(axis=1, dtype=np.int64)
        bound = np.where(m > 0, (m / n_a[i] + m / size_b + 1) / 3, 0.0)
        same = np.cumprod((head_b == head_a[i]) & (head_b > 0), axis=1).sum(axis=1)
        full = (m == np.minimum(n_a[i], n_b)) & (n_b > 0)
        near = np.flatnonzero((bound + same * 0.1 * (1 - bound) >= least - 0.0001) & (n_b > 0) | full & (np.minimum(n_a[i], n_b) >= 3))
        if len(near):
            held.append((np.full(len(near), i), near, same[near], full[near]))
            n += len(near)
        if n >= _PAIRS:
            yield score(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield score(*(np.concatenate(x) for x in zip(*held, strict=True)))
    if long_q or long_k:
        pairs = [(i, k) for i in range(len(queries)) for k in (range(len(keys)) if i in long_q else long_k)]
        rows = [(i, k, s) for i, k in pairs if keys[k] and queries[i] and score_bound(queries[i], Counter(queries[i]), keys[k]) >= least and (s := name_score(queries[i], keys[k])) >= least]
        if rows:
            yield tuple(np.array(x) for x in zip(*rows, strict=True))


def similar_names(queries: DataFrame, players: DataFrame, least: float = 0.72, block: int = 4096) -> DataFrame:
    """(query, player, key, score) of pairs that score ``least`` or more: ``queries`` (query: distinct keys) against all
    ``players`` (player, key). Both are dealt by hash into blocks of about ``block`` rows, and each block of the one meets each
    of the other in a task of its own; names that are alike in letters only in part can score, so no index would do."""
    cut = lambda df, c: max(1, -(-df.count() // block))
    players = players.select("player", "key").filter("key <> ''")
    queries = queries.select("query").filter("query <> ''")
    n_q, n_p = cut(queries, "query"), cut(players, "key")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_q = max(n_q, -(-parts // n_p))  # a cell for each task at least
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select("query", own("query", n_q).alias("i"), every(n_p).alias("j"))
    p = players.select("player", "key", own("player", n_p).alias("j"), every(n_q).alias("i"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, keys, ids = left["query"].tolist(), right["key"].tolist(), right["player"].to_numpy()
        found = list(scored_pairs(names, keys, least))
        x, y, z = (np.concatenate([np.zeros(0, t), *v]) for t, v in zip((int, int, float), zip(*found, strict=True), strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        text = lambda xs, at: pd.Series([xs[i] for i in at], dtype=object)
        return pd.DataFrame({"query": text(names, x), "player": ids[y], "key": text(keys, y), "score": z})

    return q.groupBy("i", "j").cogroup(p.groupBy("i", "j")).applyInPandas(cell, "query string, player bigint, key string, score double")


def similar_players(queries: DataFrame, players: DataFrame, least: float = 0.72) -> DataFrame:
    """(query, player, score): the larger of the similarities of alias keys and of shown names, of ``queries`` (query, key,
    shown) and ``players`` (player, key, shown)."""
    out = None
    for c in ("key", "shown"):
        names = queries.select("query", F.col(c).alias("_n"))
        found = similar_names(names.select(F.col("_n").alias("query")).distinct(), players.select("player", F.col(c).alias("key")), least)
        part = names.join(found.withColumnRenamed("query", "_n").select("_n", "player", "score"), "_n").select("query", "player", "score")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query", "player").agg(F.max("score").alias("score"))


def cosine_top_k(queries: DataFrame, docs: DataFrame, k: int, block: int = 2048, most_cells: int = 256) -> DataFrame:
    """(query_id, doc_id, score, place): the ``k`` documents nearest to each query by cosine (ties by doc_id), zero vectors 0. Exact.

    Documents are dealt to cells by the nearest of up to ``most_cells`` centres (documents of the smallest hashes), once, as a table. A
    cell's radius and count bound how near and how far all its documents are: a query's ``k``-th best is no farther than the
    nearest cells that hold ``k`` documents reach, and a cell that begins beyond that is not opened for it (triangle inequality). What
    is left is dealt in blocks of about ``block`` documents and as many queries, each a matrix product in a task of its own
    that hands on ``k`` rows a query. Both sides stay tables; what the driver sees is a row for each cell.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "vector").filter("vector is not null")
    queries = queries.select("query_id", "vector").filter("vector is not null")
    cells = opened_cells(queries, docs, block, most_cells, k)
    if cells is None:
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, place int")
    placed, pairs, sizes = cells
    per = {r.cell: r.n for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cuts = [(c, -(-n // block), -(-per.get(c, 0) // block)) for c, n in sizes.items()]
    cut = F.broadcast(spark.createDataFrame(cuts, "cell int, d_parts int, q_parts int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q = pairs.join(cut, "cell").select("query_id", "vector", "cell", own("query_id", "q_parts").alias("i"), every("d_parts").alias("j"))
    d = placed.join(cut, "cell").filter("q_parts > 0").select("doc_id", "vector", "cell", own("doc_id", "d_parts").alias("j"), every("q_parts").alias("i"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        doc = right["doc_id"].to_numpy()
        a, b = (_unit(np.stack(x["vector"].to_numpy()).astype(np.float64)) for x in (left, right))
        order, scores = (np.concatenate(x) for x in zip(*nearest(a, b, doc, k), strict=True))
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), order.shape[1]), "doc_id": doc[order].ravel(), "score": scores.ravel()})

    from pyspark.sql.window import Window

    best = q.groupBy("cell", "i", "j").cogroup(d.groupBy("cell", "i", "j")).applyInPandas(meet, "query_id bigint, doc_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def opened_cells(queries: DataFrame, docs: DataFrame, block: int, most_cells: int, k: int) -> tuple[DataFrame, DataFrame, dict[int, int]] | None:
    """(documents with their cell, queries with each cell that they open, documents of each cell); None without documents.

    Zero vectors are no unit vectors: documents of that kind are cell -1, which all open, and queries of that kind open all."""
    spark = docs.sparkSession
    n = docs.count()
    if not n:
        return None
    most = max(1, min(most_cells, n // block + 1))
    # centres are directions of documents, so zero vectors make none
    some = docs.filter(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("doc_id")).limit(most).collect()
    centres = _unit(np.array([r.vector for r in some], np.float64)) if some else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(np.stack(b.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64))
                zero = ~unit.any(axis=1)
                at, away = np.zeros(len(unit), np.int64), np.full(len(unit), np.sqrt(2.0))
                for part in _slices(len(unit), len(shared.value)) if len(shared.value) else ():
                    dots = unit[part] @ shared.value.T
                    at[part] = dots.argmax(axis=1)
                    away[part] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(axis=1)))
                cell = np.where(zero, -1, at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("vector"), pa.array(cell), pa.array(np.where(zero, 0.0, away))], ["doc_id", "vector", "cell", "away"])

    kind = docs.schema["vector"].dataType.simpleString()
    placed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "vector").mapInArrow(place, f"doc_id bigint, vector {kind}, cell int, away double"), "cells")
    stats = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    ids = np.array(sorted(c for c in stats if c >= 0), np.int32)
    count, radius = np.array([stats[c][0] for c in ids]), np.array([stats[c][1] for c in ids])
    zeros = -1 in stats

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(np.stack(b.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64))
            for rows, cell in opened_by(unit, shared.value[ids] if len(ids) else np.zeros((0, unit.shape[1])), ids, count, radius, k, zeros):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("vector").take(at), pa.array(cell, pa.int32())], ["query_id", "vector", "cell"])

    kind = queries.schema["vector"].dataType.simpleString()
    pairs = written(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInArrow(open_, f"query_id bigint, vector {kind}, cell int"), "opened")
    return placed, pairs, {c: n for c, (n, _) in stats.items()}


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Rows of a table of ``width`` columns, in parts of about ``_CELLS`` numbers."""
    step = max(1, _CELLS // max(1, width))
    return (slice(i, i + step) for i in range(0, rows, step))


def opened_by(unit: np.ndarray, centres: np.ndarray, ids: np.ndarray, count: np.ndarray, radius: np.ndarray, k: int, zeros: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) of the cells ``ids`` that queries open, a part of the queries at a time; with ``zeros`` each opens cell -1 too."""
    for part in _slices(len(unit), len(ids)):
        own = unit[part]
        opened = np.ones((len(own), len(ids)), bool)
        if len(ids):
            away = np.sqrt(np.maximum(0, 2 - 2 * (own @ centres.T)))
            order = np.argsort(away + radius, axis=1)
            enough = np.cumsum(count[order], axis=1) >= k
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(ids) - 1)
            reach = np.take_along_axis(away + radius, order, axis=1)[np.arange(len(own)), last]
            reach = np.where(enough.any(axis=1), reach, np.inf)
            opened = (away - radius <= reach[:, None] + 1e-9) | ~own.any(axis=1)[:, None]
        rows, cols = np.nonzero(opened)
        cell = ids[cols]
        if zeros:
            rows, cell = np.concatenate([rows, np.arange(len(own))]), np.concatenate([cell, np.full(len(own), -1, np.int32)])
        yield rows + part.start, cell


def nearest(a: np.ndarray, b: np.ndarray, doc: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, similarities) of the ``k`` of ``b`` that are nearest to each of ``a`` (unit vectors), a part of ``a`` at a time."""
    for part in _slices(len(a), len(b)):
        sims = np.round(a[part] @ b.T, 12)  # the last bits depend on the shape of a block
        order = _largest(sims, doc, k)
        yield order, np.take_along_axis(sims, order, axis=1)


def _largest(sims: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, equal ones by ascending ``doc``; all that tie with the last are weighed."""
    if sims.shape[1] <= k:
        return np.lexsort((np.broadcast_to(doc, sims.shape), -sims), axis=1)
    by_doc = np.argsort(doc, kind="stable")
    sims = sims[:, by_doc]
    edge = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
    rank = np.where(sims > edge, 0, np.where(sims == edge, np.cumsum(sims == edge, axis=1), sims.shape[1] + 1))
    room = k - (sims > edge).sum(axis=1, keepdims=True)
    pick = np.nonzero(rank <= room)[1].reshape(len(sims), k)
    return by_doc[np.take_along_axis(pick, np.argsort(-np.take_along_axis(sims, pick, axis=1), axis=1, kind="stable"), axis=1)]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


_CONTROLS = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]")


def context_text(text: str | None, most: int = 30_000) -> str:
    """A text as contexts hold it: composed, with plain line ends, no control characters and at most one empty line, trimmed, cut."""
    text = unicodedata.normalize("NFKC", text or "").replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", _CONTROLS.sub(" ", text)).strip()[:most]


def pack_context(sources: DataFrame) -> DataFrame:
    """Per pack the sources chosen under its token budget (a token is four characters, rounded up).

    Texts are cleaned first (``context_text``; summaries of 12,000 characters at most); a source without content is left out. In
    order of critical, priority (50 if null) and place a source is taken whole if it fits, else its summary. A critical one of which
    neither fits is clipped to what is left, from its summary if that fits no better, but to 120 characters at least, so
    it is dropped where less than that is left and it is longer. Columns: pack, place, content, summary, critical, priority, budget.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["priority"] = pdf["priority"].fillna(50)
        pdf = pdf.sort_values(["critical", "priority", "place"], ascending=[False, False, True], kind="stable")
        left, out = int(pdf["budget"].iloc[0]) if len(pdf) else 0, []
        tokens = lambda t: -(-len(t) // 4)
        for r in pdf.itertuples():
            body, short = context_text(r.content), context_text(r.summary, 12_000)
            if not body:
                continue
            how, text = "full", body
            if tokens(text) > left and short and tokens(short) <= left:
                how, text = "summary", short
            if tokens(text) > left and r.critical:
                clipped = context_text(text, max(120, left * 4))
                if clipped and tokens(clipped) <= left:
                    how, text = "clipped", clipped
            if tokens(text) <= left:
                out.append((r.pack, r.place, how, tokens(text)))
                left -= tokens(text)
        return pd.DataFrame(out, columns=["pack", "place", "how", "tokens"])

    return sources.groupBy("pack").applyInPandas(one, "pack bigint, place bigint, how string, tokens bigint")
