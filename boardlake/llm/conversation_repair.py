"""Operator 13: cheapest repair of the structure of conversations, by depth-first branch-and-bound.

A repaired conversation has the role initials ``(s?(ua)+)?``. Each row is kept (0), gets the role user or assistant (2) or is
deleted (3; a must for blank rows and repeats), empty turns of user or assistant are inserted anywhere (2), and a truncated row that
stays costs 1 more. Of the cheapest edits those count whose initials (D, I, K, R), in order, are least in ASCII; they fix the
result, as every place of the pattern but the first allows one role only.

``search`` walks edits with an explicit stack. A prefix is given up if its cost and the least that the rows left cost after its last
role, whatever the initials, exceed the best complete repair (cost, then initials), or if its node, (rows done, last role), was
reached before by a better prefix. When the stack is empty, the best repair is proved.

As Spark work: rows are dealt by ranges of (conversation, turn, role, text), so a conversation may lie in any number of tasks. What is
seen earlier is one grouping by (conversation, role, text), whose first rows come back by position, so no group is gathered.
A conversation within a range of at most ``SEGMENT`` rows is solved at once. Others are solved in segments, from each role that
may come before to each that may be the last; the segments' ways (costs and initials) are chained in order, each renders its
part of the way taken, and the parts are hashed as a stream, which the order of SHA-256 demands.

Defined cases: null role and text are one space, and so are null ids and turns where the kind of damage is drawn; a null ``conv_id``
is a conversation of its own; null turns come first; rows of one turn follow in order of role, then of the text's first 200
characters, then of its hash; repeated rows are repeats of one another; roles with other initials cannot be kept; a conversation
without rows after damage has zeros and empty texts; an empty table gives no rows; texts of any length are whole; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm.common import materialize, only, table

KEEP_TRUNCATED, INSERT, REROLE, DELETE = 1, 2, 2, 3
SEGMENT = 256
SEGMENT_CHARS = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"
#: The last role of a prefix: none yet, system, user, assistant. ``_NEXT`` is the role that may be put after it.
_LAST = {"": 0, "s": 1, "u": 2, "a": 3}
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {"su", "ua", "au"}


# --- damage and faults ----------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text; a dropped row stays, with ``gone`` set, so that its conversation is known."""
    base = only(rows, "conv_id", "turn", "role", "text")
    drawn = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(drawn("conv_id"), F.lit(":"), drawn("turn")).cast("binary")) % 20
    base = base.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), drawn("role").alias("role"), drawn("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``damaged``) with blank, truncated and ``pos``, which ascends in order of conversations and their rows."""
    ended = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = rows.withColumns({"blank": ended == "", "truncated": ~F.right(ended, F.lit(1)).isin(".", "!", "?"), "_start": F.substring("text", 1, 200), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "role", "_start", "_hash", "_row"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    return materialize(dealt.drop("_start", "_hash", "_row"), "conversation-rows")


# --- the search -----------------------------------------------------------------------------------

_NEVER = 1 << 60


def _edits(row: str, last: int) -> list[tuple[str, int, int]]:
    """(initial, cost, last role then) of what may be done to a row after ``last``."""
    out = [("D", DELETE, last)]
    if row != "x":
        stays, own = row.isupper() * KEEP_TRUNCATED, _LAST.get(row.lower())
        if own is not None and (own == _NEXT[last] or (own == 1 and last == 0)):
            out.append(("K", stays, own))
        out.append(("R", stays + REROLE, _NEXT[last]))
    return out


def _bounds(rows: str, leave: tuple[int, ...]) -> list[list[int]]:
    """What the rows from each place on cost at the least after each last role, whatever the initials. Simpler bounds, such as a
    sum over rows whatever their neighbours, are too weak: the search then takes exponential time on some hundred rows."""
    out = [[_NEVER] * 4 for _ in range(len(rows) + 1)]
    out[-1] = [0 if last in leave else _NEVER for last in range(4)]
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            out[i] = [min(_NEVER, *(c + out[i + 1][to] for _, c, to in _edits(rows[i], last))) for last in range(4)]
        for _ in range(3):  # inserted turns lead from one last role to another
            out[i] = [min(out[i][last], INSERT + out[i][_NEXT[last]]) for last in range(4)]
    return out


def search(rows: str, enter: int = 0, leave: tuple[int, ...] = (0, 3)) -> tuple[int, str] | None:
    """(cost, initials) of the cheapest way through ``rows`` from last role ``enter`` to one of ``leave``; None if there is none.

    Each row is one letter: ``x`` must go; else its initial, ``o`` for any other than s, u and a, in capitals if it is truncated.
    """
    n = len(rows)
    least = _bounds(rows, leave)
    if least[0][enter] == _NEVER:
        return None
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, enter)]
    while stack:
        cost, audit, i, last = stack.pop()
        bound = cost + least[i][last]
        if bound >= _NEVER or best and (bound > best[0] or (bound == best[0] and audit > best[1][: len(audit)])):
            continue
        if (known := seen.get((i, last))) and known <= (cost, audit):
            continue
        seen[i, last] = cost, audit
        if i == n and last in leave and (best is None or (cost, audit) < best):
            best = cost, audit
        nexts = [(cost + INSERT, audit + "I", i, _NEXT[last])]
        if i < n:
            nexts += [(cost + c, audit + e, i + 1, to) for e, c, to in _edits(rows[i], last)]
        nexts.sort(key=lambda x: (x[0] + least[x[2]][x[3]], x[1]), reverse=True)  # the most promising one is on top
        stack += nexts
    return best


#: Many conversations are alike once texts are left out.
_known = lru_cache(1 << 14)(search)


def applied(audit: str, rows: list[tuple[str, str]], last: int = 0) -> list[str]:
    """``role:text`` of the rows (role, text) after the edits, which begin after the last role ``last``."""
    out, at = [], iter(rows)
    for edit in audit:
        if edit == "I":
            last = _NEXT[last]
            out.append(f"{_ROLE[last]}:")
            continue
        role, text = next(at)
        if edit == "K":
            last = _LAST[role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            last = _NEXT[last]
            out.append(f"{_ROLE[last]}:{text}")
    return out


# --- segments in tasks ----------------------------------------------------------------------------

_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("pos", pa.int64()), ("whole", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()), ("last", pa.string()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("repaired", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_SEGMENT_DDL = f"conv_id bigint, pos bigint, whole boolean, low bigint, high bigint, turns bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, first string, last string, costs array<bigint>, audits array<string>, repaired string, roles array<string>, texts array<string>"


class _Segment:
    """Rows of one conversation in order, as they come."""

    def __init__(self, conv: int | None, pos: int):
        self.conv, self.pos = conv, pos
        self.low = self.high = None
        self.turns = self.chars = 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None
        self.letters: list[str] = []
        self.rows: list[tuple[str, str]] = []

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.first, self.last = initial if self.first is None else self.first, initial
        letter = initial if initial in ("s", "u", "a") else "o"
        self.letters.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        self.rows.append((role, text))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT or self.chars >= SEGMENT_CHARS

    def row(self, whole: bool) -> tuple:
        """Solved, if the conversation has no other rows; else with all its ways and its rows."""
        letters = "".join(self.letters)
        known = (self.conv, self.pos, whole, self.low, self.high, self.turns, *self.counts.values(), self.first, self.last)
        if whole:
            cost, audit = _known(letters)
            return *known, [cost], [audit], hashlib.sha256("\n".join(applied(audit, self.rows)).encode()).hexdigest(), None, None
        ways = [_known(letters, enter, (leave,)) for enter in range(4) for leave in range(4)]
        return *known, [w and w[0] for w in ways], [w and w[1] for w in ways], None, [r for r, _ in self.rows], [t for _, t in self.rows]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``pos``, with the mark of a first row just before it, to segments. A task's first and last conversations may go
    on in other tasks, so only those between are whole."""
    now, cut, first, out = None, True, None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("pos", "mark", "conv_id", "turn", "role", "text", "gone", "blank", "truncated")]
        for pos, mark, conv, turn, role, text, gone, blank, truncated in zip(*cols, strict=True):
            if mark:
                first = pos
                continue
            if now is None or now.conv != conv:
                if now:
                    out.append(now.row(whole=not cut))
                now, cut = _Segment(conv, pos), now is None
            elif now.full():
                out.append(now.row(whole=False))
                now, cut = _Segment(conv, pos), True
            if not gone:
                now.add(turn, role, text, "blank" if blank else "duplicate" if pos != first else "truncated" if truncated else None)
            if len(out) >= 256:
                yield _batch(out)
                out = []
    if now:
        out.append(now.row(whole=False))
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENT, strict=True)], schema=_SEGMENT)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of conversations in order to the way taken through each: (pos, way), and one row (pos null) a conversation."""
    names = ["conv_id", "pos", "low", "high", "turns", *_COUNTS, "first", "last", "costs", "audits"]
    conv, state = None, None

    def closed() -> list[tuple]:
        best, at = min((state["best"][q], q) for q in (0, 3) if q in state["best"])
        rows = []
        for pos, back in reversed(state["path"]):
            p = back[at]
            rows.append((conv, pos, 4 * p + at, *[None] * 7))
            at = p
        c = state["counts"]
        gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
        return [*rows, (conv, None, None, gaps, *c, *best)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "pos", "way", "gaps", *_COUNTS, "cost", "audit"])

    for b in batches:
        for conv_id, pos, low, high, turns, *rest in zip(*[b.column(c).to_pylist() for c in names], strict=True):
            *counts, first, last, costs, audits = rest
            if state is None or conv_id != conv:
                if state:
                    yield batch(closed())
                conv, state = conv_id, {"best": {0: (0, "")}, "path": [], "counts": [0] * len(_COUNTS), "low": None, "high": None, "turns": 0, "last": None}
            state["turns"] += turns - (low is not None and low == state["high"])
            state["low"] = low if state["low"] is None else state["low"]
            state["high"] = state["high"] if high is None else high
            border = first is not None and state["last"] is not None and state["last"] + first not in _LEGAL
            state["counts"] = [a + b for a, b in zip(state["counts"], counts, strict=True)]
            state["counts"][_COUNTS.index("illegal")] += border
            state["last"] = state["last"] if last is None else last
            best, back = {}, {}
            for p, (cost, audit) in state["best"].items():
                for q in range(4):
                    if costs[4 * p + q] is not None and (q not in best or (cost + costs[4 * p + q], audit + audits[4 * p + q]) < best[q]):
                        best[q], back[q] = (cost + costs[4 * p + q], audit + audits[4 * p + q]), p
            state["best"] = best
            state["path"].append((pos, back))
    if state:
        yield batch(closed())


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of each segment: conv_id, pos, part (null if nothing is left)."""
    for b in batches:
        for i in range(b.num_rows):
            way = b.column("way")[i].as_py()
            lines = applied(b.column("audits")[i][way].as_py(), list(zip(b.column("roles")[i].as_py(), b.column("texts")[i].as_py(), strict=True)), way // 4)
            yield pa.RecordBatch.from_arrays([b.column("conv_id").slice(i, 1), b.column("pos").slice(i, 1), pa.array(["\n".join(lines) if lines else None], pa.string())], ["conv_id", "pos", "part"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations in order to one hash each, with no more than a part at a time."""
    row = lambda conv, digest: pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired"])
    conv, digest, begun = None, None, False
    for b in batches:
        for i in range(b.num_rows):
            own, part = b.column("conv_id")[i].as_py(), b.column("part")[i].as_py()
            if digest is None or own != conv:
                if digest:
                    yield row(conv, digest)
                conv, digest, begun = own, hashlib.sha256(), False
            if part is not None:
                digest.update((b"\n" if begun else b"") + part.encode())
                begun = True
    if digest:
        yield row(conv, digest)


# --- the operator ---------------------------------------------------------------------------------


def repair(rows: DataFrame) -> DataFrame:
    """Of ``damaged`` rows, per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    dealt = in_order(rows)
    firsts = dealt.filter("not gone").groupBy("conv_id", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).agg(F.min("pos").alias("pos")).select("pos")
    marks = firsts.withColumn("mark", F.lit(True))
    both = dealt.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    ordered = both.repartitionByRange("pos").sortWithinPartitions("pos", F.desc("mark"))
    solved = materialize(ordered.mapInArrow(_segments, _SEGMENT_DDL), "segments")

    shown = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = solved.filter("whole").select("*", gaps.alias("gaps"), F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), F.col("repaired").alias("repaired_sha256"))
    parts = solved.filter("not whole")
    by_place = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    ways = materialize(by_place(parts.drop("roles", "texts", "repaired")).mapInArrow(_chained, f"conv_id bigint, pos bigint, way int, gaps bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, cost bigint, audit string"), "ways")
    rendered = parts.select("conv_id", "pos", "audits", "roles", "texts").join(ways.filter("pos is not null").select("pos", "way"), "pos").mapInArrow(_rendered, "conv_id bigint, pos bigint, part string")
    hashes = by_place(rendered).mapInArrow(_hashed, "conv_id bigint, repaired string")
    ends = ways.filter("pos is null").alias("w").join(hashes.alias("h"), F.col("w.conv_id").eqNullSafe(F.col("h.conv_id"))).select("w.*", F.col("h.repaired").alias("repaired_sha256"))
    return whole.select(*shown).unionByName(ends.select(*shown))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    """DuckDB SQL: a recursion over each conversation's rows with the best (cost, initials, text) after each last role."""
    add = lambda s, cost, edit, line=None: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'o': {s}.o{' || chr(10) || ' + line if line else ''}}} END"
    best = lambda *xs: f"list_min([{', '.join(xs)}])"
    ins = lambda s, role: add(s, INSERT, "I", f"'{role}:'")
    twice = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {2 * INSERT}, 'a': {s}.a || 'II', 'o': {s}.o || chr(10) || 'user:' || chr(10) || 'assistant:'}} END"
    closed = ["s0", "s1", best("s2", ins("s0", "user"), ins("s1", "user"), ins("s3", "user")), best("s3", ins("s2", "assistant"), twice("s0"), twice("s1"))]
    gone = [add(f"c{q}", DELETE, "D") for q in range(4)]
    keep = lambda s, initial: f"CASE WHEN NOT x AND left(role, 1) = '{initial}' THEN {add(s, 't', 'K', 'role || chr(58) || text')} END"
    role = lambda s, to: f"CASE WHEN NOT x THEN {add(s, f't + {REROLE}', 'R', f'{chr(39)}{to}:{chr(39)} || text')} END"
    after = [gone[0], best(gone[1], keep("c0", "s")), best(gone[2], *[keep(s, "u") for s in ("c0", "c1", "c3")], *[role(s, "user") for s in ("c0", "c1", "c3")]), best(gone[3], keep("c2", "a"), role("c2", "assistant"))]
    names = lambda c, xs: ", ".join(f"{x} AS {c}{q}" for q, x in enumerate(xs))
    space = r"[\x09-\x0D ]"
    return rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)) AS bytes FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS f FROM keyed, tab),
kept AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, regexp_replace(text, '{space}+$', '') AS ended FROM kept),
judged AS (SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM placed),
steps AS (SELECT conv_id, n, role, text, fault IN ('blank', 'duplicate') AS x, CASE WHEN fault = 'truncated' THEN {KEEP_TRUNCATED} ELSE 0 END AS t FROM judged),
dp AS (SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''::VARCHAR, 'o': ''::VARCHAR}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, n, {names("n", after)} FROM (SELECT steps.*, {names("c", closed)} FROM dp JOIN steps ON steps.conv_id IS NOT DISTINCT FROM dp.conv_id AND steps.n = dp.n + 1)),
ends AS (SELECT conv_id, list_min([c0, c3]) AS b FROM (SELECT conv_id, {names("c", closed)} FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(substr(b.o, 2)) AS repaired_sha256 FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


ORACLE = _oracle()
