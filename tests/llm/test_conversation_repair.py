"""Operator 13 against plain versions: the search against all edits by cost, the operator against one conversation after another."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from boardlake.llm import conversation_repair as cr

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Dijkstra over (cost, edits) with the roles written so far, matched against the pattern's prefixes."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        short = roles[-1:] if roles[-1:] in ("a", "s", "") else "u"
        if (i, short) in done:
            continue
        done.add((i, short))
        if i == len(rows) and PATTERN.fullmatch(roles):
            return cost, audit
        ok = lambda r: PATTERN.fullmatch(r) or PATTERN.fullmatch(r + "a") or PATTERN.fullmatch(r + "ua")
        for r in "ua":
            if ok(roles + r):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + r))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles))
            if not must_go:
                if initial in ("s", "u", "a") and ok(roles + initial):
                    heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, roles + initial))
                for r in "ua":
                    if ok(roles + r):
                        heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, roles + r))
    raise AssertionError


def letters(rows):
    return "".join("x" if gone else (c if c in ("s", "u", "a") else "o").upper() if t else (c if c in ("s", "u", "a") else "o") for c, gone, t in rows)


def test_search_equals_plain():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 6, 8, 12, 20] * 40:
        rows = [(rng.choice("suauaua t"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        assert cr.search(letters(rows)) == cheapest(rows)


def test_long_searches_end():
    rng = random.Random(4)
    began = time.time()
    for alphabet in ("su", "oO", "uuUaAx", "suaSUAoOx", "s", "uA"):
        rows = "".join(rng.choice(alphabet) for _ in range(cr.SEGMENT))
        for enter in range(4):
            for leave in range(4):
                cr.search(rows, enter, (leave,))
    assert time.time() - began < 60


def plain(rows):
    """(conv_id, turn, role, text) to the operator's rows."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest([(c, f in ("blank", "duplicate"), f == "truncated") for c, f in zip(initials, faults, strict=True)])
        made, at, last = [], iter(kept), ""
        for e in audit:
            need = "assistant" if last == "u" else "user"
            if e == "I":
                made.append((need, ""))
            else:
                _, role, text = next(at)
                if e != "D":
                    made.append((role if e == "K" else need, text))
            last = made[-1][0][:1] if made else ""
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def some(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Hello.", "What is it?", "no end", " \t\n", "", None, "Yes!", "é…", "x" * 3000 + ".", "a\nb.", "wait...  \r\n"]
    out = []
    for conv in [None, *range(conversations)]:
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 1, 2, 5])
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice('.!?x')}"
            out.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return out


def result(spark, rows, parts=6):
    schema = "conv_id bigint, turn bigint, role string, text string, POS string, mark string"
    df = spark.createDataFrame([(*r, "p", "m") for r in rows], schema).repartition(parts)
    return sorted((tuple(r) for r in cr.repair(cr.damaged(df)).collect()), key=str)


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_equals_plain(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = some(segment, 40, 14)
    assert result(spark, rows) == plain(rows)


def test_one_long_conversation(spark):
    """Most rows are of one conversation, which takes many segments and several tasks."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"{rng.randint(0, 900)}{rng.choice('.?x')}") for t in range(3000)]
    rows += [r for r in some(2, 12, 5) if r[0] != 7]
    assert result(spark, rows) == plain(rows)


def test_nulls_and_repeats(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "user", "a."), (2, None, "assistant", None)]
    assert result(spark, rows) == plain(rows)
    assert result(spark, []) == []


def test_dropped_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(spark, [(conv, 0, "user", "gone.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 600_000 + "."), (1, 1, "assistant", "ok."), (1, 2, "user", "word " * 600_000 + "."), (2, 0, "user", "hi.")]
    assert result(spark, rows) == plain(rows)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in cr.op13_conversation_repair(spark, SF).collect()), key=str) == plain(rows)
