"""Operator 12: secrets, by linking the parts of credentials.

The base patterns (assign, access, hex) are always reported. Weak candidates are too common to be reported by themselves: short
or quoted values of secret-like names, random-looking words, names of users and clients, addresses of services. A credential has
parts that complement one another, so a weak candidate counts only beside its complement: an identifier or an endpoint beside a
secret, a secret beside either. Base matches take part: assign and hex as secrets, access as identifiers.

Beside means in one scope and at most ``REACH`` characters apart, without overlap; scopes are parted by blank lines. The join is one of
intervals: the reach before and after each weak part is looked up among the ends and starts of complementary parts, which are in
order, so no pairs are formed and texts with any number of parts take near-linear time. An address with a user and a password in
it is three parts.

Texts are sifted with Arrow's linear-time patterns first; only those that may hold a secret are looked at in Python. Weak parts
that overlap a base match go, then those that overlap one before them (the longer of two that begin together stays).

Defined cases: null text is empty and has no spans; repeated rows are judged one by one; an empty table gives no rows; texts of any
length are whole; offsets are code points, end exclusive; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm.common import only, table

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ORDER = {k: i for i, k in enumerate(KINDS)}
REACH = 160
_ROLE = {"assign": "secret", "hex": "secret", "access": "identifier"}
_COMPLEMENTS = {"identifier": ("secret",), "endpoint": ("secret",), "secret": ("identifier", "endpoint")}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter match hides no longer one, as both end together
_HEX = re.compile(r"[0-9a-f]{16,}")
_IS = r"""["']?[ \t]*(?:[:=]|=>|:=)[ \t]*["']?"""
_WEAK = [
    ("identifier", re.compile(rf"(?<![A-Za-z0-9])(?:(?:aws[_-]?)?access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:[_-]?name)?|uid|login|account(?:[_-]?id)?|email){_IS}[A-Za-z0-9@._-]{{3,}}", re.I | re.A)),
    ("identifier", re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}")),
    ("secret", re.compile(rf"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase)?|pwd|(?:client|access|shared)?[_-]?secret(?:[_-]?(?:access)?[_-]?key)?|(?:auth|access|bearer)?[_-]?token|(?:api|private|access)[_-]?key|credentials?){_IS}[^\s"']{{4,}}""", re.I | re.A)),
    ("endpoint", re.compile(rf"(?<![A-Za-z0-9])(?:host(?:[_-]?name)?|server|endpoint|database(?:[_-]?url)?|base[_-]?url|bucket|region){_IS}[A-Za-z0-9][A-Za-z0-9._:/-]{{2,}}", re.I | re.A)),
    ("endpoint", re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}(?![0-9])")),
]
_URL = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,30}://(?:([^\s/:@"'<>]{1,256}):([^\s/@"'<>]{1,1024})@)?[^\s"'<>@]+""")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

#: What a text must have, in one of these, to hold a secret of any kind.
_SIFT = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}"}
_SIFT_WEAK = r"(?i:pass|pwd|secret|token|key|credential)[A-Za-z_-]*[\"']?[ \t]*[:=]|://[^\s/:@\"'<>]+:[^\s/@\"'<>]+@|[A-Za-z0-9+/_-]{20}"


def base_spans(text: str, kinds: tuple[str, ...] = ("assign", "access", "hex")) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind."""
    out = []
    if "assign" in kinds:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "access" in kinds:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    if "hex" in kinds:
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _random_looking(s: str) -> bool:
    """Upper and lower case and digits, and changes between them that words do not have."""
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    return {"d", "u", "l"} <= set(classes) and 4 * sum(a != b for a, b in zip(classes, classes[1:], strict=False)) >= len(s)


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(role, start, end) of weak candidates in order, which overlap neither base spans nor one another."""
    found = [(role, m.start(), m.end()) for role, form in _WEAK for m in form.finditer(text)]
    for m in _URL.finditer(text):
        if m[1] is None:
            found.append(("endpoint", m.start(), m.end()))
        else:  # the address is what follows the sign
            found += [("identifier", *m.span(1)), ("secret", *m.span(2)), ("endpoint", m.end(2) + 1, m.end())]
    found += [("secret", m.start(), m.end()) for m in _RANDOM.finditer(text) if _random_looking(m.group())]
    starts, reach, most = [a for _, a, _ in base], [], 0  # ends so far, of base spans in order of their starts
    for _, _, b in base:
        most = max(most, b)
        reach.append(most)
    out, end = [], 0
    for role, a, b in sorted(found, key=lambda s: (s[1], -s[2], ORDER[s[0]])):
        before = bisect_left(starts, b)  # base spans that begin before the part ends
        if a >= end and not (before and reach[before - 1] > a):
            out.append((role, a, b))
            end = b
    return out


def linked(text: str, base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The weak parts that have a complement beside them."""
    roles: dict[str, list[tuple[int, int]]] = {"identifier": [], "secret": [], "endpoint": []}
    for kind, a, b in [*base, *weak]:
        roles[_ROLE.get(kind, kind)].append((a, b))
    starts = {r: sorted(a for a, _ in spans) for r, spans in roles.items()}
    ends = {r: sorted(b for _, b in spans) for r, spans in roles.items()}
    borders = [m.start() for m in _BLANK_LINE.finditer(text)]

    def beside(role: str, a: int, b: int) -> bool:
        at = bisect_right(borders, a)
        low = max(a - REACH, borders[at - 1] + 1 if at else 0)
        at = bisect_left(borders, b)
        high = min(b + REACH, borders[at] if at < len(borders) else len(text))
        i, j = bisect_left(ends[role], low), bisect_left(starts[role], b)
        return (i < len(ends[role]) and ends[role][i] <= a) or (j < len(starts[role]) and starts[role][j] <= high)

    return [(role, a, b) for role, a, b in weak if any(beside(r, a, b) for r in _COMPLEMENTS[role])]


def spans(text: str, kinds: tuple[str, ...] = ("assign", "access", "hex")) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans); ``kinds`` are those of the base that the text may have."""
    base = base_spans(text, kinds)
    return base, sorted(base + linked(text, base, weak_parts(text, base)), key=lambda s: (s[1], ORDER[s[0]]))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base (spans of the base patterns) and spans (all)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            may = {k: pc.match_substring_regex(texts, form).to_pylist() for k, form in _SIFT.items()}
            weak = pc.match_substring_regex(texts, _SIFT_WEAK).to_pylist()
            base, all_ = [], []
            for i in range(b.num_rows):
                kinds = tuple(k for k in _SIFT if may[k][i])
                own = spans(texts[i].as_py(), kinds) if kinds or weak[i] else ([], [])
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own[0]])
                all_.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own[1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(all_, kind)], ["doc_id", "base", "spans"])

    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id bigint, base {_SPAN}, spans {_SPAN}")


def op12_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
