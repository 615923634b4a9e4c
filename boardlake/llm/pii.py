"""Operator 2: personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: the base patterns (email, ip, card, phone), and looser forms
of them and of secrets. Base matches that hold are always redacted. Boosted trees, some for each kind, judge the loose candidates by
format and context; thresholds, one for each kind, are calibrated to ``PRECISION`` on held-out candidates; of the
candidates that pass, the best by score that overlap nothing chosen before are taken.

There are no labelled spans, so the fit makes them: into places of every distinct text it plants made-up data in
varied forms (``_personal``), and what only looks like it: versions, dates, prices, serial numbers, words after ``password:``
(``_harmless``). What the generators then propose there is an example; its label is how the text was planted, and
nothing in the features tells that. A candidate that takes in only part of planted data, or prose behind it, is negative. All examples
of all texts are learnt from: cuts come from counts of all values, trees from sums over all examples, one Spark job a level of all kinds' trees,
thresholds from the scores of all that are held out. Whole numbers are added up, so the model doesn't depend on how the table is split.

Defined cases: null text is empty and has no spans; repeated rows are judged one by one; an empty table gives no rows and
a model that adds nothing; texts of any length are whole; offsets are code points, end exclusive; other columns pass ``redact``
unchanged.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlake.llm.boosting import BLOCK, LEVELS, BoostedTrees, boost, calibrated_threshold, codes, quantiles
from boardlake.llm.common import discard, only, scratch, table

KINDS = ("email", "ip", "card", "phone", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
PRECISION = 0.97

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]{1,3}[0-9]{3,7}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?|\(?0?[0-9]{2,4}\)?[ .-])(?:[0-9]{2,4}[ .-]?){2,4}(?![0-9])"),
}
_SIGN = re.compile(r"\(at\)|\[at\]|@")
#: What follows the sign; in the second form a plain dot with a space on one side only, as prose has it, ends the address.
_BEHIND = (re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,})+"), re.compile(r" ?[A-Za-z0-9-]+(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.| \. )[A-Za-z0-9-]{2,})+"))
_SECRET = re.compile(r"AKIA[0-9A-Z]{8,24}|(?:password|passwd|pwd|token|secret|api[_-]?key)[ \t]*[=:][ \t]*[\"']?[^\s\"']{4,}[\"']?", re.I)
_VALUE = re.compile(r"[=:][ \t]*[\"']?([^\s\"']+)")
_TOP = re.compile(r"[A-Za-z0-9]+$")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_HINT = re.compile("akia|passw|pwd|token|secret|api", re.I)
_WORDS = {k: re.compile(v, re.I) for k, v in {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|account", "phone": "phone|call|tel|fax|mobile", "secret": "pass|token|secret|key"}.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; a match must hold an ``@``, and its local part reaches back to the last match at most."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then kind: matches of the base patterns that hold."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    out.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return out


def _octets(ip: str) -> bool:
    """Parts at most 255, however many zeros lead them."""
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in ip.split("."))


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _DIGIT.search(text):
        out += [(k, m.start(), m.end()) for k in ("ip", "card") for m in _LOOSE[k].finditer(text)]
        out += [("phone", m.start(), m.start() + len(m.group().rstrip(" .-"))) for m in _LOOSE["phone"].finditer(text)]
    elif "::" in text or text.count(":") > 2:  # an address may be of letters only
        out += [("ip", m.start(), m.end()) for m in _LOOSE["ip"].finditer(text)]
    if "@" in text or "at)" in text or "at]" in text:
        out += [("email", a, b) for a, b in _loose_emails(text)]
    if _HINT.search(text):
        out += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text)]
    return sorted(set(out), key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each sign, as far as the address goes on either side."""
    for m in _SIGN.finditer(text):
        start = end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        while start < end and not (text[start].isalnum() and text[start].isascii()):
            start += 1
        if start < end:
            for form in _BEHIND:
                if x := form.match(text, m.end()):
                    yield start, x.end()


# Words that tell of something else than personal data, and words that often stand where a secret could.
_OTHER = re.compile(r"order|ref|invoice|isbn|version|release|ticket|serial|page|room|total|price|each|date|ratio|section|batch|build|pts", re.I)
_STATUS = frozenset("required none yes no null true false optional invalid expired reset missing empty unknown changed forgotten protected needed see enter your the this that field must should will not nil undefined default below above hidden".split())


def span_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Of the span's format and its context."""
    s, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 12]
    n = max(1, len(s))
    digits = _NOT_DIGIT.sub("", s)
    count = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    groups = [len(g) for g in re.findall("[0-9A-Za-z]+", s)]
    runs = [len(g) for g in re.findall("[0-9]+", s)]
    value = (_VALUE.search(s) or [s, s])[1].rstrip(".,;:!?)")
    classes = sum(any(map(c, value)) for c in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    top = _TOP.search(s)
    colons = s.split(":")
    return [
        float(n), float(len(digits)), len(digits) / n, sum(c.isalpha() for c in s) / n, sum(c.isupper() for c in s) / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n, entropy,
        float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("/")), float(s.count(":")), float("@" in s), float("(at)" in s or "[at]" in s), float("dot" in s), float(". " in s), float(" . " in s),
        float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(len(runs)), float(runs[0] if runs else 0), float(runs[-1] if runs else 0), float(runs[1] if len(runs) > 1 else 0), float(max(runs, default=0)), float(min(runs, default=0)),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0, float(s[:2] == "00"), float(s[0] == "0"), float(s[0] == "("), len(set(digits)) / max(1, len(digits)), float("::" in s), float(len(colons)), sum(map(len, colons)) / len(colons),
        float(len(top[0]) if top else 0), float(bool(top) and top[0].isalpha()), float(bool(top) and top[0].islower()), float(len(value)), float(classes), float("=" in s), float('"' in s or "'" in s), float(value.lower() in _STATUS), float(s[:4] == "AKIA"),
        float(bool(_WORDS[kind].search(before))), float(bool(_OTHER.search(before)) or bool(_OTHER.search(after))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in ("", "\n")), float(after[:1] == " " and after[1:2].islower()), float(after[:1] in (",", ".", ";")),
    ]


# --- made-up data ------------------------------------------------------------------------------------


def _digits(r: random.Random, n: int, first: str = "123456789") -> str:
    return r.choice(first) + "".join(r.choices("0123456789", k=n - 1)) if n else ""


def _word(r: random.Random, most: int = 4) -> str:
    return "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(2, most))) + r.choice(["", "", "n", "s", "t"])


def _split(s: str, sizes: tuple[int, ...], sep: str) -> str:
    ends = list(itertools.accumulate(sizes))
    return sep.join(s[a:b] for a, b in zip([0, *ends], [*ends, len(s)], strict=False) if s[a:b])


def _card_number(r: random.Random, valid: bool) -> tuple[str, tuple[int, ...]]:
    size, cuts = r.choice([(16, (4, 4, 4, 4)), (16, (4, 4, 4, 4)), (15, (4, 6, 5)), (14, (4, 6, 4)), (19, (4, 4, 4, 7))])
    body = _digits(r, size - 1, "3456")
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if valid else r.choice([c for c in "0123456789" if c != check])), cuts


def _personal(kind: str, r: random.Random) -> str:
    """Made-up data of the kind, in some loose form."""
    if kind == "email":
        at = r.choice([" (at) ", "(at)", "[at]", " [at] ", " @ ", "@ ", " @", "@"])
        dot = r.choice([" (dot) ", "(dot)", "[dot]", " [dot] ", " . "] if at == "@" else [" (dot) ", "(dot)", "[dot]", " . ", ".", "."])
        local = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}_{_digits(r, 2)}", f"{_word(r)}+{_word(r)}", f"{_word(r)}{_digits(r, 3)}"])
        labels = [_word(r) for _ in range(r.choice([1, 1, 1, 2]))] + [r.choice(["com", "org", "net", "de", "io", "example", "fr", "info", "edu", _word(r, 2)])]
        return local + at + dot.join(labels)
    if kind == "ip":
        g = lambda: f"{r.randrange(1 << r.choice([4, 8, 12, 16, 16, 16])):x}"
        n = r.randint(1, 4)
        head = [r.choice(["2001", "fe80", "2a02", "fd" + g()[:2], g()]), *[g() for _ in range(n - 1)]]
        if r.random() < 0.2:
            width = r.choice([3, 4])
            return ":".join(f"{r.randrange(1 << 4 * width):0{width}x}" for _ in range(8))
        return ":".join(g() for _ in range(8)) if r.random() < 0.4 else ":".join(head) + "::" + ":".join(g() for _ in range(r.randint(1, 3)))
    if kind == "card":
        number, cuts = _card_number(r, True)
        return _split(number, cuts, r.choice([".", "/", " - ", "  ", " / ", "--", " . "]))
    if kind == "phone":
        sep = r.choice([" ", "-", "."])
        a, b, c = _digits(r, 3, "23456789"), _digits(r, 3, "23456789"), _digits(r, 4)
        return r.choice([
            f"00{_digits(r, 2)}{sep}{a}{sep}{b}{sep}{c}", f"00{_digits(r, 2)}{sep}{a}{sep}{c}{sep}{b}", f"001{sep}{a}{sep}{b}{sep}{c}", f"00{_digits(r, 2)}{a}{b}{c}", f"{a}{sep}{b}{sep}{c}", f"({a}) {b}{sep}{c}",
            f"(0{_digits(r, 2)}) {b}{sep}{c}", f"0{_digits(r, 3)}{sep}{b}{sep}{c}", f"0{_digits(r, 1)} " + " ".join(_digits(r, 2) for _ in range(4)),
        ])
    key = r.choice(["password", "Password", "passwd", "pwd", "token", "secret", "api_key", "API-KEY", "apikey"])
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    some = lambda of, least, most: "".join(r.choices(of, k=r.randint(least, most)))
    value = r.choice([  # made only when chosen
        lambda: _word(r) + _digits(r, 2), lambda: _word(r).capitalize() + _digits(r, 2) + r.choice("!?#$"), lambda: some(letters, 6, 40), lambda: "".join(r.choices("0123456789abcdef", k=r.choice([8, 16, 32, 40]))),
        lambda: _word(r, 3) + _word(r, 3), lambda: _word(r).upper() + _word(r), lambda: _word(r) + r.choice("-_.!@") + _word(r), lambda: some(letters + "@.!#-", 10, 40), lambda: _word(r) + r.choice("!#$") + _digits(r, 2), lambda: _word(r).upper() + _digits(r, 4) + _word(r), lambda: some("abcdefghijklmnopqrstuvwxyz", 7, 11), lambda: some(letters, 150, 260),
    ])()
    quote = r.choice(["", "", "", '"', "'"])
    return f"{key}{r.choice(['=', '=', ': ', ':', ' = '])}{quote}{value}{quote}"


def _harmless(kind: str, r: random.Random) -> str:
    """Made-up text that the generators may propose, without data of the kind."""
    d = lambda n: _digits(r, n)
    day = f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}", str(r.randint(1950, 2040))
    if kind == "email":
        return r.choice([f"{_word(r)} @ {_word(r)}. {_word(r)}", f"{d(2)} @ {d(2)}.{d(2)}", f"{_word(r)} (at) {_word(r)}. {_word(r).capitalize()}", f"{_word(r)} @ {d(1)}.{d(2)} each", f"@{_word(r)}. {_word(r).capitalize()} {_word(r)}", f"{_word(r)} [at] {_word(r)} . {_word(r)} {_word(r)}", f"{_word(r)}@{_word(r)}. {_word(r)}"])
    if kind == "ip":
        return r.choice([":".join(f"{r.randrange(256):02x}" for _ in range(r.choice([6, 8]))), f"{d(2)}:{day[1]}:{day[0]}:{d(2)}", ":".join(d(1) for _ in range(r.randint(4, 6))), f"{r.randint(10, 23)}:{day[1]}:{day[0]}:{d(3)}", ":".join(str(r.randint(1, 30)) for _ in range(4)), f"{_word(r)[:1]}::{d(1)}"])
    if kind == "card":
        number, cuts = _card_number(r, False)
        if r.random() < 0.3:  # as serial numbers begin
            number = next(n for c in range(10) if not luhn(n := f"{day[2]}{number[4:-1]}{c}"))
        return r.choice([_split(number, cuts, r.choice([".", "/", " - ", "  ", " / ", "--"])), f"{day[2]}-{d(4)}-{d(4)}", f"{day[2]}/{d(4)}/{d(3)}", f"{day[2]} - {day[2]} - {day[2]}"])
    if kind == "phone":
        return r.choice([
            f"{day[2]}-{day[0]}-{day[1]} {r.randint(10, 23)}", f"{day[0]}-{day[1]}-{day[2]} {d(2)}", f"{d(3)} {d(3)}", f"{d(2)}-{d(2)} {d(2)}-{d(2)}", f"{day[2]}-{d(6)}-{d(1)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(2)} {d(3)} {d(2)}", f"{day[1]}.{day[0]}.{day[2]}", f"{d(4)} {day[2]} {d(2)}",
            f"order {d(3)}-{d(3)}-{d(4)}", f"serial 0{d(3)}-{d(3)}-{d(4)}", f"isbn {d(3)} {d(3)} {d(4)}", f"{d(4)}.{d(4)}.{d(4)}", f"{day[2]} {day[2]} {day[2]}",
        ])
    key = r.choice(["password", "Password", "token", "Token", "secret", "pwd", "api key", "API key", "passwd"])
    word = r.choice(sorted(_STATUS))
    return r.choice([f"{key}: {word}", f"{key}: {word} {_word(r)} {_word(r)}", f"{key} = {word}", f"{key}: {word}.", f"{key}: {_word(r)} {_word(r)} {_word(r)}", f"{key}:  {word.capitalize()}"])


_CUES = {"email": ["mail", "contact", "write to", "e-mail:"], "ip": ["host", "server", "IP", "addr"], "card": ["card", "visa", "credit card"], "phone": ["call", "phone", "tel.", "mobile"], "secret": ["login", "use", "my"]}
_OTHER_CUES = ["order", "ref.", "invoice", "version", "release", "ticket", "serial", "pages", "rooms", "total", "section", "batch"]
#: Places of a text for each kind. Where texts are so many that fewer do, a text has as many as make this many of each kind in all, and one
#: at least, of a kind that goes by its hash.
PLANTED = 8
ENOUGH = 48_000
#: Characters of a text on either side of what is planted.
AROUND = 60


def planted(before: str, after: str, kind: str, r: random.Random) -> tuple[str, int, int, int]:
    """(text, start, end, label): what is before and after a place, around made-up personal or harmless data."""
    good = r.random() < 0.5
    body = _personal(kind, r) if good else _harmless(kind, r)
    likely = r.random()
    cue = r.choice(_CUES[kind]) if likely < (0.5 if good else 0.1) else r.choice(_OTHER_CUES) if likely > (0.97 if good else 0.6) else ""
    before = f"{before.rstrip()} {cue} " if cue else before.rstrip() + r.choice([" ", ": ", "\n", ", ", " ("])
    behind = r.choice([", ", ". ", "\n", "; "] if good and kind == "secret" and body[-1:].islower() else [" ", ", ", ". ", "\n", "; "])
    return f"{before}{body}{behind}{after.lstrip()}", len(before), len(before) + len(body), int(good)


def examples(text: str) -> list[tuple[str, int, list[float]]]:
    """(kind, label, features) of the candidates at places where ``text`` was planted; the same for the same text."""
    r = random.Random(hashlib.md5(text.encode()).digest())
    ats = (r.randrange(len(text) + 1) for _ in range(PLANTED * len(KINDS)))
    return examples_at(((text[max(0, at - AROUND) : at], text[at : at + AROUND]) for at in ats), r)


def examples_at(places: Iterable[tuple[str, str]], r: random.Random, first: int = 0) -> list[tuple[str, int, list[float]]]:
    """The same at places (what is before, what is after), which the kinds take in turn, from the one of number ``first`` on."""
    out = []
    for i, (before, after) in enumerate(places, first):
        kind = KINDS[i % len(KINDS)]
        made, a, b, label = planted(before, after, kind, r)
        within = _within(base_spans(made))
        for k, c, d in loose_spans(made):
            if k == kind and c < b and a < d and not within(c, d):
                whole = c <= a and b - 1 <= d <= b + 2 and a - c <= 2
                out.append((kind, int(label and whole), span_features(made, kind, c, d)))
    return out


def _within(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether one of ``spans`` holds [a, b) whole: of those that begin at ``a`` or before, the farthest end decides."""
    starts = sorted((a, b) for _, a, b in spans)
    ends = list(itertools.accumulate((b for _, b in starts), max))
    starts = [a for a, _ in starts]

    def holds(a: int, b: int) -> bool:
        at = bisect.bisect_right(starts, a)
        return at > 0 and ends[at - 1] >= b

    return holds


TREES = {"rounds": 80}


def _hashes(c: np.ndarray) -> np.ndarray:
    """56 bits of a hash of each row of codes."""
    return np.array([int.from_bytes(hashlib.md5(row.tobytes()).digest()[:7], "little") for row in c], np.int64)


def _held(c: np.ndarray) -> np.ndarray:
    """Which rows of codes are for the threshold and not for the trees: a quarter or so, equal rows together."""
    return _hashes(c) % 4 == 0


class Model:
    """Boosted trees over candidates and a threshold, for each kind."""

    def __init__(self, rows: list[tuple[str, int, list[float]]] = (), precision: float = PRECISION):
        """From examples in memory."""
        self.trees, self.thresholds = {k: BoostedTrees(**TREES) for k in KINDS}, {}
        for kind, tree in self.trees.items():
            x, y = np.array([f for k, _, f in rows if k == kind], float), np.array([v for k, v, _ in rows if k == kind], int)
            held = _held(codes(x))
            tree.fit(x[~held], y[~held])
            scores = tree.levels(tree.binned(codes(x[held]))) if held.any() and not held.all() else np.zeros(0, int)
            self._calibrate(kind, scores, y[held][: len(scores)], None, precision)

    def _calibrate(self, kind: str, levels: np.ndarray, y: np.ndarray, n: np.ndarray | None, precision: float) -> None:
        self.thresholds[kind] = calibrated_threshold(levels / LEVELS, y, precision, n=n)

    def scores(self, text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
        """How likely each candidate is personal data."""
        out = np.zeros(len(spans))
        for kind in KINDS:
            own = [i for i, s in enumerate(spans) if s[0] == kind]
            for i in range(0, len(own), 4096):
                out[own[i : i + 4096]] = self.trees[kind].probability(np.array([span_features(text, *spans[x]) for x in own[i : i + 4096]]))
        return out

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans)."""
        base = base_spans(text)
        within = _within(base)
        loose = [c for c in loose_spans(text) if not within(c[1], c[2])]
        if not loose:
            return base, base
        p = self.scores(text, loose)
        added, taken = [], []  # the taken ones overlap nothing of one another, so a candidate's neighbours among them tell
        for score, c in sorted(zip(p.tolist(), loose, strict=True), key=lambda v: (-v[0], v[1][1], ORDER[v[1][0]], -v[1][2])):
            at = bisect.bisect_left(taken, c[1:])
            if score >= self.thresholds[c[0]] and (at == len(taken) or taken[at][0] >= c[2]) and (at == 0 or taken[at - 1][1] <= c[1]):
                added.append(c)
                taken.insert(at, c[1:])
        return base, sorted(base + added, key=lambda s: (s[1], ORDER[s[0]]))


_BLOCK = "kind string, held boolean, y binary, x binary"
_ROWS = 32  # examples of a row of a table of examples
_TASK = 1 << 16  # examples that are worth a task


def _block(kind: str, held: bool, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_ROWS`` examples each: their labels and their codes or bins, as bytes."""
    cuts = range(0, len(y), _ROWS)
    ys, xs = ([np.ascontiguousarray(v[i : i + _ROWS]).tobytes() for i in cuts] for v in (y.astype(np.uint8), x))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(ys), pa.string()), pa.array([held] * len(ys), pa.bool_()), pa.array(ys, pa.binary()), pa.array(xs, pa.binary())], ["kind", "held", "y", "x"])


def _blocks(batches: Iterator[pa.RecordBatch], of: np.dtype) -> Iterator[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(kind, held, labels, codes or bins) of a table of examples, at most ``BLOCK`` at a time."""
    for b in batches:
        for kind, held in itertools.product(KINDS, (False, True)):
            rows = b.filter(pc.and_(pc.equal(b.column("kind"), kind), pc.equal(b.column("held"), held)))
            for i in range(0, rows.num_rows, BLOCK // _ROWS):
                y, x = (b"".join(rows.column(c).slice(i, BLOCK // _ROWS).to_pylist()) for c in ("y", "x"))
                y = np.frombuffer(y, np.uint8)
                yield kind, held, y, np.frombuffer(x, of).reshape(len(y), -1)


def _places(docs: DataFrame, each: int) -> DataFrame:
    """Per distinct text a hash ``h`` and ``each`` places: what is around each one, and where it is in that."""
    at = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: F.pmod(F.xxhash64("h", k), F.col("size") + 1).cast("int"))
    around = lambda a: F.struct(F.col("text").substr(F.greatest(a - (AROUND - 1), F.lit(1)), F.least(a, F.lit(AROUND)) + AROUND).alias("text"), F.least(a, F.lit(AROUND)).alias("at"))
    found = docs.withColumn("size", F.length("text")).withColumn("at", at).select("h", F.transform("at", around).alias("places"))
    return found.groupBy("h").agg(F.first("places").alias("places"))


def fit(docs: DataFrame, precision: float = PRECISION, most_examples: int | None = None) -> Model:
    """The model, from what is planted into all distinct texts of ``docs``; a text counts once, however many copies it has. A caller may
    ask for about ``most_examples`` examples only.

    What reaches the driver: counts of the codes of each feature (16 bits), sums over nodes and bins of each task, counts of
    scores in ``LEVELS`` steps. The tasks that send sums are twice the cluster's cores at most.
    """
    spark = docs.sparkSession
    base = only(docs, "doc_id", "text").select(F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("h", F.xxhash64("text"))
    n = base.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    each = max(1, min(len(KINDS) * PLANTED, -(-len(KINDS) * ENOUGH // max(1, n))))
    share = 1.0 if most_examples is None else most_examples / max(1, n * each)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = {k: [] for k in KINDS}

        def blocks(kind: str) -> Iterator[pa.RecordBatch]:
            y, x = np.array([r[0] for r in waiting[kind]], np.uint8), codes(np.array([r[1] for r in waiting[kind]]))
            waiting[kind] = []
            taken = (_hashes(x) >> 2) / float(1 << 54) < share
            for held in (False, True):
                own = taken & (_held(x) == held)
                if own.any():
                    yield _block(kind, held, y[own], x[own])

        for b in batches:
            for h, places in zip(b.column("h"), b.column("places"), strict=True):
                around = ((p["text"][: p["at"]], p["text"][p["at"] :]) for p in places.as_py())
                for kind, label, features in examples_at(around, random.Random(h.as_py()), h.as_py() % len(KINDS)):
                    waiting[kind].append((label, features))
                    if len(waiting[kind]) == 1024:
                        yield from blocks(kind)
        for kind in KINDS:
            if waiting[kind]:
                yield from blocks(kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, held, y, x in _blocks(batches, np.uint16):
            if not held:
                keys, counts = np.unique((np.arange(x.shape[1], dtype=np.int64) << 16) + x, return_counts=True)
                ones = int(y.sum())  # labels are counted as a feature of number -1
                feature, code, counts = [*(keys >> 16), -1, -1], [*(keys & 0xFFFF), 0, 1], [*counts, len(y) - ones, ones]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(code)), pa.array(feature, pa.int32()), pa.array(code, pa.int32()), pa.array(counts, pa.int64())], ["kind", "feature", "code", "n"])

    paths = [scratch(spark, name) for name in ("examples", "bins")]
    _places(base, each).mapInArrow(plant, _BLOCK).write.parquet(paths[0])
    found = spark.read.schema(_BLOCK).parquet(paths[0])
    counts = found.mapInArrow(count, "kind string, feature int, code int, n bigint").groupBy("kind", "feature", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    model, growing = Model(), {}
    for kind, own in counts.sort_values(["feature", "code"]).groupby("kind"):
        labels = own[own.feature < 0]
        edges = [quantiles(f.code.to_numpy(np.uint16), f.n.to_numpy(), model.trees[kind].cuts) for _, f in own[own.feature >= 0].groupby("feature")]
        if model.trees[kind].begin(int(labels.n.sum()), int((labels.n * labels.code).sum()), edges):
            growing[kind] = model.trees[kind]
    trees = {k: t for k, t in model.trees.items() if t.edges}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, held, y, x in _blocks(batches, np.uint16):
            if kind in trees:
                yield _block(kind, held, y, trees[kind].binned(x).T)

    found.mapInArrow(cut, _BLOCK).write.parquet(paths[1])
    total = int(counts.n[counts.feature < 0].sum())
    bins = spark.read.schema(_BLOCK).parquet(paths[1]).coalesce(max(1, min(2 * spark.sparkContext.defaultParallelism, total // _TASK)))

    def sums(growing: dict[str, BoostedTrees]) -> dict[str, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for kind, _, y, x in _blocks(batches, np.uint8):
                if kind in growing:
                    total[kind] = growing[kind].sums(np.ascontiguousarray(x.T), y) + total.get(kind, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["kind", "sums"])

        total = {}
        for r in bins.filter("not held").mapInArrow(add, "kind string, sums binary").collect():
            total[r.kind] = np.frombuffer(r.sums, np.int64).reshape(3, -1) + total.get(r.kind, 0)
        return total

    boost(growing, sums)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, y, x in _blocks(batches, np.uint8):
            levels, n = np.unique(2 * trees[kind].levels(np.ascontiguousarray(x.T)) + y, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n)), pa.array(levels >> 1, pa.int32()), pa.array(levels & 1, pa.int32()), pa.array(n, pa.int64())], ["kind", "level", "y", "n"])

    scores = bins.filter("held").mapInArrow(score, "kind string, level int, y int, n bigint").groupBy("kind", "level", "y").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    for kind, own in scores.groupby("kind"):
        model._calibrate(kind, own.level.to_numpy(), own.y.to_numpy(), own.n.to_numpy(), precision)
    for path in paths:
        discard(spark, path)
    return model


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, base (spans of the base patterns) and spans (all)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [shared.value.spans(t.as_py() or "") for t in b.column(1)]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in pair[i]] for pair in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "base", "spans"])

    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id bigint, base {_SPAN}, spans {_SPAN}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the spans redacted; columns and their order stay, ``n_chars`` (if present) follows the text."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, new = list(b.columns), {}
            for i, t in enumerate(cols[at]):
                text = t.as_py()
                if text and (spans := shared.value.spans(text)[1]):
                    new[i] = redacted(text, spans)
            if new:
                cols[at] = pa.array([new[i] if i in new else t.as_py() for i, t in enumerate(cols[at])], cols[at].type)
                if chars is not None:
                    cols[chars] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(cols[chars].to_pylist())], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
