"""Token ids of whole texts by a public tokenizer file, with a bounded table of pieces.

A byte-pair tokenizer treats the pieces that its pre-tokenizer cuts out one by one, and natural text repeats pieces, so
each worker keeps the ids of those it has seen. Texts in Latin-1 are cut by the tokenizer's own rule, in numpy and many at
once, and their pieces looked up by their very bytes; others are cut at white space. Texts that hold the start of a
special token, and tokenizers of another make, are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Pieces that a worker keeps, at some 200 bytes each.
MOST_CACHED = 1_000_000

_L, _N, _S = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\t-\r \x85\xa0"
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: For the two makes of pre-tokenizer, a pattern of pieces between which nothing joins. In Latin-1 the pieces are, "spaced":
#: 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^LNS]+|S+(?!\S)|S+ and "lowered": 's|'t|'re|'ve|'m|'ll|'d|L+|N|[^LNS]+
_MAKES = {"spaced": re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"), "lowered": re.compile(f"[^{_WHITE}]+")}
#: What a Latin-1 byte is to the pre-tokenizers: white space, letter, digit or other.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
for _kind, _chars in ((_SPACE, _S), (_LETTER, _L), (_DIGIT, _N)):
    _CLASS[[b for b in range(256) if re.match(rb"[" + _chars + rb"]", bytes([b]))]] = _kind
#: Bytes of text that are cut in one go; it bounds the memory taken.
SLICE = 1 << 20
#: Between these, a very long text may be cut in two: a piece ends and another begins there.
_SEAM = re.compile(rb"(?<=[a-z])(?= [a-z])")
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))

#: Byte-level tokenizers show a byte as the character of its number if that is printable, else as the next one from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _make(spec: dict) -> str | None:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
        return "lowered"
    return None


class _Ids(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece):
        if len(self) >= MOST_CACHED:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


def _cut(data: np.ndarray, offs: np.ndarray, make: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each piece of a run of Latin-1 texts, as the pre-tokenizer finds them."""
    n = len(data)
    kind = _CLASS[data]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    head = np.zeros(n + 1, bool)
    head[offs] = True
    new |= head
    if make == "lowered":
        new[:n] |= kind == _DIGIT
    # contractions: an apostrophe that is a piece by itself, before certain letters of the same text
    at = np.flatnonzero(data == 39)
    at = at[new[at] & new[at + 1] & ~head[at + 1]]
    if make == "spaced":
        at = at[head[at] | (data[at - 1] != 32)]
    if len(at):
        first, second = data[at + 1], np.where(head[at + 2], 0, data[np.minimum(at + 2, n - 1)]) if n > 2 else np.zeros(len(at), np.uint8)
        two = ((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)
        one = np.isin(first, (115, 116, 109, 100))
        new[at[one | two] + 1] = False
        new[at[one] + 2] = True
        new[at[two] + 3] = True
    if make == "spaced":  # the last of the white space before other signs stands alone, or with them if it is a space
        q = np.flatnonzero(new[1:n] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:n]) + 1
        new[q - 1] = True
        new[q[data[q - 1] == 32]] = False
    start = np.flatnonzero(new)
    start, end = start[:-1], start[1:]
    if make == "lowered":
        solid = kind[start] != _SPACE
        start, end = start[solid], end[solid]
    return start, end


class _Pieces:
    """Pieces and their ids, numbered from 1 on. Those of up to 15 bytes are found by these bytes and their number, in a
    table with linear probing; longer ones in a dictionary."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.n, self.bits = 1, 16
        self.keys = np.zeros((2, 1 << 15), np.uint64)
        self.count, self.at = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.long: dict[bytes, int] = {}

    def _slot(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = (k1 * _A) ^ (k2 * _B)
        h = (h ^ (h >> np.uint64(32))) * _C
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these keys; 0 where there is none."""
        slot, mask = self._slot(k1, k2), (1 << self.bits) - 1
        found = self.slots.take(slot)
        left = np.flatnonzero((found > 0) & ((self.keys[0].take(found) != k1) | (self.keys[1].take(found) != k2)))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            f = self.slots.take(slot[left])
            found[left] = f
            left = left[(f > 0) & ((self.keys[0].take(f) != k1[left]) | (self.keys[1].take(f) != k2[left]))]
        return found

    def _place(self, new: np.ndarray) -> None:
        slot, mask = self._slot(self.keys[0][new], self.keys[1][new]), (1 << self.bits) - 1
        left = np.arange(len(new))
        while len(left):
            free = left[self.slots[slot[left]] == 0]
            self.slots[slot[free]] = new[free]
            left = left[self.slots[slot[left]] != new[left]]
            slot[left] = (slot[left] + 1) & mask

    def add(self, pieces: list[bytes]) -> int:
        """Number ``pieces``, which are new and distinct; the first one's number."""
        first, ids = self.n, [self.encode(p) for p in pieces]
        self.n += len(pieces)
        while self.n > len(self.count):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
            self.count, self.at = np.concatenate([self.count, self.count * 0]), np.concatenate([self.at, self.at * 0])
        own = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(own) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(own)] = own
        sizes = np.array([len(x) >> 2 for x in ids], np.int64)
        self.count[first : self.n] = sizes
        self.at[first : self.n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(own)
        short = np.array([i for i, p in enumerate(pieces) if len(p) < 16], np.int64)
        if len(short):
            raw = np.frombuffer(b"".join(pieces[i].ljust(15, b"\0") + bytes([len(pieces[i])]) for i in short.tolist()), "<u8").reshape(-1, 2)
            self.keys[0][first + short], self.keys[1][first + short] = raw[:, 0], raw[:, 1]
        if 2 * self.n > len(self.slots):
            self.bits = (2 * self.n).bit_length()
            self.slots = np.zeros(1 << self.bits, np.int32)
            every = np.arange(1, self.n)
            self._place(every[self.keys[1][1 : self.n] > 0])
        elif len(short):
            self._place(first + short)
        self.long.update((p, first + i) for i, p in enumerate(pieces) if len(p) > 15)
        return first

    def numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece raw[start:end]."""
        if self.n > MOST_CACHED:
            self.clear()
        size = end - start
        words = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), 0, (1,))
        k1 = words[start] & _BYTES.take(np.minimum(size, 8))
        k2 = (words[np.minimum(start + 8, len(raw))] & _BYTES.take(np.clip(size - 8, 0, 7))) | (size << 56).view(np.uint64)
        found = self.find(k1, k2).astype(np.int64)
        longer = np.flatnonzero(size > 15)
        found[longer] = [self.long.get(raw[a:b], 0) for a, b in zip(start[longer].tolist(), end[longer].tolist(), strict=True)]
        lost = np.flatnonzero(found == 0)
        if len(lost):
            pieces = [raw[a:b] for a, b in zip(start[lost].tolist(), end[lost].tolist(), strict=True)]
            new = dict.fromkeys(pieces)
            first = self.add(list(new))
            new = dict(zip(new, range(first, first + len(new)), strict=True))
            found[lost] = [new[p] for p in pieces]
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has)."""
        count = self.count.take(numbers)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        return self.pool.take(np.repeat(self.at.take(numbers) - (upto - count), count) + np.arange(total)), count


class TokenIds:
    """``plain``: the strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            self.make = _make(json.load(f))
        self.specials = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.model = self.tokenizer.model
        self.pieces, self.wide_cache = _Pieces(self.piece), _Ids(self.whole)

    def piece(self, raw: bytes) -> bytes:
        """Ids of one piece in Latin-1, which needs no further cutting: the model sees its UTF-8 bytes as characters."""
        text = raw.decode("latin-1")
        if not raw.isalnum() or not raw.isascii():
            text = "\u0120" + text[1:] if raw[:1] == b" " and raw[1:].isalnum() and raw.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.many([text])[0].astype("<u4").tobytes()

    def _raw(self, text: str | None) -> bytes | None:
        """``text`` in Latin-1, lower-cased if the tokenizer does so; None if it has to be encoded another way."""
        if not text:
            return b""
        if self.make is None or any(s in text for s in self.specials):
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return raw.translate(_LOWER) if self.make == "lowered" else raw

    def _other(self, text: str) -> np.ndarray:
        if self.make is None or any(s in text for s in self.specials):
            return np.frombuffer(self.whole(text), "<u4")
        return np.frombuffer(b"".join(map(self.wide_cache.__getitem__, _MAKES[self.make].findall(text))), "<u4")

    def many(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts, each text's followed by ``end_id`` if that is given, and where each begins."""
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(texts) + 1, np.int64)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        held: list[bytes] = []
        own: list[tuple[int, bool]] = []  # of each held part: its text, and whether it ends it
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if held:
                ids, upto = self._cut_ids(held)
                for (i, _), n in zip(own, np.diff(upto).tolist(), strict=True):
                    sizes[i + 1] += n
                if len(end):
                    last = np.array([x for _, x in own])
                    for i in (i for i, x in own if x):
                        sizes[i + 1] += 1
                    ids = np.insert(ids, upto[1:][last], end[0])
                parts.append(ids)
            held.clear()
            own.clear()
            waiting = 0

        for i, text in enumerate(texts):
            raw = self._raw(text)
            if raw is None:
                flush()
                parts += [self._other(text), end]
                sizes[i + 1] = len(parts[-2]) + len(end)
                continue
            at = 0
            while len(raw) - at > 2 * SLICE and (m := _SEAM.search(raw, at + SLICE)):
                held.append(raw[at : m.start()])
                own.append((i, False))
                at = m.start()
                flush()
            held.append(raw[at:])
            own.append((i, True))
            waiting += len(raw) - at
            if waiting > SLICE:
                flush()
        flush()
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum(sizes)

    def _cut_ids(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts in Latin-1."""
        raw, offs = b"".join(raws), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        if not raw:
            return np.zeros(0, np.uint32), offs
        start, end = _cut(np.frombuffer(raw, np.uint8), offs, self.make)
        ids, count = self.pieces.ids(self.pieces.numbers(raw, start, end))
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, upto[np.searchsorted(start, offs)]


_KEPT: dict[tuple[str, bool], TokenIds] = {}


def token_ids(path: str, plain: bool = False) -> TokenIds:
    """The worker's encoder for ``path``; kept between tasks, one at a time."""
    if (path, plain) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, plain] = TokenIds(path, plain)
    return _KEPT[path, plain]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
