"""An adaptive context-mixing range coder of token ids, for many independent blocks at once.

A block is coded by itself: all that adapts starts afresh in it. Three models predict the next id. Order 2 and order 1 name
the id that last followed the same two ids or the same id (hashed slots, each with a confidence that grows and falls);
order 0 gives every id its share by the counts of a ``Prior``, the distribution that all blocks of a record start from (its
counts stand in the record's header; without one, all ids are alike). The candidate of the surer of orders 2 and 1 is coded
first: whether it comes is what all three models say in one logistic mix, order 2 and order 1 by their confidence and by
whether they agree, order 0 by how frequent the candidate is, each through a probability that adapts, with weights that
learn. If it does not come, order 0 spells the id. Both are one step of the range coder. Everything that decides is integer
arithmetic, so a decoder on another machine makes the same decisions. Numpy runs the blocks in step, one lane for each.

Block, little-endian: ``ACM2``, ids u32, bytes of payload u32, crc32 of the ids as 16-bit integers u32, payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
SLOTS = 512
MAGIC = b"ACM2"
#: Bits of the decision about the candidate, and most bits of the order-0 counts' total; a step needs 30 at most.
_CHOICE, _MOST_TOTAL = 12, 18
_ONE = 1 << _CHOICE
_TOP = np.uint64(1 << 48)
_16, _48 = np.uint64(16), np.uint64(48)

#: Logistic functions as tables: probability (12 bits) -> ln(p / (1 - p)) * 256, and back.
_STRETCH = np.round(np.log((np.arange(_ONE) + 0.5) / (_ONE - 0.5 - np.arange(_ONE))) * 256).astype(np.int32)
_SQUASH = np.clip(np.round(_ONE / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 4, _ONE - 4).astype(np.int32)
#: What the models' probabilities start from: by confidence and agreement for orders 2 and 1, by frequency for order 0.
_START = np.array([[8, 8, 500, 1400, 1800, 2600, 2800, 3400] + [8] * 8, [8, 8, 220, 1400, 700, 2600, 1400, 3400] + [8] * 8, [200] * 16], np.int32)
_WEIGHT = 22_000
_RATE, _LEARN = 4, 11


class Prior:
    """Order-0 counts of ids, scaled so that they sum to a power of two; every id that occurs keeps a share."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        """``counts`` of the distinct ascending ``ids``, 1 to 63 as ``levels`` gives them."""
        self.ids, self.levels = ids.astype("<u2"), counts.astype(np.uint8)
        self.bits = min(_MOST_TOTAL, max(14, len(ids).bit_length() + 4))
        wish = np.exp2(counts / 3)
        total = 1 << self.bits
        share = np.maximum(1, np.floor(wish * ((total - len(ids)) / wish.sum()))).astype(np.int64)
        share[np.argmax(share)] += total - int(share.sum())
        size = 1 << 16
        self.share, self.before = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.share[ids], self.before[ids] = share, np.cumsum(share) - share
        self.look_up = np.repeat(ids.astype(np.uint16), share)
        self.kind = np.zeros(size, np.int32)
        self.kind[ids] = np.minimum(15, np.floor(np.log2(share)).astype(np.int32))

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        """That of a run of ids: each one's count, to a third of a power of two."""
        counts = np.bincount(ids, minlength=1)
        own = np.flatnonzero(counts)
        return cls(own, np.minimum(63, 1 + np.round(3 * np.log2(counts[own])))) if len(own) else cls.even()

    @classmethod
    def even(cls) -> Prior:
        return cls(np.arange(1 << 16), np.zeros(1 << 16))

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.ids.astype(np.int64), prepend=-1) - 1
        return struct.pack("<I", len(self.ids)) + zlib.compress(gaps.astype("<u2").tobytes() + self.levels.tobytes(), 9)

    @classmethod
    def from_bytes(cls, data: bytes) -> Prior:
        n, raw = struct.unpack_from("<I", data)[0], zlib.decompress(data[4:])
        return cls(np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64) + 1) - 1, np.frombuffer(raw, np.uint8, n, 2 * n).astype(float))


class _Model:
    """The predictions of all lanes."""

    def __init__(self, lanes: int, prior: Prior):
        self.prior = prior
        self.slots = np.arange(lanes, dtype=np.int64) * SLOTS
        self.one, self.two = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)  # id << 2 | confidence
        self.prev, self.hash = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.base = (np.arange(lanes, dtype=np.int64) * 16) + (np.arange(3, dtype=np.int64) * 16 * lanes)[:, None]
        self.chance = np.repeat(_START[:, None, :], lanes, axis=1).ravel()
        self.weight = np.full((3, lanes), _WEIGHT, np.int32)
        self.at = np.empty((3, lanes), np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidates, and the chance of each, of 2^12."""
        self.at1 = self.slots + ((self.prev * 0x9E3B >> 5) & (SLOTS - 1))
        self.at2 = self.slots + (self.hash & (SLOTS - 1))
        v1, v2 = self.one.take(self.at1), self.two.take(self.at2)
        c1, c2 = v1 & 3, v2 & 3
        self.v1, self.v2 = v1, v2
        candidate = np.where(c2 >= c1, v2, v1) >> 2
        agree = (v1 ^ v2) < 4
        np.add(self.base[0], 2 * c2 + agree, out=self.at[0])
        np.add(self.base[1], 2 * c1 + agree, out=self.at[1])
        np.add(self.base[2], self.prior.kind.take(candidate), out=self.at[2])
        self.was = self.chance.take(self.at)
        self.say = _STRETCH.take(self.was)
        dot = (self.weight * self.say).sum(axis=0, dtype=np.int32) >> 16
        self.out = _SQUASH.take(np.clip(dot, -2047, 2047) + 2047)
        return candidate, self.out

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        target = hit * np.int32(_ONE - 1)
        self.chance[self.at] = self.was + ((target - self.was) >> _RATE)
        self.weight += (self.say * (target - self.out)) >> _LEARN
        new = (ids << 2) | 1
        for table, at, v in ((self.one, self.at1, self.v1), (self.two, self.at2, self.v2)):
            conf, same = v & 3, (v ^ new) < 4
            table[at] = np.where(same & (conf > 0), v + (conf < 3), np.where(conf > 1, v - 1, new))
        self.hash = (self.prev * 0x6A2D + ids * 0x2F0B5) >> 4
        self.prev = ids


def _shares(prior: Prior, chance: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the code's share of each lane's id, of 2^(12 + bits of the prior)."""
    first, rest = chance.astype(np.int64) << prior.bits, (_ONE - chance).astype(np.int64)
    return np.where(hit, 0, first + rest * prior.before.take(ids)).view(np.uint64), np.where(hit, first, rest * prior.share.take(ids)).view(np.uint64)


def encode_blocks(ids: np.ndarray, prior: Prior | None = None) -> list[bytes]:
    """Blocks of at most ``BLOCK`` ids each (below 65,536) of the stream ``ids``, each with header and checksum."""
    if not len(ids):
        return []
    if int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be below 65,536")
    prior = prior or Prior.even()
    lanes = -(-len(ids) // BLOCK)
    grid = np.full(lanes * BLOCK, ids[-1], np.int32)
    grid[: len(ids)] = ids
    columns = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    steps = min(BLOCK, len(ids))
    model = _Model(lanes, prior)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    # digits by place and lane, as lanes proceed at a like pace; place 0 takes none
    every = np.arange(lanes)
    out, at = np.zeros((steps // 2 + 16) * lanes, np.uint32), every + lanes
    bits = np.uint64(_CHOICE + prior.bits)
    for t in range(steps):
        x = columns[t]
        candidate, chance = model.predict()
        hit = candidate == x
        first, share = _shares(prior, chance, hit, x)
        size >>= bits
        first *= size
        low += first
        size *= share
        over = np.flatnonzero(low < first)
        if len(over):  # carries are settled at the end
            out[at[over] - lanes] += 1
        short = np.flatnonzero(size < _TOP)
        while len(short):
            x_low, x_size, where = low[short], size[short] << _16, at[short]
            out[where] = x_low >> _48
            at[short] = where + lanes
            low[short], size[short] = x_low << _16, x_size
            short = short[x_size < _TOP]
        model.learn(x, hit)
        if t % 8 == 7 and int(at.max()) + 24 * lanes > len(out):
            out = np.concatenate([out, np.zeros((steps // 4 + 16) * lanes, np.uint32)])
    out = np.concatenate([out, np.zeros(4 * lanes, np.uint32)])
    for _ in range(4):
        out[at] = low >> _48
        low <<= _16
        at += lanes
    out, at = out.reshape(-1, lanes), at // lanes
    for j in range(int(at.max()) - 1, 0, -1):
        out[j - 1] += out[j] >> 16
    out = np.ascontiguousarray(out.T.astype("<u2"))
    blocks = []
    for i, n in enumerate(at.tolist()):
        own, payload = ids[i * BLOCK : (i + 1) * BLOCK].astype("<u2"), out[i, 1:n].tobytes()
        blocks.append(struct.pack("<4sIII", MAGIC, len(own), len(payload), zlib.crc32(own.tobytes())) + payload)
    return blocks


def split_blocks(data: bytes) -> list[tuple[int, int, bytes]]:
    """(ids, checksum, payload) of each block in a run of blocks."""
    out, at = [], 0
    while at < len(data):
        magic, n, size, crc = struct.unpack_from("<4sIII", data, at)
        if magic != MAGIC or at + 16 + size > len(data) or n > BLOCK:
            raise ValueError(f"damaged block at byte {at}")
        out.append((n, crc, data[at + 16 : at + 16 + size]))
        at += 16 + size
    return out


def decode_blocks(data: bytes, prior: Prior | None = None) -> np.ndarray:
    """The ids of a run of blocks; each block's checksum is verified."""
    blocks = split_blocks(data)
    if not blocks:
        return np.zeros(0, np.uint16)
    prior = prior or Prior.even()
    lanes, length = len(blocks), max(len(b[2]) for b in blocks) // 2 + 8
    digits = np.zeros((lanes, length), np.uint16)
    for i, b in enumerate(blocks):
        digits[i, : len(b[2]) // 2] = np.frombuffer(b[2], "<u2")
    digits, every = np.ascontiguousarray(digits.T).ravel(), np.arange(lanes)
    code, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    for k in range(4):
        code = (code << _16) | digits[every + k * lanes]
    at, last = every + 4 * lanes, every + (length - 1) * lanes
    bits, most = np.uint64(_CHOICE + prior.bits), (1 << prior.bits) - 1
    model = _Model(lanes, prior)
    grid = np.zeros((max(b[0] for b in blocks), lanes), np.int32)
    for t in range(len(grid)):
        candidate, chance = model.predict()
        size >>= bits
        v = (code // size).view(np.int64) - (chance.astype(np.int64) << prior.bits)
        hit = v < 0
        spelt = np.minimum(np.maximum(v, 0) / (_ONE - chance), most).astype(np.int64)
        x = np.where(hit, candidate, prior.look_up.take(spelt)).astype(np.int32)
        first, share = _shares(prior, chance, hit, x)
        code -= size * first
        size *= share
        short = np.flatnonzero(size < _TOP)
        while len(short):
            where, x_size = at[short], size[short] << _16
            code[short], size[short] = (code[short] << _16) | digits[np.minimum(where, last[short])], x_size
            at[short] = where + lanes
            short = short[x_size < _TOP]
        grid[t] = x
        model.learn(x, hit)
    out = grid.T.astype("<u2")
    for i, (n, crc, _) in enumerate(blocks):
        if zlib.crc32(out[i, :n].tobytes()) != crc:
            raise ValueError(f"block {i} fails its checksum")
    return np.concatenate([out[i, :n] for i, (n, _, _) in enumerate(blocks)])
