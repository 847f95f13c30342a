"""Static range asymmetric numeral system in numpy.

A block interleaves many lanes over one stream of 32-bit words; the states lie in [2^31, 2^63). All
blocks of a segment share one frequency table. A block keeps its decoder states at regular steps
(checkpoints), so decoding can begin at any of them, and a crc32 of all its bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
_TOP = np.uint64(63 - BITS)
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << BITS) - 1)
_WORD = np.uint64(0xFFFFFFFF)
_HEAD = struct.Struct("<4sIIIII")


class Damaged(ValueError):
    """A checksum or a length doesn't fit."""


def _sealed(data: bytes) -> bytes:
    return data + struct.pack("<I", zlib.crc32(data))


def _opened(data: bytes) -> bytes:
    if len(data) < 4 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise Damaged("checksum")
    return data[:-4]


class Table:
    """Frequencies of symbols, scaled to a sum of 2^BITS, none below 1."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self._slots: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
        symbols = np.flatnonzero(counts)
        whole = 1 << BITS
        if len(symbols) > whole // 2:
            raise ValueError(f"over {whole // 2} different symbols")
        if not len(symbols):
            return cls(symbols, symbols)
        c = counts[symbols].astype(np.float64)
        freq = np.maximum(1, np.floor(c * whole / c.sum())).astype(np.int64)
        over = int(freq.sum()) - whole
        if over <= 0:
            freq[np.argmax(freq)] -= over
        while over > 0:  # symbols raised to 1 are paid for by the frequent ones
            can = freq - 1
            take = np.minimum(can, np.maximum(1, over * can // max(1, int(can.sum()))))
            order = np.argsort(-can, kind="stable")
            paid = np.minimum(np.cumsum(take[order]), over)
            freq[order] -= np.diff(paid, prepend=0)
            over = int(freq.sum()) - whole
        return cls(symbols, freq)

    def pack(self) -> bytes:
        return _sealed(struct.pack("<4sI", b"RTB1", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        data = _opened(data)
        magic, n = struct.unpack_from("<4sI", data)
        if magic != b"RTB1":
            raise Damaged("not a table")
        return cls(np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, "<u4", n, 8 + 4 * n))

    def rank(self, ids: np.ndarray) -> np.ndarray:
        back = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, dtype=np.int64)
        back[self.symbols] = np.arange(len(self.symbols))
        return back[ids]

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table, lanes: int = 1024, every: int = 256) -> bytes:
    """One block. Token t is in lane t % lanes at step t // lanes; a checkpoint stands before each step that `every` divides."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64 or 1))
    steps = -(-n // lanes)
    rank = table.rank(ids)
    freq, start = table.freq[rank], table.start[rank]
    x = np.full(lanes, _LOW)
    out: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    words = 0
    bits = np.uint64(BITS)
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * lanes : (s + 1) * lanes], start[s * lanes : (s + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << _TOP)
        if full.any():
            gone = y[full]
            out.append((gone & _WORD).astype(np.uint32)[::-1])
            words += len(gone)
            y[full] = gone >> np.uint64(32)
        q = y // f
        y[:] = (q << bits) + (y - q * f) + c
        if s and s % every == 0:
            marks.append((s, words, x.astype("<u8").tobytes()))
    stream = np.concatenate(out)[::-1] if out else np.empty(0, np.uint32)
    head = _HEAD.pack(b"RNS1", n, lanes, every, words, len(marks))
    points = b"".join(struct.pack("<II", s, words - w) + state for s, w, state in reversed(marks))
    return _sealed(head + x.astype("<u8").tobytes() + points + stream.astype("<u4").tobytes())


def decode(block: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """The ids of a block, or those between checkpoint `part` (0: the block's start) and the next one.

    A whole block is decoded from all its checkpoints at once: each is a row of states that reads its own
    stretch of the stream, so a block takes as many steps as one stretch has.
    """
    data = _opened(block)
    magic, n, lanes, every, words, marks = _HEAD.unpack_from(data)
    if magic != b"RNS1":
        raise Damaged("not a block")
    if part is not None and not 0 <= part <= marks:
        raise IndexError(part)
    if not n:
        return np.empty(0, np.uint32)
    steps, at, size = -(-n // lanes), _HEAD.size, 8 + 8 * lanes
    held = np.frombuffer(data, np.uint8, marks * size, at + 8 * lanes).reshape(marks, size)
    x = np.concatenate([np.frombuffer(data, "<u8", lanes, at), np.ascontiguousarray(held[:, 8:]).view("<u8").ravel()]).astype(np.uint64).reshape(-1, lanes)
    places = np.ascontiguousarray(held[:, :8]).view("<u4").astype(np.int64).reshape(-1, 2)
    first, pos = np.concatenate([[0], places[:, 0]]), np.concatenate([[0], places[:, 1]])
    count = np.diff(np.concatenate([first, [steps]]))  # all alike but for the last, which is no longer
    if part is not None:
        x, first, pos, count = (a[part : part + 1] for a in (x, first, pos, count))
    stream = np.frombuffer(data, "<u4", words, at + 8 * lanes + marks * size)
    slots, freq, start, bits = table.slots(), table.freq, table.start, np.uint64(BITS)
    low_step, last = int(first[0]), steps * lanes - n
    out = np.empty((int(count.sum()), lanes), dtype=np.int32)
    for s in range(int(count[0])):
        rows = len(count) if s < count[-1] else len(count) - 1
        y = x[:rows]
        low = y & _MASK
        k = slots[low.astype(np.int64)]
        out[first[:rows] + (s - low_step)] = k
        y[:] = freq[k] * (y >> bits) + low - start[k]
        dry = y < _LOW
        if last and first[rows - 1] + s == steps - 1:
            dry[-1, lanes - last :] = False  # the last step has no ids in these lanes
        where = np.flatnonzero(dry)
        if len(where):
            many = dry.sum(axis=1)
            from_ = np.arange(len(where)) + np.repeat(pos[:rows] - np.cumsum(many) + many, many)
            y.reshape(-1)[where] = (y.reshape(-1)[where] << np.uint64(32)) | stream[from_]
            pos[:rows] += many
    return table.symbols[out.ravel()[: n - low_step * lanes]]
