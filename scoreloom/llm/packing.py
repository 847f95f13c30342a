"""Packing of token streams into windows, order kept, by dynamic programming.

Documents of a shard follow each other in order of their ids; their tokens are one stream. Windows
are cut at document ends (free), at sentence ends (penalty SENTENCE) or, where sentences are longer
than STRIDE tokens, at other places (penalty HARD), so that padding plus penalties are least:

    cost[j] = penalty[j] + WINDOW - at[j] + min over at[j] - at[i] <= WINDOW of cost[i] + at[i]

The minimum slides with j, so a monotone queue gives each transition in constant time; a window of
exactly 512, 1024 or 2048 tokens needs no padding and is a transition of its own. Exact windows below
512 are tried at a shard's end alone, so the cost is the least without them elsewhere; no token is lost.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import width
from .token_binary import encoded
from .tokens import opened

WINDOW = 2048
SENTENCE, HARD, STRIDE = 4, 48, 48
#: Tokens that a task plans at a time; the last window is planned again with what follows.
PLAN = 1 << 18
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the best cuts, at[0] and at[-1] included. at: increasing candidates, no gap over the window."""
    places, extra = at.tolist(), penalty.tolist()
    index = {p: k for k, p in enumerate(places)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    cost, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int]] = deque([(places[0], 0)])  # cost + position, candidate
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0][1]] < p - window:
            queue.popleft()
        best, i = queue[0]
        best += window - p
        for w in powers[-3:]:
            k = index.get(p - w)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += extra[j]
        cost[j], back[j] = best, i
        own = best + p
        while queue and queue[-1][0] >= own:
            queue.pop()
        queue.append((own, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return [places[0], *reversed(cuts)]


def candidates(ends: np.ndarray, sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in (0, total] with their penalties; 0 comes first."""
    cost = np.full(total + 1, -1, dtype=np.int16)
    soft = np.unique(np.r_[0, sentences, ends, total])
    gaps = np.diff(soft)
    for lo, n in zip(soft[:-1][gaps > STRIDE].tolist(), gaps[gaps > STRIDE].tolist(), strict=True):
        cost[lo + STRIDE : lo + n : STRIDE] = HARD
    cost[sentences] = SENTENCE
    cost[ends] = 0
    cost[[0, total]] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def exact(length: int, window: int = WINDOW) -> list[int]:
    """One window, or powers of two where their cuts cost less than its padding."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if (len(parts) - 1) * HARD < window - length else [length]


def sentence_tables(encoder) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token ends a sentence, and whether one begins after white space."""
    size = encoder.model.get_vocab_size()
    texts = encoder.model.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
    return np.array([t.rstrip("\"')]").endswith((".", "!", "?", "\n")) for t in texts]), np.array([t[:1].isspace() for t in texts])


def packed(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents (doc_id, text), each with its window (sequence_id) and place there.

    A null text is an empty document (the end id alone). Null ids come first; repeated rows are packed
    as documents of their own. Every token lies in exactly one piece; an empty table gives no piece.
    """

    def pack(batches):
        encoder = opened("byte", path)
        ending, opening = sentence_tables(encoder)
        rows: list[tuple] = []
        held: list[tuple] = []  # doc_id, tokens before, ids left, doc_tokens
        shard, number, total = None, 0, 0

        def flush(last: bool):
            """Plan what is held; all but its last window go out, at a shard's end that one too."""
            nonlocal number, total
            ids = np.concatenate([h[2] for h in held])
            stops = np.cumsum([len(h[2]) for h in held])
            ends = np.flatnonzero(ending[ids[:-1]] & opening[ids[1:]]) + 1
            cuts = plan(*candidates(stops, ends, len(ids)), window)
            if not last:
                cuts.pop()
            if last:
                bounds = [0]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    bounds += (lo + np.cumsum(exact(hi - lo, window))).tolist()
                cuts = bounds
            starts = stops - [len(h[2]) for h in held]
            k = 0
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                while stops[k] <= lo:
                    k += 1
                d = k
                while d < len(held) and starts[d] < hi:
                    a, b = max(lo, int(starts[d])), min(hi, int(stops[d]))
                    doc, before, _, tokens = held[d]
                    rows.append((doc, before + a - int(starts[d]), b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), tokens, (shard << 40) | number, a - lo))
                    d += 1
                number += 1
            done, rest = cuts[-1], []
            for (doc, before, own, tokens), lo, hi in zip(held, starts.tolist(), stops.tolist(), strict=True):
                if hi > done:
                    skip = max(0, done - lo)
                    rest.append((doc, before + skip, own[skip:], tokens))
            held[:] = rest
            total = len(ids) - done

        def out():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for s, doc, ids in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "ids")), strict=True):
                if s != shard:
                    if held:
                        flush(True)
                    shard, number, total = s, 0, 0
                own = np.frombuffer(ids, encoder.kind)
                held.append((doc, 0, own, len(own)))
                total += len(own)
                if total >= PLAN:
                    flush(False)
                if len(rows) > 20_000:
                    yield out()
        if held:
            flush(True)
        if rows:
            yield out()

    return encoded(docs, "byte", path, end_id, width(docs.sparkSession)).mapInArrow(pack, _PIECES)
