"""Benchmark decontamination by an FM-index for each shard of the corpus.

Words become numbers; words that no benchmark item has cannot lie in a match, so runs of them shrink to
one separator, and known runs shorter than the shortest window are left out. Over what remains a shard
has a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.
All windows are searched backward at once, their occurrences located, and the covered words merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_parts, alnum_words, begin, picked, positional, rows_in, ship, staged

WINDOW, SAMPLE = 13, 4
#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20
#: Symbols and documents of a shard at most (one document may have more symbols).
SHARD_SYMBOLS, SHARD_DOCS = 1 << 20, 1 << 15


class FMIndex:
    """Over symbols >= 1; the suffix order is complete, so patterns of any length can be searched."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.r_[text, 0].astype(np.int64)
        self.n, self.sample = len(text), sample
        sa = self._sorted(text)
        self.counts = np.r_[0, np.cumsum(np.bincount(text))]
        bwt = text[sa - 1]
        self.levels = []
        now = bwt
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            self.levels.append((bit, one, self.n - int(one.sum()), np.r_[0, np.cumsum(one)].astype(np.int32)))
            now = np.concatenate([now[~one], now[one]])
        self.marked = sa % sample == 0
        self.marks = np.r_[0, np.cumsum(self.marked)]
        self.places = sa[self.marked]

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        n, k = len(text), 1
        order = np.argsort(text, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.r_[0, np.cumsum(np.diff(text[order]) != 0)]
        while rank[order[-1]] < n - 1:
            key = rank * (n + 1)
            key[: n - k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            rank[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            k *= 2
        return order

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, at = np.zeros_like(at), at.copy()
        for bit, _, zeros, ones in self.levels:
            up = (symbol >> bit & 1).astype(bool)
            a, b = ones[low], ones[at]
            low = np.where(up, zeros + a, low - a)
            at = np.where(up, zeros + b, at - b)
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern (a row of the matrix)."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            known = c < len(self.counts) - 1
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            if not len(live):
                break
            lo[live], hi[live] = self.counts[c] + self._rank(c, lo[live]), self.counts[c] + self._rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def _back(self, row: np.ndarray) -> np.ndarray:
        symbol, at, low = np.zeros_like(row), row, np.zeros_like(row)
        for bit, one, zeros, ones in self.levels:
            up = one[at]
            symbol |= up.astype(np.int64) << bit
            a, b = ones[low], ones[at]
            low = np.where(up, zeros + a, low - a)
            at = np.where(up, zeros + b, at - b)
        return self.counts[symbol] + at - low

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        todo, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            done = self.marked[row]
            out[todo[done]] = self.places[self.marks[row[done]]] + steps
            todo, row = todo[~done], self._back(row[~done])
            steps += 1
        return out


class Windows:
    """Distinct windows of the items, by length, as symbols (2 and up; 1 parts runs).

    What is sent is the items' symbols, four bytes a word, and the vocabulary; a worker lays the windows out
    once (opened()).
    """

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        symbol: dict[bytes, int] = {}
        own = [(name, [symbol.setdefault(w, len(symbol) + 2) for w in alnum_words(text or "")]) for name, text in items]
        own = [(name, s) for name, s in own if s]
        self.size = size
        self.names = [name for name, _ in own]
        self.words = b" ".join(symbol)
        self.ends = np.cumsum([len(s) for _, s in own], dtype=np.int64)
        self.sequence = np.concatenate([np.array(s, dtype=np.int32) for _, s in own] or [np.empty(0, np.int32)])
        self.ready = False

    def opened(self) -> Windows:
        if self.ready:
            return self
        self.symbol = {w: k for k, w in enumerate(self.words.split(), 2)}
        length = np.diff(self.ends, prepend=0)
        starts = self.ends - length
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows, ends of their items, items
        for n in np.unique(np.minimum(length, self.size)).tolist():
            held = np.flatnonzero(np.minimum(length, self.size) == n)
            many = length[held] - n + 1
            item = np.repeat(held, many)
            at = np.repeat(starts[held] - np.cumsum(many) + many, many) + np.arange(many.sum())
            windows, which = np.unique(self.sequence[at[:, None] + np.arange(n)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0)
            self.groups.append((windows.astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(windows)), side="right"), pairs[:, 1]))
        self.least = min((g[0].shape[1] for g in self.groups), default=1)
        self.ready = True
        return self


def _shard(docs: list[np.ndarray], windows: Windows) -> list[tuple[np.ndarray, set[int]]]:
    """Per document the covered word positions (increasing) and the items found. docs: symbols, 0 unknown."""
    symbols, owner, place = [], [], []
    for d, s in enumerate(docs):
        known = np.flatnonzero(s)
        if len(known) < windows.least:
            continue
        runs = np.split(known, np.flatnonzero(np.diff(known) > 1) + 1)
        for run in runs:
            if len(run) >= windows.least:
                symbols += [s[run], np.ones(1, dtype=np.int64)]
                owner.append(np.full(len(run) + 1, d))
                place += [run, np.full(1, -1)]
    out: list[tuple[np.ndarray, set[int]]] = [(np.empty(0, dtype=np.int64), set()) for _ in docs]
    if not symbols:
        return out
    text, owner, place = np.concatenate(symbols), np.concatenate(owner), np.concatenate(place)
    index = FMIndex(text)
    change = np.zeros(len(text) + 1, dtype=np.int64)
    for patterns, ends, items in windows.groups:
        lo, hi = index.search(patterns)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        many = hi[found] - lo[found]
        which = np.repeat(found, many)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]
        at = index.locate(rows)
        np.add.at(change, at, 1)
        np.add.at(change, at + patterns.shape[1], -1)
        for key in np.unique(which * len(docs) + owner[at]).tolist():
            k = key // len(docs)
            out[key % len(docs)][1].update(items[ends[k - 1] if k else 0 : ends[k]].tolist())
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    for d, own in zip(*_grouped(owner[hit], place[hit]), strict=True):
        out[d] = (own, out[d][1])
    return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.r_[0, cuts]].tolist(), np.split(values, cuts)


def spans(places: np.ndarray) -> str:
    """Merged spans of word positions, `start:end` with the end exclusive."""
    if not len(places):
        return ""
    cuts = np.flatnonzero(np.diff(places) > 1)
    return ",".join(f"{a}:{b + 1}" for a, b in zip(places[np.r_[0, cuts + 1]].tolist(), places[np.r_[cuts, len(places) - 1]].tolist(), strict=True))


def _places(written: str) -> np.ndarray:
    return np.concatenate([np.arange(*map(int, s.split(":"))) for s in written.split(",")]) if written else np.empty(0, dtype=np.int64)


def _blocks(benchmark: DataFrame, limit: int):
    """The items in blocks of about `limit` bytes, one at a time: (number of the block, whether it is the last, items)."""
    items = picked(benchmark, item_id="string", text="string")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    n = 1 + total // limit
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield k, k == n - 1, [(r["item_id"] or "", r["text"]) for r in part.collect()]


_FOUND = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string()))


def _searched(plain: DataFrame, text: str, benchmark: DataFrame, size: int, limit: int, clean: bool) -> DataFrame:
    """plain's rows, named by place, with what _FOUND lists; or, if `clean`, the rows that aren't contaminated as they are.

    The benchmark is gone through block by block: one is held by the driver and sent at a time, and what was
    found so far is kept with the rows in the shared folder.
    """
    spark = plain.sparkSession
    ship(spark)
    columns, out = plain.columns, plain
    schema = plain.schema

    def step(sent, first: bool, last: bool):
        def run(batches):
            begin()
            windows = sent.value.opened()
            known = windows.symbol.get
            held: list = []  # row batch, symbols by text

            def flush():
                found = iter(_shard([s for _, own in held for s, _ in own], windows))
                for part, own in held:
                    old = [("", [])] * len(own) if first else list(zip(part.column("old_spans").to_pylist(), part.column("old_items").to_pylist(), strict=True))
                    rows = []
                    for (before, names), (_, n) in zip(old, own, strict=True):
                        places, items = next(found)
                        places = np.union1d(places, _places(before)) if before else places
                        rows.append((places, sorted({*names, *(windows.names[i] for i in items)}), n))
                    head = [part.column(c) for c in columns]
                    bad = [len(p) > 0 and 20 * len(p) >= n for p, _, n in rows]
                    if not last:
                        yield pa.RecordBatch.from_arrays([*head, pa.array([spans(p) for p, _, _ in rows]), pa.array([i for _, i, _ in rows], pa.list_(pa.string()))], [*columns, "old_spans", "old_items"])
                    elif clean:
                        yield pa.RecordBatch.from_arrays(head, columns).filter(pa.array([not x for x in bad], pa.bool_()))
                    else:
                        got = [[n for _, _, n in rows], [len(p) for p, _, _ in rows], [len(i) for _, i, _ in rows], [hashlib.sha256(",".join(i).encode()).hexdigest() for _, i, _ in rows], bad, [spans(p) for p, _, _ in rows]]
                        yield pa.RecordBatch.from_arrays([*head, *(pa.array(x, kind) for x, (_, kind) in zip(got, _FOUND, strict=True))], [*columns, *(name for name, _ in _FOUND)])
                held.clear()

            symbols = n_docs = 0
            for part, texts in rows_in(batches, text):
                own = []
                for t in texts:
                    n, lists = 0, []
                    for words in alnum_parts(t):
                        n += len(words)
                        lists.append(np.fromiter((known(w, 0) for w in words), dtype=np.int32, count=len(words)))
                    s = np.concatenate(lists) if len(lists) > 1 else lists[0]
                    seen = int(np.count_nonzero(s))
                    if seen < windows.least:
                        s = s[:0]
                    else:
                        symbols += seen
                    own.append((s, n))
                held.append((part, own))
                n_docs += len(texts)
                if symbols >= SHARD_SYMBOLS or n_docs >= SHARD_DOCS:
                    yield from flush()
                    symbols = n_docs = 0
            if held:
                yield from flush()

        return run

    kept = T.StructType.fromDDL("old_spans string, old_items array<string>")
    more = T.StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")
    for k, last, items in _blocks(benchmark, limit):
        sent = spark.sparkContext.broadcast(Windows(items, size))  # of about `limit` bytes of text
        added = kept.fields if not last else [] if clean else more.fields
        out = out.mapInArrow(step(sent, not k, last), T.StructType([*schema.fields, *added]))
        if not last:
            out = staged(out, "searched")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of each row of docs (doc_id, text).

    Null texts have no words, neither have items without words; items that share an id count once; a null
    item id is the empty string; null ids and repeated rows are kept; an empty table of documents gives an
    empty result, an empty benchmark no hit. `spans` are the merged word ranges to remove. Words are taken
    from a text in parts, so a long one costs four bytes a word and the index of what it shares with items.
    """
    plain, at = positional(picked(docs, doc_id="long", text="string"))
    return _searched(plain, at["text"], benchmark, size, limit, False).select(F.col(at["doc_id"]).alias("doc_id"), *(name for name, _ in _FOUND))


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated rows; columns are addressed by place and stay as they are, whatever their names."""
    plain, at = positional(docs)
    return _searched(plain, at["text"], benchmark, size, limit, True).toDF(*docs.columns)
