"""N-gram Jaccard join: count-vector R-trees inside exact blocks.

A text is the set of its word runs, hashed to 64 bits. Texts of equal words are one class (128-bit
digest). Tokens are hashed into groups, and the group counts of a class are a point. Which points meet is
settled exactly: two sets that link differ in at most D tokens (D follows from their sizes), so with more
than D groups they agree in the whole content of some group. A class emits a signature for each of its
groups, and classes that share a signature meet in a bucket; no link is lost and no frequency is capped.

The candidates of a bucket come from an R-tree over its points: the sum of the coordinates' minima bounds
the overlap, for a node by its greatest coordinates. Surviving pairs are verified on the whole sets.

Rounds, each verified and joined into components: first, in one of SHARE buckets, all surviving pairs if
they are few a member, else those of each point with the first point that its search finds; the same in
the other buckets, between components; then, in buckets of which pairs were left out and that still hold
several components, all surviving pairs between these. What remains apart has no link. So a group of
copies is never written out as all its pairs, nor in each of the many buckets that it shares: a pair is left
to the first of its common buckets, as far as the members know their first ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, mix, picked, positional, rows_in, ship, shingle_hashes, space_words, staged, width
from .components import components

LEAST_CELLS, MOST_CELLS, LEAF = 8, 8192, 32
#: Members of a bucket that one task takes at a time; larger buckets are joined in blocks of this size.
BLOCK = 4096
#: A task takes its signatures in parts of about CHUNK, one after the other, and larger ones in runs of it;
#: a signature that fills more than HOT of a run is written out as it comes.
CHUNK, HOT = 1 << 21, 4096
#: Bits an id, least and most bits of the filter that keeps texts out of an exchange; its false positives cost time only.
ID_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 28
#: Classes that a task remembers, to pass over texts that it has seen.
SEEN = 1 << 19
#: A bucket writes out all its surviving pairs if they are at most so many a member.
DENSE = 4
#: One of so many buckets is joined in the first round, which links most copies.
SHARE = 16
#: Larger blocks first gather what is near their first members, so many of these.
CANOPY, CANOPIES = 1024, 64
#: Buckets of which each member knows that it is in them: its first ones.
FIRSTS = 8
_FLUSH = 1 << 20
_KEY = (1 << 48) - 1


class Rule:
    """Links: den * intersection >= num * union, over runs of `words` words."""

    def __init__(self, words: int, num: int, den: int = 100):
        self.words, self.num, self.den = words, num, den
        self.edges = [1]
        self.groups: list[tuple[int, int]] = []

    def needed(self, both):
        """The least intersection of linked sets whose sizes sum to `both`."""
        return -(-self.num * both // (self.num + self.den))

    def apart(self, both: int) -> int:
        """The greatest symmetric difference of linked sets whose sizes sum to `both`."""
        return both - 2 * int(self.needed(both))

    def band(self, n: int) -> int:
        """Bands of sizes; linked sets lie in one band or in two that follow each other."""
        while self.edges[-1] <= n:
            low = self.edges[-1]
            high = max(low + 1, -(-low * self.den**2 // self.num**2))
            most = max(self.apart(b) for b in range(max(2, 2 * high - 5), 2 * high - 1))
            count = most + 1
            for _ in range(3):  # room for groups that happen to be empty
                count = most + 1 + int(np.ceil(0.012 * count + 4 * np.sqrt(0.012 * count)))
            self.groups.append((most, count if most else 1))
            self.edges.append(high)
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def farthest(self, n: int, band: int) -> int:
        """The greatest symmetric difference of a set of n and one that it links with, of this band's sizes."""
        both = n + min(n * self.den // self.num, self.edges[band + 1] - 1)
        return max(self.apart(both), self.apart(both - 1))  # two more tokens never make it smaller

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set: of its groups in its own band, and in the next if its partners reach there."""
        n = len(tokens)
        own = self.band(n)
        bands = [own]
        reach = n * self.den // self.num
        if reach >= self.edges[own + 1]:
            self.band(reach)
            bands.append(own + 1)
        out = []
        high = tokens >> np.uint64(32)
        with np.errstate(over="ignore"):
            for band in bands:
                most, count = self.groups[band]
                most = min(most, self.farthest(n, band))
                group = (high * np.uint64(count)) >> np.uint64(32)
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                content = np.add.reduceat(mix(tokens + np.uint64(band * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)), first)
                names = group[first]
                if len(first) <= most:  # so many are empty that they may be all that agrees
                    rest = np.setdiff1d(np.arange(count, dtype=np.uint64), names)
                    names, content = np.r_[names, rest], np.r_[content, np.zeros(len(rest), dtype=np.uint64)]
                out.append(mix(content ^ mix(names * np.uint64(4096) + np.uint64(band))))
        return np.concatenate(out)

    def expected(self, tokens: int) -> int:
        """About how many signatures sets of so many tokens in all have."""
        return int(1.7 * tokens * self.apart(2000) / 1000)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        need = self.needed(len(a) + len(b))
        if len(a) < need:
            return False
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        return int(np.count_nonzero(b[at] == a)) >= need


def tokens_of(words: list[bytes], run: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, run))


def class_of(words: list[bytes]) -> tuple[int, int]:
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def point(tokens: np.ndarray) -> bytes:
    """Counts by group, four bits each (15: as many or more), of a group for two to four tokens."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (len(tokens) // 4).bit_length()))
    counts = np.minimum(np.bincount((tokens >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells), 15).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << np.uint8(4)).tobytes()


def spread(points: list[bytes]) -> np.ndarray:
    """The counts of points, folded to the fewest groups that any of them has (neighbouring groups are summed)."""
    sizes = np.array([len(p) for p in points])
    return _spread(np.frombuffer(b"".join(points), np.uint8), np.cumsum(sizes) - sizes, sizes)


def _spread(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    least = int(sizes.min())
    out = np.empty((len(sizes), least * 2), dtype=np.uint8)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        raw = data[starts[at][:, None] + np.arange(size)]
        full = np.stack([raw & np.uint8(15), raw >> np.uint8(4)], axis=2).reshape(len(at), least * 2, -1)
        out[at] = full[:, :, 0] if full.shape[2] == 1 else np.minimum(full.sum(axis=2, dtype=np.uint32), 255)
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=-1, dtype=np.int32)


class RTree:
    """Points of group counts, packed level by level.

    Each node holds its greatest coordinates, its least and greatest size, and the most tokens that its
    points' counts leave out (counts that were cut off); the bound allows for these. The tree's
    coordinates are sums of FOLD neighbouring groups, which rules out most points cheaply; what is left
    is bounded by all groups.
    """

    FOLD = 4

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rule: Rule, leaf: int = LEAF):
        self.rule, self.leaf = rule, leaf
        if len(points) > leaf:
            column = int(np.argmax(points[:256].var(axis=0)))
            self.order = np.lexsort((points[:, column], sizes))
        else:
            self.order = np.arange(len(points))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.extra = self.sizes - self.points.sum(axis=1, dtype=np.int64)
        coarse = np.minimum(self.points.reshape(len(points), -1, self.FOLD).sum(axis=2, dtype=np.uint16), 255).astype(np.uint8)
        self.levels = [(coarse, self.sizes, self.sizes, self.sizes - coarse.sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > leaf:
            top, least, most, extra = self.levels[-1]
            at = np.arange(0, len(top), leaf)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(extra, at)))

    def _under(self, top, least: int, most: int, extra: int) -> np.ndarray:
        """Places whose node may hold a partner of a node with these bounds."""
        num, den = self.rule.num, self.rule.den
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high, rest = self.levels[depth]
            at = at[(low[at] * num <= most * den) & (high[at] * den >= least * num)]
            if depth == 0 or not len(at):
                break
            bound = _overlap(tops[at], top) + np.minimum(rest[at], extra)
            at = at[bound >= self.rule.needed(low[at] + least)]
            at = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            at = at[at < len(self.levels[depth - 1][0])]
        return at

    def pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(x, y) of places x in [lo, hi) and places y whose overlap with x is not ruled out (x itself included)."""
        return self.pairs_of(np.arange(lo, hi))

    def pairs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x, y) of these places x (a few) and places y whose overlap with x is not ruled out (x itself included)."""
        top, _, _, extra = self.levels[0]
        own, size, rest = top[places], self.sizes[places], extra[places]
        at = self._under(own.max(axis=0), int(size.min()), int(size.max()), int(rest.max()))
        found = []
        for k in range(0, len(at), 512):
            some = at[k : k + 512]
            bound = _overlap(own[:, None], top[some][None]) + np.minimum(rest[:, None], extra[some][None])
            x, y = np.nonzero(bound >= self.rule.needed(size[:, None] + self.sizes[some][None]))
            x, y = places[x], some[y]
            for j in range(0, len(x), 8192):
                p, q = x[j : j + 8192], y[j : j + 8192]
                fine = _overlap(self.points[p], self.points[q]) + np.minimum(self.extra[p], self.extra[q])
                fits = fine >= self.rule.needed(self.sizes[p] + self.sizes[q])
                found.append((p[fits], q[fits]))
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def near(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in self.order) whose overlap with place x is not ruled out, and the bounds."""
        at = self.pairs(x, x + 1)[1]
        return at, _overlap(self.points[at], self.points[x]) + np.minimum(self.extra[at], self.extra[x])


def common(lists: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """64 bits for each list: which of the values marked in `before` it has, of the 64 that most lists have."""
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[before]
    values, place, count = np.unique(lists[before], return_inverse=True, return_counts=True)
    bit = np.full(len(values), 64)
    most = np.argsort(-count, kind="stable")[:64]
    bit[most] = np.arange(len(most))
    out = np.zeros(len(ends), dtype=np.uint64)
    known = bit[place] < 64
    np.bitwise_or.at(out, own[known], np.uint64(1) << bit[place][known].astype(np.uint64))
    return out


def between(points: np.ndarray, sizes: np.ndarray, groups: np.ndarray, blocks: np.ndarray, rule: Rule, every: bool, dense: int = DENSE, met: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Surviving pairs (rows x, y) between groups, and whether these are all.

    All of them, if `every` or if they are few (`dense` a member); else each point with the first one that its search finds.
    With two blocks at hand only pairs across the blocks count. Points come in the order that makes one first.
    Pairs that have a bit of `met` in common are left to an earlier bucket.
    """
    tree = RTree(points, sizes, rule)
    group, block, n = groups[tree.order], blocks[tree.order], len(points)
    earlier = np.zeros(n, dtype=np.uint64) if met is None else met[tree.order]
    two = bool(block.min() != block.max())
    pairs: list[np.ndarray] = []
    whole = True
    if not every and n > CANOPY:
        place = np.empty(n, dtype=np.int64)
        place[tree.order] = np.arange(n)
        group, free, tried = group.copy(), np.ones(n, dtype=bool), 0
        for x in place.tolist():
            if tried == CANOPIES:
                break
            if free[x]:
                tried += 1
                at = tree.near(x)[0]
                at = at[free[at] & (at != x)]
                free[x] = False
                if len(at):
                    free[at] = False
                    fresh = at[(earlier[at] & earlier[x]) == 0]
                    pairs.append(np.stack([np.full(len(fresh), x), fresh], axis=1))
                    group[np.isin(group, np.unique(group[at]))] = group[x]
                    whole = False
    names, count = np.unique(group, return_counts=True)
    largest = names[np.argmax(count)]
    total = 0
    kept: list[np.ndarray] = []
    if len(names) > 1:
        outside = np.flatnonzero(group != largest)
        for lo in range(0, len(outside), tree.leaf):
            x, y = tree.pairs_of(outside[lo : lo + tree.leaf])
            use = (group[x] != group[y]) & ((group[y] == largest) | (y > x))
            if two:
                use &= block[x] != block[y]
            use &= (earlier[x] & earlier[y]) == 0
            x, y = x[use], y[use]
            total += len(x)
            if every or total <= dense * n + LEAF:
                kept.append(np.stack([x, y], axis=1))
            else:  # each point with the first one found
                whole = False
                rank = tree.order[y]
                o = np.lexsort((rank, x))
                one = np.r_[True, x[o][1:] != x[o][:-1]] if len(x) else np.empty(0, bool)
                kept.append(np.stack([x[o][one], y[o][one]], axis=1))
    found = np.concatenate([*pairs, *kept, np.empty((0, 2), np.int64)])
    return tree.order[found], whole


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, the class (d, e), point of each row (no class without words)."""
    words_in = rule.words

    def run(batches):
        begin()
        for part, texts in rows_in(batches):
            own = [space_words(t) for t in texts]
            sets = [tokens_of(w, words_in) for w in own]
            names = [class_of(w) if w else (None, None) for w in own]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([c[0] for c in names], pa.int64()), pa.array([c[1] for c in names], pa.int64()), pa.array([point(s) for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "d", "e", "point"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d long, e long, point binary")


def _six(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower 48 bits of values, as one binary value for each run of them that ends at `ends`."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.r_[0, ends] * 6).astype(np.int32)), pa.py_buffer(data)])


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _buckets(docs: DataFrame, rule: Rule, parts: int, tokens: int) -> DataFrame:
    """bucket, m, key: the members of the signatures that two classes or more share (equal buckets once).

    A key is 48 bits of a class; it stands for all classes that have them. m is 0 in buckets that are
    written out as they come. Rows travel as 48 bits of a signature and, once for all of a class's
    signatures in a part, the key.
    """
    split = 1 + rule.expected(tokens) // (parts * CHUNK)
    cells = parts * split

    def emit(batches):
        begin()
        seen: set[int] = set()
        held: list = []
        count = 0

        def flush():
            sig = np.concatenate([s for s, _ in held])
            own = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
            keys = np.array([k for _, k in held], dtype=np.uint64)
            held.clear()
            cell = (((sig >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            sig, own, cell = sig[order], own[order], cell[order]
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            run = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (own[1:] != own[:-1])])
            size = np.diff(np.r_[run, len(sig)]).astype("<u4")
            last = np.r_[start[1:], len(sig)]
            runs = np.searchsorted(run, last)
            sizes = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((np.r_[0, runs] * 4).astype(np.int32)), pa.py_buffer(size)])
            return pa.RecordBatch.from_arrays([pa.array(cell[start].astype(np.int32)), _six(sig, last), _six(keys[own[run]], runs), sizes], ["cell", "sigs", "keys", "sizes"])

        for _, texts in rows_in(batches):
            for t in texts:
                words = space_words(t)
                if not words or (key := class_of(words)) in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()  # one that comes again is one class all the same
                seen.add(key)
                held.append((rule.signatures(tokens_of(words, rule.words)), key[0] & _KEY))
                count += len(held[-1][0])
                if count >= _FLUSH:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def met(sig, key, hot):
        """The buckets of these signatures; those of the signatures in `hot` are named by the signature alone."""
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
        sig, key = sig[new], key[new]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        m = np.diff(np.r_[start, len(sig)])
        with np.errstate(over="ignore"):
            name = np.add.reduceat(mix(key), start) + m.astype(np.uint64)
        loose = np.isin(sig[start], hot)
        name[loose] = mix(sig[start][loose])
        many = np.flatnonzero((m > 1) | loose)
        _, first = np.unique(name[many], return_index=True)
        size = np.where(loose, 0, m)
        for lo in range(0, len(first), 4096):
            some = many[first[lo : lo + 4096]]
            rows = np.repeat(start[some], m[some]) + np.arange(m[some].sum()) - np.repeat(np.cumsum(m[some]) - m[some], m[some])
            names, sizes = np.repeat(name[some].view(np.int64), m[some]), np.repeat(size[some], m[some])
            for at in range(0, len(rows), 100_000):
                cutout = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[cutout]), pa.array(sizes[cutout], pa.int64()), pa.array(key[rows[cutout]].view(np.int64))], ["bucket", "m", "key"])

    def meet(batches):
        begin()
        cell, held, count = None, [], 0
        hot = np.empty(0, np.uint64)

        def joined():
            out = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            return out

        for batch in batches:
            for c, s, k, n in zip(*(batch.column(x).to_pylist() for x in ("cell", "sigs", "keys", "sizes")), strict=True):
                if c != cell and held:
                    yield from met(*joined(), hot)
                    count, hot = 0, np.empty(0, np.uint64)
                cell = c
                held.append((_wide(s), np.repeat(_wide(k), np.frombuffer(n, "<u4"))))
                count += len(held[-1][0])
                if count >= CHUNK:  # write out what a few signatures fill; keep the rest
                    sig, key = joined()
                    names, n = np.unique(sig, return_counts=True)
                    hot = np.union1d(hot, names[n > HOT])
                    loose = np.isin(sig, hot)
                    if loose.any():
                        yield from met(sig[loose], key[loose], hot)
                    held.append((sig[~loose], key[~loose]))
                    count = 0
        if held:
            yield from met(*joined(), hot)

    dealt = docs.mapInArrow(emit, "cell int, sigs binary, keys binary, sizes binary")
    dealt = dealt.repartitionById(parts, F.expr(f"cast(cell div {split} as int)")).sortWithinPartitions("cell")
    found = dealt.mapInArrow(meet, "bucket long, m long, key long").groupBy("bucket", "key").agg(F.max("m").alias("m"))
    return found.select("bucket", "m", "key")


def _place(size: int, key: str = "doc_id"):
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(size))


def _held(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    place = place.astype(np.int64)
    return (bits[place >> 6].view(np.uint64) >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed doc_id, ID_BITS bits an id: at most 32 MB, which beyond 17 million ids keep out fewer texts."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (ID_BITS * ids.count()).bit_length()))
    place = ids.select(_place(size).alias("p"))
    words = place.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(size // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out


def _maybe(bits: np.ndarray, key: str = "doc_id"):
    """False where the filter rules the id out."""

    @F.pandas_udf("boolean")
    def maybe(place):
        import pandas as pd

        return pd.Series(_held(bits, place.to_numpy()))

    return maybe(_place(64 * len(bits), key))


def _sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """node, tokens of the classes in `wanted` (node: the smallest doc_id, d, e).

    Texts are picked by a bounded filter before the exchange, by the join after it.
    """
    words_in = rule.words
    some = docs.filter(_maybe(_bitmap(wanted.select(F.col("node").alias("doc_id")))))
    found = some.join(wanted, F.col("doc_id") == F.col("node")).select("node", "d", "e", "text", F.xxhash64("text").alias("h"))
    found = found.dropDuplicates(["node", "d", "e", "h"])  # a row that is repeated is one set

    def run(batches):
        begin()
        for part, texts in rows_in(batches):
            own = [space_words(t) for t in texts]
            same = [class_of(w) == c for w, c in zip(own, zip(part.column("d").to_pylist(), part.column("e").to_pylist(), strict=True), strict=True)]
            rows = part.filter(pa.array(same, pa.bool_()))
            sets = [tokens_of(w, words_in).astype("<u8").tobytes() for w, s in zip(own, same, strict=True) if s]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary())], ["node", "tokens"])

    return found.mapInArrow(run, "node long, tokens binary")


def _pairs(members: DataFrame, rule: Rule, parts: int, every: bool, dense: int = DENSE) -> DataFrame:
    """a, b: nodes to verify. members: bucket, early, i, j, own, node, size, point, component, firsts, n_early; (bucket, i, j) names a block.

    A row without a and b names a bucket of which not all surviving pairs are given.
    """

    def run(batches):
        begin()
        rest: pa.RecordBatch | None = None
        out: list[np.ndarray] = []
        left: set[int] = set()

        def sent():
            pairs = np.unique(np.concatenate([*out, np.empty((0, 2), np.int64)]), axis=0)
            names = sorted(left)
            out.clear()
            left.clear()
            blank, none = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(names), pa.int64())
            columns = [pa.concat_arrays([pa.array(pairs[:, k]), none]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([blank, pa.array(names, pa.int64())])], ["a", "b", "bucket"])

        def block(batch, lo, hi):
            node, component, own, size, bucket = (np.asarray(batch.column(c)[lo:hi]) for c in ("node", "component", "own", "size", "bucket"))
            if component.min() == component.max():
                return
            points = batch.column("point")[lo:hi]
            ends = np.frombuffer(points.buffers()[1], np.int32)[points.offset : points.offset + len(points) + 1].astype(np.int64)
            counts = _spread(np.frombuffer(points.buffers()[2], np.uint8), ends[:-1], np.diff(ends))
            # the first bucket that two members share, by the same order in all rounds, is never passed over
            lists = batch.column("firsts")[lo:hi]
            stops = np.cumsum(np.asarray(lists.value_lengths()))
            firsts = np.asarray(lists.flatten())
            place = np.arange(len(firsts)) - np.repeat(np.r_[0, stops[:-1]], np.diff(stops, prepend=0))
            of_early = place < np.repeat(np.asarray(batch.column("n_early")[lo:hi]), np.diff(stops, prepend=0))
            early = batch.column("early")[lo].as_py()
            before = (of_early == early) & (firsts < bucket[0]) | of_early & (not early)
            found, whole = between(counts, size, component, own, rule, every, dense, common(firsts, stops, before))
            if not whole:
                left.add(int(bucket[0]))
            if len(found):
                out.append(np.sort(node[found], axis=1))

        def blocks(batch) -> pa.RecordBatch:
            """Join the blocks of the batch but for the last one, which may go on in the next batch."""
            names = [np.asarray(batch.column(c)) for c in ("bucket", "i", "j")]
            edges = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1
            cuts = [0, *edges.tolist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                block(batch, lo, hi)
            return batch.slice(cuts[-1])

        for batch in batches:
            if batch.num_rows:
                rest = blocks(pa.concat_batches([rest, batch]) if rest is not None else batch)
                if sum(map(len, out)) > 100_000:
                    yield sent()
        if rest is not None:
            block(rest, 0, rest.num_rows)
        if out or left:
            yield sent()

    dealt = members.select("bucket", "early", "i", "j", "own", "node", "component", "size", "point", "firsts", "n_early").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return dealt.mapInArrow(run, "a long, b long, bucket long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """The pairs (a, b) that link. A task holds the sets of one a and streams those of its b; many of these are dealt in blocks."""

    def run(batches):
        begin()
        name, own = None, []
        for batch in batches:
            keep = []
            for a, s, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "s", "b", "tokens")), strict=True):
                if (a, s) != name:
                    name, own = (a, s), []
                tokens = np.frombuffer(data, "<u8")
                if b is None:
                    own.append(tokens)
                keep.append(b is not None and any(rule.linked(tokens, x) for x in own))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).withColumnRenamed("a", "c")
    dealt = pairs.join(many, F.col("a") == F.col("c")).select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("s"), "b")
    partners = dealt.join(sets, F.col("b") == F.col("node")).select("a", "s", "b", "tokens")
    centres = many.join(sets, F.col("c") == F.col("node")).select(F.col("c").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"), F.lit(None).cast("long").alias("b"), "tokens")
    return centres.unionByName(partners).repartition(parts, "a", "s").sortWithinPartitions("a", "s", "b").mapInArrow(run, "a long, b long")


def _blocks(placed: DataFrame) -> DataFrame:
    """Every bucket's blocks in the first rounds: a large bucket's members in parts of about BLOCK, each by itself."""
    own = F.pmod(F.xxhash64("node", "bucket"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK))).cast("int")
    return placed.withColumn("own", own).withColumns({"i": F.col("own"), "j": F.col("own")})


def _tiles(placed: DataFrame) -> DataFrame:
    """Blocks of buckets with several components, between which all pairs are looked for.

    A bucket's largest component is dealt in parts, none of which meets another; each meets every part of
    the other components, and these meet each other.
    """
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sums = counts.groupBy(F.col("bucket").alias("of")).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("components")).filter("components > 1")
    ceil = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    sums = sums.select("of", F.col("top.component").alias("largest"), F.when(F.col("all") <= BLOCK, 0).otherwise(ceil(F.col("top.n"))).alias("x"), ceil(F.col("all") - F.col("top.n")).alias("y"))
    wide = placed.join(sums, F.col("bucket") == F.col("of"))
    inside = F.col("component") == F.col("largest")
    own = F.when(F.col("x") == 0, 0).when(inside, F.pmod(F.xxhash64("node"), F.col("x"))).otherwise(F.col("x") + F.pmod(F.xxhash64("node"), F.col("y"))).cast("int")
    others = F.when(F.col("x") == 0, F.array(F.lit(0))).when(inside, F.sequence(F.col("x"), F.col("x") + F.col("y") - 1)).otherwise(F.sequence(F.lit(0), F.col("x") + F.col("y") - 1))
    wide = wide.withColumn("own", own).withColumn("other", F.explode(others))
    return wide.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text): groups of texts that links connect.

    Fewer words than a run: the whole sequence is one. Texts without words (null, empty) link with nothing
    and are their own component; a null id has no component; rows that repeat a text are of one class, and
    rows that repeat an id are one document: its links are those of all its texts. An empty table gives an
    empty result; other columns are not read. A text of any length is one set; a task holds one in memory
    (some 100 bytes a word), and two of them when a pair is verified.
    """
    spark = docs.sparkSession
    ship(spark)
    rule, parts = Rule(words, num, den), width(spark)
    rows = picked(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    owners = staged(classes(rows, rule), "owners")
    known = rows.filter("doc_id is not null")
    tokens = owners.agg(F.sum("n_shingles").alias("n")).collect()[0]["n"] or 0
    members = staged(_buckets(known, rule, parts, tokens), "buckets")
    named = owners.filter("d is not null and doc_id is not null")
    nodes = named.groupBy("d", "e").agg(F.min("doc_id").alias("node"))
    # the few classes that meet another, with their points
    keyed = named.withColumn("key", F.col("d").bitwiseAND(F.lit(_KEY)))
    early = F.pmod(F.xxhash64("bucket"), F.lit(SHARE)) == 0
    firsts = members.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct((~early).alias("late"), "bucket"))), 1, FIRSTS).alias("f"))
    firsts = firsts.select(F.col("key").alias("of"), F.col("f.bucket").alias("firsts"), F.size(F.filter("f", lambda x: ~x.late)).alias("n_early"))
    points = keyed.join(members.select("key").distinct(), "key", "left_semi").groupBy("key", "d", "e").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("point").alias("point"))
    vertices = staged(points.join(firsts, F.col("key") == F.col("of")).drop("of"), "vertices")
    hot = members.filter("m = 0").groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("many"))
    sized = members.join(hot, F.col("bucket") == F.col("of"), "left").select("bucket", F.coalesce("many", "m").alias("m"), "key")
    links = grown = None
    open_ = sized.filter(F.col("m") > BLOCK).select(F.col("bucket").alias("left"))  # buckets of which pairs are left out
    for number in range(3):
        held = vertices.withColumn("component", F.col("node"))
        if grown is not None:
            held = held.drop("component").join(grown.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node"))
        chosen = sized.filter(early if number == 0 else ~early)
        if number == 2:
            chosen = sized.join(open_.distinct(), F.col("bucket") == F.col("left"), "left_semi")
        placed = chosen.join(held.select("key", "node", "size", "point", "component", "firsts", "n_early"), "key").drop("key").withColumn("early", early)
        # after the first round copies are components, and what survives between these is seldom much
        found = staged(_pairs(_tiles(placed) if number == 2 else _blocks(placed), rule, parts, number == 2, DENSE << 2 * number), "pairs")
        open_ = open_.unionByName(found.filter("bucket is not null").select(F.col("bucket").alias("left")))
        pairs = found.filter("a <> b").select("a", "b")
        if pairs.isEmpty():
            continue
        named_pairs = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(vertices.select("node", "d", "e"), "node")
        wanted = staged(named_pairs, "wanted")  # read for the filter and for the texts
        sets = staged(_sets(known, wanted, rule), "sets")
        new = staged(_verified(pairs, sets, rule, parts), "links")
        links = new if links is None else links.unionByName(new)
        grown = components(links)
    if grown is None:
        grown = spark.createDataFrame([], "node long, component long")
    grown = grown.withColumnRenamed("node", "of")
    whole = nodes.join(grown, F.col("node") == F.col("of"), "left").select(F.col("d").alias("in_d"), F.col("e").alias("in_e"), F.coalesce("component", "node").alias("group"))
    return owners.join(whole, (F.col("d") == F.col("in_d")) & (F.col("e") == F.col("in_e")), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id. Rows without an id stay.

    Different texts of a repeated id are documents of their own, of which the smaller digest comes first;
    of rows that repeat both id and text one stays. Columns are addressed by place, so others may have any
    name; all stay as they are. An empty table stays empty.
    """
    plain, at = positional(docs)
    key, text = at["doc_id"], at["text"]
    ids = plain.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("gone"))
    repeated = staged(ids.count().filter("count > 1").select("gone"), "repeated")
    if repeated.isEmpty():
        joined = jaccard_join(plain.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words, num, den)
        gone = staged(joined.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
        left = _without(plain, key, gone)
    else:
        left = _one_of_repeated(plain, key, text, repeated, words, num, den)
    return left.toDF(*docs.columns)


def _without(plain: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """plain but for rows whose key is in `gone`; only rows that the filter doesn't clear are joined."""
    flagged = plain.withColumn("maybe", _maybe(_bitmap(gone.select(F.col("gone").alias("doc_id"))), key))
    clear = flagged.filter("not maybe").select(*plain.columns)
    doubtful = flagged.filter("maybe").join(gone, F.col(key).cast("long") == F.col("gone"), "left_anti").select(*plain.columns)
    return clear.unionByName(doubtful)


def _one_of_repeated(plain: DataFrame, key: str, text: str, repeated: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """one_of_each where ids repeat: each (id, text) of a repeated id gets a key that no id has."""
    whole = plain.withColumns({"id": F.col(key).cast("long"), "digest": F.sha2(F.coalesce(text, F.lit("")), 256)})
    own = whole.join(repeated, F.col("id") == F.col("gone"), "left_semi").dropDuplicates(["id", "digest"])
    own = staged(own.withColumn("key", F.monotonically_increasing_id()), "own")
    low, high = whole.agg(F.min("id"), F.max("id")).first()
    fresh = F.lit(high) + 1 + F.col("key") if high < 1 << 62 else F.lit(low) - 1 - F.col("key")
    own = own.withColumn("key", fresh.cast("long"))
    single = whole.join(repeated, F.col("id") == F.col("gone"), "left_anti").withColumn("key", F.col("id"))
    every = single.unionByName(own)
    groups = jaccard_join(every.select(F.col("key").alias("doc_id"), F.col(text).alias("text")), words, num, den)
    groups = staged(groups.filter("doc_id is not null").select("doc_id", "component_id"), "groups")
    names = own.select(F.col("key").alias("of"), "id", "digest")
    order = F.struct(F.coalesce("id", "doc_id").alias("id"), "digest", F.col("doc_id").alias("key"))
    placed = groups.join(names, F.col("doc_id") == F.col("of"), "left").select("component_id", order.alias("o"))
    first = placed.groupBy("component_id").agg(F.min("o").alias("first"))
    gone = staged(placed.join(first, "component_id").filter("o.key <> first.key").select(F.col("o.key").alias("gone")), "gone")
    return _without(every, "key", gone).select(*plain.columns)
