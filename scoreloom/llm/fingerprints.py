"""Document fingerprints by consistent weighted sampling.

The terms of a text are its runs of two words (A-Z lower-cased), weighted by their counts. Each of SAMPLES
samples draws, for each term, r and c from Gamma(2, 1) and b from [0, 1), takes t = floor(ln w / r + b)
and a = c exp(-r (t - b) - r), and keeps the term with the least a together with its t. Two texts agree in a
sample with a probability that equals their generalised Jaccard similarity, the sum of the lesser over the
sum of the greater weights. A term's draws are a row of a fixed table, chosen by the term's hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, picked, rows_in, shard_bounds, shard_of, ship, shingle_hashes, space_words, width

SAMPLES, RUN = 64, 2
_ROW_BITS, _SEED, _ROWS_AT_ONCE = 15, 20_240_601, 8192
_FIRST = -(1 << 63)


class Draws:
    """The table of r, ln c and b, and for weight 1 the ready ln a as integers in the same order."""

    _one: Draws | None = None

    def __init__(self):
        g = np.random.Generator(np.random.Philox(_SEED))
        shape = (1 << _ROW_BITS, SAMPLES)
        u = g.random((5, *shape), dtype=np.float32)
        u = np.maximum(u, np.float32(1e-12))
        self.r = -np.log(u[0]) - np.log(u[1])
        self.c = np.log(-np.log(u[2]) - np.log(u[3]))
        self.b = u[4]
        self.one = self.ordered(self.c + self.r * self.b - self.r)

    @staticmethod
    def ordered(a: np.ndarray) -> np.ndarray:
        """float32 -> uint64 with the float's order in the upper half."""
        raw = a.astype(np.float32).view(np.uint32)
        raw = np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(1 << 31))
        return raw.astype(np.uint64) << np.uint64(32)

    @classmethod
    def get(cls) -> Draws:
        cls._one = cls._one or cls()
        return cls._one


def signature(text: str) -> np.ndarray:
    """SAMPLES numbers of 16 bits; a text without words has zeros."""
    return weighted(*np.unique(shingle_hashes(space_words(text), RUN), return_counts=True))


def weighted(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(terms):
        return np.zeros(SAMPLES, dtype=np.uint16)
    draws = Draws.get()
    row = (terms >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
    one = np.flatnonzero(weights == 1)
    best = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(one), _ROWS_AT_ONCE):
        k = one[lo : lo + _ROWS_AT_ONCE]
        a = draws.one[row[k]]
        a |= k.astype(np.uint64)[:, None]
        np.minimum(best, a.min(axis=0), out=best)
    t_best = np.zeros(SAMPLES, dtype=np.int64)
    more = np.flatnonzero(weights != 1)
    for lo in range(0, len(more), _ROWS_AT_ONCE):
        k = more[lo : lo + _ROWS_AT_ONCE]
        r, b = draws.r[row[k]], draws.b[row[k]]
        t = np.floor(np.log(weights[k]).astype(np.float32)[:, None] / r + b)
        a = Draws.ordered(draws.c[row[k]] - r * (t - b) - r) | k.astype(np.uint64)[:, None]
        at = a.argmin(axis=0)
        least = a[at, np.arange(SAMPLES)]
        better = least < best
        best[better], t_best[better] = least[better], t[at, np.arange(SAMPLES)].astype(np.int64)[better]
    term = terms[(best & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    with np.errstate(over="ignore"):
        return (mix(term + t_best.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    Rows follow each other by doc_id (nulls first), then text; the last row's next one is the first. Null
    texts are empty; texts without words share one fingerprint; an only row is its own next one; an empty
    table gives an empty result. Each range of ids goes to one task with the first row of the next range.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = picked(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    shards = width(spark)
    cuts = shard_bounds(rows, shards)
    key = F.coalesce("doc_id", F.lit(_FIRST))
    dealt = rows.select("doc_id", "text", shard_of(cuts)("doc_id").alias("shard"))
    firsts = sorted((r["shard"], r["first"]) for r in rows.select(key.alias("k"), shard_of(cuts)("doc_id").alias("shard")).groupBy("shard").agg(F.min("k").alias("first")).collect())  # one row a shard
    before = {firsts[k][1]: firsts[k - 1][0] for k in range(len(firsts))}
    own = F.struct("shard", F.lit(0).alias("tail"))
    if before:
        at = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[key]
        places = F.when(at.isNull(), F.array(own)).otherwise(F.array(own, F.struct(at.cast("int").alias("shard"), F.lit(1).alias("tail"))))
    else:
        places = F.array(own)
    dealt = dealt.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.shard", "p.tail")

    def run(batches):
        held = None  # doc_id, text, signature
        shard = None

        def row(now, text, sign):
            changed = edited_text(now[1], text)
            other = signature(changed)
            return (now[0], len(now[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), now[2].tobytes().hex(), other.tobytes().hex(), likeness(now[2], other), likeness(now[2], sign))

        def sent(out):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for part, texts in rows_in(batches):
            out = []
            for doc, text, s, tail in zip(part.column("doc_id").to_pylist(), texts, part.column("shard").to_pylist(), part.column("tail").to_pylist(), strict=True):
                if s != shard:
                    shard, held = s, None
                elif held is None:  # rows that repeat the next range's first id
                    continue
                sign = signature(text)
                if held is not None:
                    out.append(row(held, text, sign))
                held = None if tail else (doc, text, sign)
            if out:
                yield sent(out)

    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "tail", "doc_id", "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
