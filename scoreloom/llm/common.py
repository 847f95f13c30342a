"""Shared helpers of the corpus operators: reading, shared-folder staging, byte-balanced batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, shared_dir
from ..shipping import ship



def _thrifty() -> None:
    """Have freed arrays go back to the system at once: workers are reused, one operator after another."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):  # mmap threshold, trim threshold, arenas
            libc.mallopt(option, value)
    pa.set_memory_pool(pa.system_memory_pool())


_thrifty()

_KEPT: list[dict] = []


def kept() -> dict:
    """What a worker keeps between its tasks, until a function begins that has no use for it."""
    out: dict = {}
    _KEPT.append(out)
    return out


def begin() -> None:
    """At the start of a worker function that keeps nothing: what other operators have left in this worker goes."""
    if any(_KEPT):
        for held in _KEPT:
            held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


#: Bytes of text that Arrow functions take at a time.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named c0, c1, ... by place, and the new name of each old one (spelled exactly so).

    Names with dots or backticks, names that differ in case only and names that an operator uses itself
    can't clash; docs.columns give them back by toDF().
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(reversed(docs.columns), reversed(names), strict=True))


def picked(docs: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; others are not looked at, whatever their names."""
    plain, at = positional(docs)
    return plain.select(*[F.col(at[name]).cast(kind).alias(name) for name, kind in types.items()])


_SCRATCH: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), but as compressed Parquet: column pruning works when it is read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end; whatever is read from it must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        discard(spark, *_SCRATCH.pop())


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def byte_slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most `limit` bytes of text each; a longer row stands alone."""
    if not len(column):
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    lo, total = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > lo and total + n > limit:
            yield lo, k
            lo, total = k, 0
        total += n
    yield lo, len(size)


def rows_in(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Byte-balanced slices of the batches, each with its texts (null: empty)."""
    for batch in batches:
        column = batch.column(text)
        for lo, hi in byte_slices(column):
            part = batch.slice(lo, hi - lo)
            yield part, [t or "" for t in part.column(text).to_pylist()]


def texts_in(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Byte-balanced slices of the batches, each with its texts as an Arrow array (null: empty)."""
    for batch in batches:
        column = batch.column(text)
        for lo, hi in byte_slices(column, limit):
            part = batch.slice(lo, hi - lo)
            yield part, pc.fill_null(part.column(text).cast(pa.large_string()), "")


def shard_bounds(df: DataFrame, shards: int, key: str = "doc_id") -> list[int]:
    """Increasing cut points that deal `key` to about equal shards; reads that column alone."""
    if shards < 2:
        return []
    points = [k / shards for k in range(1, shards)]
    return sorted({int(x) for x in df.select(key).approxQuantile(key, points, 1 / (8 * shards))})


def shard_of(bounds: list[int]):
    """Column function: the shard of a key; null keys go first."""
    cuts = np.asarray(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def shard(keys):
        import pandas as pd

        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), dtype=np.int32)
        out[known] = np.searchsorted(cuts, keys[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    return shard


# Word hashes -----------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << max(16, (n - 1).bit_length())
        back = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, dtype=np.uint64)], dtype=np.uint64)
            _INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, back, dtype=np.uint64)], dtype=np.uint64)
    return _POWERS, _INVERSE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Words whose runs are hashed at a time; longer texts are taken in parts that overlap.
_RUN = 1 << 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of the runs of k words, in order (polynomial over the words joined by a space).

    Fewer words than k: the whole sequence as one; none: no hash.
    """
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) > _RUN + k:
        return np.concatenate([shingle_hashes(words[at : at + _RUN + k - 1], k) for at in range(0, len(words) - k + 1, _RUN)])
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    if len(words) <= k:
        starts, ends = np.zeros(1, dtype=np.int64), np.array([len(data)])
    else:
        gaps = np.flatnonzero(data == 32)
        starts = np.r_[0, gaps + 1][: len(words) - k + 1]
        ends = np.r_[gaps, len(data)][k - 1 :]
    power, back = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(7)) * power[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(raw)


#: A-Z to lower case, byte by byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def space_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


_ALNUM = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def alnum_parts(text: str, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lists that make up alnum_words(text), each of about `limit` bytes of text."""
    data = text.encode("utf-8", "surrogatepass").translate(_ALNUM)
    lo = 0
    while len(data) - lo > limit and (at := data.find(b" ", lo + limit)) >= 0:
        yield data[lo:at].split()
        lo = at
    yield data[lo:].split() if lo else data.split()
