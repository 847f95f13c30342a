"""Token ids of a corpus as rANS-coded segments, in ascending order of documents.

Layout: a Parquet dataset, its files in ascending order of doc_id, with one row per segment: `shard`, `seq` (order within the shard), `start`
(ids of the shard before it), `n_tokens`, `table` (rans.Table), `blocks` (rans blocks sharing that
table) and the index of its documents (`doc_ids`, `doc_tokens`). A segment holds whole documents; a
task holds one segment at a time, so its memory is bounded by SEGMENT tokens or one document.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import picked, shard_bounds, shared_dir, texts_in, width
from .tokens import opened

SEGMENT, BLOCK = 4 << 20, 1 << 20
_SEGMENTS = "shard int, seq int, start long, n_tokens long, table binary, blocks array<binary>, doc_ids array<long>, doc_tokens array<long>"


def encoded(docs: DataFrame, kind: str, path: str, end_id: int, shards: int) -> DataFrame:
    """shard, doc_id, n, ids (packed little-endian), by ranges of doc_id; end_id closes each document."""
    rows = picked(docs, doc_id="long", text="string")
    cuts = np.asarray(shard_bounds(rows, shards), dtype=np.int64)

    def encode(batches):
        encoder = opened(kind, path)
        for part, texts in texts_in(batches):
            keys = part.column(0)
            known = np.asarray(keys.is_valid())
            shard = np.where(known, np.searchsorted(cuts, np.asarray(keys.fill_null(0)), side="right"), 0)
            ids, ends = encoder.closed(texts, end_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), keys, pa.array(np.diff(ends, prepend=0), pa.int64()), binaries(ids, ends)],
                ["shard", "doc_id", "n", "ids"],
            )

    return rows.mapInArrow(encode, "shard int, doc_id long, n long, ids binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")


def binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ids, which end at `ends`, as one binary value each, without a copy."""
    offsets = (np.concatenate([[0], ends]) * ids.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def write(docs: DataFrame, path: str, to: str, kind: str = "word", end_id: int = 1, lanes: int = 1024, every: int = 256, segment: int = SEGMENT) -> None:
    """Encode `docs` (doc_id, text) with the tokenizer file `path` and write the dataset `to`.

    Null texts are empty documents (the end id alone); null ids come first; rows that repeat an id
    are documents of their own, ordered by their ids' bytes; an empty table gives a dataset without rows.
    """

    def pack(batches):
        kept, shard, seq, start = [], None, 0, 0
        kind_of = opened(kind, path).kind

        def flush():
            nonlocal seq, start
            ids = np.frombuffer(b"".join(x[1] for x in kept), kind_of)
            table = rans.Table.of(ids)
            blocks = [rans.encode(ids[at : at + BLOCK], table, lanes, every) for at in range(0, len(ids), BLOCK)]
            row = {"shard": [shard], "seq": [seq], "start": [start], "n_tokens": [len(ids)], "table": [table.pack()], "blocks": [blocks], "doc_ids": [[x[0] for x in kept]], "doc_tokens": [[len(x[1]) // kind_of.itemsize for x in kept]]}
            seq, start = seq + 1, start + len(ids)
            kept.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("table", pa.binary()), ("blocks", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]))

        size = 0
        for batch in batches:
            for s, doc, n, ids in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "n", "ids")), strict=True):
                if kept and (s != shard or size + n > segment):
                    yield flush()
                    size = 0
                if s != shard:
                    shard, seq, start = s, 0, 0
                kept.append((doc, ids))
                size += n
        if kept:
            yield flush()

    shards = width(docs.sparkSession)
    encoded(docs, kind, path, end_id, shards).mapInArrow(pack, _SEGMENTS).write.option("compression", "none").parquet(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the dataset, decoded in parallel: segments by tasks, each
    block from all its checkpoints at once."""
    segments = spark.read.schema(_SEGMENTS).parquet(at)
    # one number a shard: as many as the session's shuffle partitions
    totals = {r["shard"]: r["n"] for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    base, before = {}, 0
    for shard in sorted(totals):
        base[shard], before = before, before + totals[shard]

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table = rans.Table.unpack(row["table"])
                ids = np.concatenate([rans.decode(b, table) for b in row["blocks"]] or [np.empty(0, np.uint32)]).astype("<u4")
                if len(ids) != row["n_tokens"] or sum(row["doc_tokens"]) != len(ids):
                    raise rans.Damaged("length")
                stop = np.cumsum(row["doc_tokens"])
                data, first = memoryview(ids.tobytes()), base[row["shard"]] + row["start"]
                lows = (stop - row["doc_tokens"]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([first + lo for lo in lows], pa.int64()),
                        pa.array(row["doc_tokens"], pa.int64()),
                        pa.array([zlib.crc32(data[4 * lo : 4 * hi]) for lo, hi in zip(lows, stop.tolist(), strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame, path: str) -> DataFrame:
    """Write the dataset into the shared folder and read it back."""
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, to)
    return read(spark, to)
