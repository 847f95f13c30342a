"""Erasure of clients and of all that hangs on them, by rewriting the data files that hold them.

Tables are laid out as sorted Parquet files of a fixed number of rows. Victims are found by joins of keys; each
file's keys meet its exact victim keys in a cogroup, where pandas keeps the survivors' places. The file itself is
read and written in Arrow, batch by batch, since pandas would turn whole numbers with nulls into doubles. A
rewritten file is written beside the old one and takes its place only when all files are done, so a task can run
again at any time.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, positional, scratch, shared_dir, staged, width

#: Rows of a file that a task holds at a time.
ROWS = 1 << 16
#: Fixed values of the contract: files of 1 + floor(n / FILES) rows; a master whose crc32 it divides is a victim.
FILES, DIVISOR = 350, 400
#: The tables and the amount that is summed up as cents.
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


@dataclass
class Laid:
    """A table as files, and its rows' keys by file: file_no, rank, key (null: none), id, cents."""

    name: str
    columns: list[str]
    n: int
    size: int
    keys: DataFrame


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def _file(folder: str, table: str, number: int) -> str:
    return f"{folder}/{table}/{number:05d}.parquet"


class _Writer:
    """A Parquet file that appears under its name only when it is whole."""

    def __init__(self, uri: str, schema: pa.Schema):
        self.system, self.to = _system(uri)
        folder, name = self.to.rsplit("/", 1)
        self.held = f"{folder}/_{name}-{uuid.uuid4().hex}"
        self.system.create_dir(folder, recursive=True)
        self.out = self.system.open_output_stream(self.held)
        self.writer = pq.ParquetWriter(self.out, schema, compression="zstd")

    def close(self, keep: bool = True) -> None:
        self.writer.close()
        self.out.close()
        if keep:
            self.system.move(self.held, self.to)
        else:
            self.system.delete_file(self.held)


def owner_hash(client):
    """crc32 of a client's id in decimal; no client: of the empty string."""
    return F.crc32(F.coalesce(client.cast("string"), F.lit("")).cast("binary"))


def laid_out(table: DataFrame, name: str, folder: str, key: str, client, amount: str, files: int = FILES) -> Laid:
    """Sort `table` by its rows' clients and all columns, write the files, and keep what the rewriting has to know.

    `client` gives the clients' column of the table whose columns are named c0, c1, ... by place, and may join.
    """
    spark = table.sparkSession
    plain, at = positional(table)
    owned, owner = client(plain, at)
    names = plain.columns
    ordered = owned.withColumn("h", owner_hash(owner)).select("h", *names).orderBy("h", *[F.col(c).asc_nulls_first() for c in names])
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(ordered.select(F.spark_partition_id().alias("pid"), pos.alias("pos"), *names), f"sorted-{name}")
    per = rows.groupBy("pid").agg(F.count("*").alias("rows"))  # a row a partition
    n = per.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).collect()[0]["n"]
    size = 1 + n // files
    before = F.coalesce(F.sum("rows").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(per.select("pid", before.alias("before"))), "pid").withColumn("rank", F.col("before") + F.col("pos"))
    placed = placed.select(F.expr(f"rank div {size}").alias("file_no"), "rank", *names)
    count = -(-n // size)
    dealt = placed.repartitionByRange(max(1, min(count, 4 * width(spark))), "file_no").sortWithinPartitions("file_no", "rank")
    true_names = table.columns

    def write(batches):
        current, out = None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            lo = 0
            while lo < len(numbers):
                number = int(numbers[lo])
                hi = lo + int((numbers[lo:] == number).sum())
                body = pa.Table.from_batches([batch.slice(lo, hi - lo)]).drop_columns(["file_no", "rank"]).rename_columns(true_names)
                if number != current:
                    if out:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"file_no": [current]}, pa.schema([("file_no", pa.int64())]))
                    current, out = number, _Writer(_file(folder, name, number), body.schema)
                out.writer.write_table(body)
                lo = hi
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": [current]}, pa.schema([("file_no", pa.int64())]))

    written = dealt.mapInArrow(write, "file_no long").count()
    if written != count:
        raise RuntimeError(f"{written} files in place of {count}")
    money = F.floor(F.col(at[amount]).cast("double") * 100 + 0.5)
    finite = ~F.isnan(F.col(at[amount]).cast("double")) & (F.abs(F.col(at[amount]).cast("double")) != float("inf"))
    cents = F.coalesce(F.when(finite, money), F.lit(0))
    keys = placed.select("file_no", "rank", F.col(at[key]).cast("long").alias("key"), F.coalesce(F.col(names[0]).cast("string"), F.lit("")).alias("id"), cents.alias("cents"))
    return Laid(name, true_names, n, size, keys)


def victim_masters(clients: DataFrame, clicks: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """master: those whose crc32 `divisor` divides, and the one whose clients have most clicks (tie: the smallest).

    A client that is listed twice under a master counts once.
    """
    owned = clients.filter("master_id is not null").select("client_id", "master_id").distinct()
    by_client = clicks.filter("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    sums = owned.join(by_client, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    most = sums.agg(F.min_by("master_id", F.struct(-F.col("n"), "master_id")).alias("master")).filter("master is not null")
    struck = owned.select("master_id").distinct().filter(F.crc32(F.col("master_id").cast("string").cast("binary")) % divisor == 0)
    return struck.select(F.col("master_id").alias("master")).union(most).distinct()


def rewritten(table: Laid, victims: DataFrame, folder: str, beside: str) -> DataFrame:
    """A row for each file of the table: what is left of it. Files with rows whose key is in victims (key) are written anew.

    A file's keys (of FILES parts of the table) are in a task at once; its rows are read in batches.
    """
    # not a semi join, which would be moved before the distinct and meet a hot key's rows in place of its files
    held = table.keys.filter("key is not null").select("file_no", "key").distinct().join(victims.distinct(), "key")
    left = table.keys.select("file_no", "rank", F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNotNull().alias("keyed"), "id", "cents")
    name, size, columns = table.name, table.size, ",".join(table.columns)

    def erase(rows: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        number = int(rows["file_no"].iloc[0])
        doomed = rows["key"].isin(keys["key"]) & rows["keyed"]
        kept = rows[~doomed]
        if len(kept) < len(rows) and len(kept):
            _rewrite(_file(folder, name, number), _file(beside, name, number), (~doomed).to_numpy())
        digest = hashlib.sha256(",".join(kept["id"]).encode()).hexdigest()
        row = {"file_no": number, "n_rows": len(kept), "n_erased": int(doomed.sum()), "cents": sum(kept["cents"].tolist()), "rewritten": bool(doomed.any()), "table_name": name, "ids_sha256": digest, "columns": columns, "path": _file(folder, name, number)}
        return pd.DataFrame([row])

    deal = min(width(left.sparkSession) * 4, -(-table.n // size) or 1)
    held = held.select(F.col("file_no").alias("of"), "key")
    both = left.repartition(deal, "file_no").groupBy("file_no").cogroup(held.repartition(deal, "of").groupBy("of"))
    return both.applyInPandas(erase, "file_no long, n_rows long, n_erased long, cents long, rewritten boolean, table_name string, ids_sha256 string, columns string, path string")


def _rewrite(old: str, new: str, kept) -> None:
    """Write the kept rows of a file as another, batch by batch, with the schema that the old one has."""
    system, at = _system(old)
    with system.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        out = _Writer(new, file.schema_arrow)
        done = 0
        try:
            for batch in file.iter_batches(batch_size=ROWS):
                out.writer.write_table(pa.Table.from_batches([batch.filter(pa.array(kept[done : done + batch.num_rows]))], file.schema_arrow))
                done += batch.num_rows
            if done != len(kept):
                raise RuntimeError(f"{old} has {done} rows in place of {len(kept)}")
        except BaseException:
            out.close(keep=False)
            raise
        out.close()


def _replaced(spark: SparkSession, report: DataFrame, folder: str, beside: str) -> None:
    """Put the rewritten files in the old ones' places and remove the emptied; names of at most FILES files a table."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = at(folder).getFileSystem(conf)
    for r in report.filter("rewritten").select("table_name", "file_no", "n_rows").collect():
        old = at(_file(folder, r["table_name"], r["file_no"]))
        system.delete(old, False)
        if r["n_rows"] and not system.rename(at(_file(beside, r["table_name"], r["file_no"])), old):
            raise RuntimeError(f"{old} was not replaced")
    for name in {r["table_name"] for r in report.select("table_name").distinct().collect()}:
        for held in system.listStatus(at(f"{folder}/{name}")):
            if held.getPath().getName().startswith("_"):  # of a task that was lost
                system.delete(held.getPath(), False)
    system.delete(at(beside), True)


def erase_clients(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, folder: str | None = None, files: int = FILES, divisor: int = DIVISOR) -> DataFrame:
    """Lay the tables out as files in a new folder, erase the victims, and report what the folder holds in the end.

    A row a file: file_no, n_rows, n_erased, cents, rewritten, table_name, ids_sha256, columns, path. Victims are the
    clients of the victim masters, these clients' clicks and sales, and these sales' lines. Null keys are never
    victims; a line whose sale is unknown has no client; of a sale that is listed twice the smallest client counts
    for the order, and its lines go if any of its rows does. Amounts that are null or not finite are 0 cents. Repeated
    rows stay repeated; an empty table has no files; further columns and clashing names are kept as they are.
    """
    spark = clients.sparkSession
    folder = folder or f"{shared_dir(spark)}/erased-{uuid.uuid4().hex}"
    beside = f"{folder}-new"
    own = lambda t, at: (t, F.col(at["client_id"]))
    with scratch(spark):
        sold = picked(sales, sale_id="long", client_id="long")
        owners = staged(sold.filter("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("owner")), "owners")

        def of_sale(t, at):
            return t.join(owners, F.col(at["sale_id"]).cast("long") == F.col("sale_id"), "left"), F.col("owner")

        laid = {
            "clients": laid_out(clients, "clients", folder, "master_id", own, AMOUNTS["clients"], files),
            "clicks": laid_out(clicks, "clicks", folder, "client_id", own, AMOUNTS["clicks"], files),
            "sales": laid_out(sales, "sales", folder, "client_id", own, AMOUNTS["sales"], files),
            "sale_lines": laid_out(sale_lines, "sale_lines", folder, "sale_id", of_sale, AMOUNTS["sale_lines"], files),
        }
        listed = picked(clients, client_id="long", master_id="long")
        masters = staged(victim_masters(listed, picked(clicks, client_id="long"), divisor), "masters")
        gone = listed.filter("client_id is not null").join(masters, listed["master_id"] == masters["master"], "left_semi").select(F.col("client_id").alias("key")).distinct()
        gone = staged(gone, "victims")
        lost = sold.filter("sale_id is not null").join(gone, sold["client_id"] == gone["key"], "left_semi").select(F.col("sale_id").alias("key")).distinct()
        victims = {"clients": masters.select(F.col("master").alias("key")), "clicks": gone, "sales": gone, "sale_lines": lost}
        parts = [rewritten(laid[name], victims[name], folder, beside) for name in laid]
        report = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
        to = f"{folder}-report"
        report.write.parquet(to)
    report = spark.read.schema(report.schema).parquet(to)
    _replaced(spark, report, folder, beside)
    return report.filter("n_rows > 0")
