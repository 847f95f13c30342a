"""File sources and sinks: JSON, JSONL, histories, capture indexes, settings, attachments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import panel

_GAME = f"game_no:bigint,name:string,price:double,percent_unsold:double,total_unclaimed:double,top_prizes:{schemas.TIERS}"
_DAY = f"as_of string, games array<struct<{_GAME}>>"
#: Types of attached files, caps in bytes, and (in attachments()) the lines around an attached text.
TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".gif": "image/gif", ".pdf": "application/pdf", ".wav": "wav", ".mp3": "mp3"}
FILE_CAP, TEXT_CAP, TOTAL_CAP = 10 << 20, 2 << 20, 20 << 20


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """file, html: one row a file, paths in order; no file is an error."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("html"))


def first_file(files: DataFrame) -> DataFrame:
    """The row whose file comes first by name."""
    return files.orderBy("file").limit(1)


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """article_id, source from documents {article_id: {source, ...}}; no file is no row, a bad one an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], "article_id string, source string")
    parsed = F.from_json("html", "map<string,struct<source:string>>", {"mode": "FAILFAST"})
    return whole_text(spark, path).select(F.explode(parsed).alias("article_id", "page")).select("article_id", "page.source")


def document_text(games: DataFrame, order: str = "game_no") -> DataFrame:
    """as_of, value: a day's rows as one JSON document {as_of, games: [...]}, nulls written, two spaces a level.

    A day's games are one row by their nature (some dozens); days are rendered apart from each other.
    """
    row = F.struct(order, *[c for c in games.columns if c not in (order, "as_of")])
    texts = games.select("as_of", F.struct(F.col(order).alias("place"), indented(F.to_json(row, {"ignoreNullFields": "false"})).alias("text")).alias("g"))
    whole = texts.groupBy("as_of").agg(F.array_sort(F.collect_list("g")).alias("games"))
    day = F.to_json(F.array("as_of"), {"ignoreNullFields": "false"})  # a list of one, which loses its brackets
    head = F.concat(F.lit('{\n  "as_of": '), F.substring(day, F.lit(2), F.length(day) - 2), F.lit(',\n  "games": [\n    '))
    return whole.select("as_of", F.concat(head, F.array_join(F.transform("games", lambda g: g.text), ",\n    "), F.lit("\n  ]\n}")).alias("value"))


@F.pandas_udf(T.StringType())
def indented(lines):
    """Each game's JSON with two spaces a level, as a member of a document's list."""
    import json

    return lines.map(lambda line: json.dumps(json.loads(line), indent=2).replace("\n", "\n    "))


def write_document(games: DataFrame, path: str, order: str = "game_no", history: str | None = None) -> None:
    """A day's rows as one JSON file at `path`, and the same bytes at `history`/<as_of>.json; either replaces itself.

    The text is written once, whole, in a folder beside the path, and copied from there under another name, which then
    takes the place of the old file in one step: a reader sees the old document or the new one, at any time.
    """
    spark = games.sparkSession
    held = document_text(games, order)
    beside = f"{path}-{uuid.uuid4().hex}"
    held.write.partitionBy("as_of").option("lineSep", "\n").text(beside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = at(beside).getFileSystem(conf)
    days = system.globStatus(at(f"{beside}/as_of=*/part-*"))
    if len(days) != 1:
        system.delete(at(beside), True)
        raise ValueError(f"{len(days)} days in place of one")
    day = days[0].getPath().getParent().getName().split("=", 1)[1]
    for to in (path, *([f"{history}/{day}.json"] if history else [])):
        fresh = at(f"{to}-{uuid.uuid4().hex}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(system, days[0].getPath(), system, fresh, False, True, conf)
        renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(fresh, at(to), renames)
    system.delete(at(beside), True)


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. strict: a bad line is an error; else it is dropped, and no file is no row."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Daily observations: a row for each game of each history file, with the file's sha256."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return observed(raw)


def observed(raw: DataFrame) -> DataFrame:
    """Rows of history files (path, content): batch and streaming alike."""
    day = raw.select("path", F.sha2("content", 256).alias("content_hash"), F.from_json(F.decode("content", "UTF-8"), _DAY).alias("d"))
    g = day.select("path", "content_hash", "d.as_of", F.explode("d.games").alias("g"))
    stamp = F.concat("as_of", F.lit("T00:00:00+00:00"))
    return g.select(
        "g.game_no", panel.game_key(F.col("g.game_no"), F.col("g.name")).alias("game_key"), F.col("as_of").alias("obs_date"), stamp.alias("capture_ts"), F.lit("daily").alias("source"), F.col("path").alias("capture_url"),
        stamp.alias("retrieved_at"), "content_hash", F.lit("daily@1").alias("parser_version"), "g.percent_unsold", panel.pu_interval(F.col("g.percent_unsold")).alias("pu_interval"),
        "g.total_unclaimed", "g.top_prizes", "g.price", "g.name", F.lit(None).cast("string").alias("lifecycle_status"), F.lit(False).alias("has_noncash_prize"),
    )


def captures(raw: DataFrame, column: str = "value", since: str = "20150101") -> DataFrame:
    """Capture index rows from JSON `[header, *rows]`: columns by the header's names; older ones are marked."""
    rows = raw.select(F.from_json(column, "array<array<string>>").alias("r"))
    rows = rows.select(F.when(F.col("r").isNull(), F.raise_error(F.lit("the capture index is no JSON list"))).otherwise(F.col("r")).alias("r")).filter("size(r) > 0")
    out = rows.select(F.col("r")[0].alias("h"), F.explode(F.slice("r", 2, 1_000_000_000)).alias("v")).select(F.map_from_arrays("h", "v").alias("m"))
    ts = F.col("m")["timestamp"]
    at = F.try_to_timestamp(ts, F.lit("yyyyMMddHHmmss"))
    return out.select(
        ts.alias("timestamp"), F.col("m")["original"].alias("original"), F.col("m")["digest"].alias("digest"), at.alias("captured_at"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("capture_ts"), F.concat(F.lit("https://web.archive.org/web/"), ts, F.lit("id_/"), F.col("m")["original"]).alias("capture_url"),
        F.when(at.isNull(), "parse_failed").when(ts < since, "era_skipped").otherwise("in_era").alias("status"),
    )


def backfill_summary(processed: DataFrame) -> DataFrame:
    """One row: captures by outcome, and the failures' texts in order."""
    s = F.col("status")
    return processed.agg(
        F.count("*").alias("captures_total"), F.count_if(s == "ok").alias("parsed"), F.count_if(s == "era_skipped").alias("era_skipped"), F.count_if(s == "parse_failed").alias("parse_failed"),
        F.sort_array(F.collect_list(F.when(s == "parse_failed", F.col("detail")))).alias("failures"),
    )


def accepted(summary: DataFrame, least: int = 150) -> DataFrame:
    """The summary of a backfill, and whether enough captures were parsed."""
    return summary.withColumn("passed", F.col("parsed") >= least)


def settings(lines: DataFrame, column: str = "value") -> DataFrame:
    """key, value of shell-like KEY="VALUE" lines (ordinal, value): quotes keep '#', comments go, the last line of a key wins."""
    s = F.trim(column)
    value = F.trim(F.regexp_replace(s, "^[^=]*=", ""))
    quote = F.substring(value, 1, 1)
    out = lines.filter((s != "") & ~s.startswith("#") & s.contains("=")).select("ordinal", F.trim(F.regexp_extract(s, "^([^=]*)=", 1)).alias("key"), value.alias("v"), quote.alias("q"))
    clean = F.when(F.col("q").isin("'", '"'), F.expr("substring_index(substring(v, 2), q, 1)")).otherwise(F.trim(F.substring_index("v", "#", 1)))
    return out.groupBy("key").agg(F.max_by(clean, "ordinal").alias("value"))


def attachments(raw: DataFrame) -> DataFrame:
    """Content parts of files (path, content): kind, mime, payload; `error` names what is too large or unreadable."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    mime = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[ext]
    size = F.octet_length("content")
    text = F.expr("try_validate_utf8(cast(content as string))")
    kind = F.when(mime.startswith("image/"), "image_url").when(mime == "application/pdf", "file").when(mime.isNotNull(), "input_audio").otherwise("text")
    body = F.when(mime.isNull(), F.concat(F.lit("===== ATTACHED FILE: "), name, F.lit(" =====\n"), text, F.lit("\n===== END "), name, F.lit(" =====")))
    uri = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content"))
    fault = F.when(mime.isNotNull() & (size > FILE_CAP), "attachment too large").when(mime.isNull() & (size > TEXT_CAP), "text too large").when(mime.isNull() & text.isNull(), "unsupported type")
    return raw.select("path", kind.alias("type"), mime.alias("mime"), F.when(kind == "input_audio", F.base64("content")).when(kind == "text", body).otherwise(uri).alias("payload"), size.alias("bytes"), fault.alias("error"))


def total_size(raw: DataFrame) -> DataFrame:
    return raw.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")).withColumn("passed", F.col("bytes") <= TOTAL_CAP)


def alphabetical(value, kind: T.DataType):
    """The value with the fields of its structs, at any depth, in alphabetical order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[alphabetical(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: alphabetical(x, kind.elementType))
    return value


def write_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines, keys in alphabetical order at any depth, nulls written; the same rows give the same lines."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    line = F.to_json(F.struct(*[alphabetical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})
    rows.orderBy(*order).select(line.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def panel_from(archive: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel, superseded) of both sources; on equal capture times the later source wins."""
    both = archive.withColumn("rank", F.lit(0)).unionByName(daily.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    order = ["rank", "content_hash", "capture_url"]
    return panel.with_lifecycle(panel.deduped(both, order)).drop("rank"), panel.superseded(both, order)


def settings_of(spark: SparkSession, path: str) -> DataFrame:
    return settings(spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), "value"))
