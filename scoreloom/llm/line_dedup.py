"""Line dedup by site-relative frequency, with DataFrame functions alone.

A line's share is the pages of its host that contain it over the host's pages. Lines whose share is
over the boilerplate ratio are dropped from that host's pages. Lines are compared by two 64-bit hashes
after trimming; blank lines are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, positional, width

#: A line on more than this share of a host's pages, and on at least MIN_PAGES of them, is boilerplate.
RATIO, MIN_PAGES = 0.02, 3
#: The boilerplate list is broadcast up to this many lines (16 bytes each and the host's name).
BROADCAST_LINES = 100_000


def _key(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(7), trimmed, F.length(trimmed)).alias("b"))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, a, b: the lines over the ratio. pages: host, text (one row a page).

    Counts are summed before each exchange, so a host with a third of all pages sends few rows.
    """
    distinct = F.array_distinct(F.transform(F.filter(_lines(), lambda x: F.trim(x) != ""), _key))
    counted = pages.select("host", F.explode(distinct).alias("line")).groupBy("host", "line.a", "line.b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return counted.join(totals, counted["host"].eqNullSafe(totals["host"])).filter(F.col("n") > F.lit(ratio) * F.col("pages")).select(counted["host"].alias("host"), "a", "b")


def _marked(plain: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """row (all columns), lines, kept. plain's columns are named by place (common.positional).

    A host's list is short whatever the host's size: a listed line stands on over `ratio` of its pages, so
    there are at most 1 / ratio times the lines of an average page.
    """
    pages = plain.select(F.col(host).alias("host"), F.col(text).alias("text"))
    bad = cut(boilerplate(pages, ratio, min_pages))
    lists = bad.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("bad")).withColumnRenamed("host", "of")
    inner = plain.select(F.struct(*plain.columns).alias("row"), F.col(host).alias("host"), F.split(text, "\n").alias("lines"))
    if bad.count() <= BROADCAST_LINES:
        joined = inner.join(F.broadcast(lists), F.col("host").eqNullSafe(F.col("of")), "left")
    else:  # dealt by host and a salt, as many as there are tasks; each host's list is sent to all salts
        salts = width(plain.sparkSession)
        salted = inner.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
        lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(lists, F.col("host").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")), "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), _key(x)))
    return joined.select("row", "lines", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, and `n_chars` (if there) counted anew; all else stays.

    A null host is a host of its own; a null text stays null; lines that repeat within a page count
    once and are dropped together; a line whose share is just the ratio stays; an empty table stays empty.
    Columns are addressed by place, so extra ones may have any name. A text is one row of lines, whatever
    its length.
    """
    plain, at = positional(docs)
    text = F.array_join("kept", "\n")
    new = {at["text"]: text}
    if "n_chars" in at:
        new[at["n_chars"]] = F.length(text).cast(plain.schema[at["n_chars"]].dataType)
    marked = _marked(plain, at[host], at["text"], ratio, min_pages)
    return marked.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in plain.columns]).toDF(*docs.columns)


def line_report(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays) of each row; a null text has no lines. See dedup_lines()."""
    plain, at = positional(docs)
    slim = plain.select(at["doc_id"], at[host], at["text"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    marked = _marked(slim, at[host], at["text"], ratio, min_pages)
    lines = F.when(F.col("lines").isNotNull(), size("lines")).otherwise(F.lit(0).cast("long"))
    kept = F.when(F.col("lines").isNotNull(), size("kept")).otherwise(F.lit(0).cast("long"))
    return marked.select(F.col(f"row.{at['doc_id']}").cast("long").alias("doc_id"), lines.alias("n_lines"), (lines - kept).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


#: DuckDB twin of line_report over `documents` with the defaults.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, source, trim(x) AS line FROM (SELECT doc_id, source, unnest(lines) AS x FROM d)),
k AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= {MIN_PAGES}),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
b AS (SELECT k.source, list(line) AS bad FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source WHERE n > {RATIO}::DOUBLE * pages GROUP BY ALL),
f AS (SELECT doc_id, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x))) END AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text FROM f
"""
