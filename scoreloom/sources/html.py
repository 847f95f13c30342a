"""HTML scans: a tokenizer turns pages into rows and links; everything after it is relational."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import text as T
from ..shipping import ship

_ITEMS = "array<struct<kind:string,ordinal:int,cells:array<string>>>"
KINDS = ("table", "row", "p", "h1", "link", "text")
#: Characters of pages whose items are given on at a time.
BYTES = 1 << 20
#: Tags without attributes, which most are: the same as HTMLParser makes of them, without its search for attributes.
_PLAIN, _PLAIN_END = re.compile("<(td|tr|th|p|b|i|li|ul|span|div)>"), re.compile("</(td|tr|th|p|b|i|li|ul|a|span|div)>")
_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "wbr"}


class _Scan(HTMLParser):
    """Rows of the first table of a class, paragraphs, first h1, links, and all text pieces."""

    def __init__(self, wanted: str, written: bool = False):
        super().__init__(convert_charrefs=True)
        self.wanted, self.written, self.items = wanted, written, []
        self.table = 0  # depth inside the wanted table
        self.done = False
        self.row = self.cell = self.para = self.head = None
        self.pieces: list[str] = []
        self.skip = 0

    def parse_starttag(self, i):
        m = _PLAIN.match(self.rawdata, i)
        if m is None or self.cdata_elem is not None:
            return super().parse_starttag(i)
        self.handle_starttag(m[1], ())
        return m.end()

    def parse_endtag(self, i):
        m = _PLAIN_END.match(self.rawdata, i)
        if m is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def add(self, kind: str, *cells: str) -> None:
        self.items.append((kind, len(self.items), list(cells)))

    def close_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append("".join(self.cell))
        self.cell = None

    def close_row(self):
        self.close_cell()
        if self.row is not None:
            self.add("row", *self.row)
        self.row = None

    def close_para(self):
        if self.para is not None:
            self.add("p", "".join(self.para))
        self.para = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            if self.table:
                self.table += 1
            elif not self.done and self.wanted in (a.get("class") or "").split():
                self.table = 1
                self.add("table")
        elif tag == "tr" and self.table:
            self.close_row()
            self.row = []
        elif tag == "td" and self.table:
            self.close_cell()
            self.cell = []
        elif tag == "th" and self.table:
            self.close_cell()
        elif tag == "p":
            self.close_para()
            self.para = []
        elif tag == "h1" and self.head is None:
            self.head = []
        elif tag == "a" and a.get("href"):
            self.add("link", a["href"])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.table:
            self.table -= 1
            if not self.table:
                self.close_row()
                self.done = True
        elif tag == "tr" and self.table:
            self.close_row()
        elif tag == "td":
            self.close_cell()
        elif tag == "p":
            self.close_para()
        elif tag == "h1" and isinstance(self.head, list):
            self.add("h1", "".join(self.head) if self.written else "".join(self.head).strip())
            self.head = False

    def handle_data(self, data):
        if self.skip:
            return
        self.pieces.append(data)
        for held in (self.cell, self.para, self.head):
            if isinstance(held, list):
                held.append(data)


def scan(page: str | None, wanted: str = "tbstriped", written: bool = False) -> list[tuple[str, int, list[str]]]:
    """The items of a page; `written`: with character references as they stand in the source."""
    s = _Scan(wanted, written)
    s.feed((page or "").replace("&", "&amp;") if written else page or "")
    s.close()
    s.close_row()
    s.close_para()
    s.add("text", "\n".join(s.pieces))
    return s.items


def scanned(pages: DataFrame, keep: list[str], column: str = "html", wanted: str = "tbstriped", kinds: tuple[str, ...] = KINDS, written: bool = False) -> DataFrame:
    """keep and the page's items of some kinds, `found`: pages are taken and given in batches of a few MB, and each is scanned once."""
    ship(pages.sparkSession)
    rows = pages.select(*keep, F.col(column).cast("string").alias("__page"))
    rows = rows.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keep, "__page")  # scanning is the work: small inputs too use all cores

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("ordinal", pa.int32()), ("cells", pa.list_(pa.string()))]))
        for batch in batches:
            first, held, size = 0, [], 0
            texts = batch.column(batch.num_columns - 1)
            for k in range(len(texts)):
                page = texts[k].as_py()
                held.append([item for item in scan(page, wanted, written) if item[0] in kinds])
                size += len(page or "")
                if size >= BYTES or k == len(texts) - 1:
                    found = pa.array([[{"kind": a, "ordinal": b, "cells": c} for a, b, c in items] for items in held], kind)
                    part = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*part.schema.names[:-1], "found"])
                    first, held, size = k + 1, [], 0

    schema = StructType([*rows.schema.fields[:-1], StructField("found", DataType.fromDDL(_ITEMS))])
    return rows.mapInArrow(run, schema)


def items(pages: DataFrame, keep: list[str], column: str = "html", wanted: str = "tbstriped", kinds: tuple[str, ...] = KINDS, written: bool = False) -> DataFrame:
    """keep, kind (table, row, p, h1, link, text), ordinal, cells: one row for each item of a page."""
    return scanned(pages, keep, column, wanted, kinds, written).select(*keep, F.explode("found").alias("i")).select(*keep, "i.kind", "i.ordinal", "i.cells")


def snapshots(pages: DataFrame, key: str = "page", column: str = "html", tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(games, errors) of unclaimed-prize pages: the games with their tiers in page order, and what is wrong by page.

    Rows whose first five cells are blank continue the game above them. A page with any error gives no game.
    A page is read where it is: its rows stay together, so no page is exchanged, and each result scans it once.
    """
    found = scanned(pages, [key], column, kinds=("table", "row", "p"))
    cell = lambda x, k: F.get(x.cells, F.lit(k))

    def seen(x):
        level = T.integer(F.regexp_replace(T.plain(cell(x, 5)), r"[$]", ""))
        return F.struct(x.ordinal.alias("ordinal"), x.cells.alias("cells"), (~F.forall(F.slice(x.cells, 1, 5), T.blank)).alias("head"), level.alias("level"))

    def row(x):
        first = {"price": T.money(cell(x, 0)), "game_no": T.integer(cell(x, 1)), "name": T.plain(cell(x, 2)), "percent_unsold": T.percent(cell(x, 3)), "total_unclaimed": T.money(cell(x, 4))}
        label = F.when(x.level.isNull(), F.regexp_replace(T.plain(cell(x, 5)), r"(?U)\s+", " "))
        return F.struct(x.ordinal.alias("ordinal"), x.head.alias("head"), *[F.when(x.head, c).alias(n) for n, c in first.items()], x.level.alias("level"), label.alias("level_label"), T.integer(cell(x, 6)).alias("remaining"))

    of = lambda kind: F.filter("found", lambda x: x.kind == kind)
    rows = F.filter(of("row"), lambda x: F.size(x.cells) > 0)
    stamps = F.array_compact(F.transform(of("p"), lambda x: T.after_as_of(x.cells[0])))
    page = found.select(key, (F.size(of("table")) > 0).alias("table"), F.get(stamps, F.lit(0)).alias("source_timestamp"), rows.alias("rows"))
    page = page.select(key, "table", "source_timestamp", F.exists("rows", lambda x: F.size(x.cells) != 7).alias("narrow"), F.transform(F.transform(F.filter("rows", lambda x: F.size(x.cells) == 7), seen), row).alias("rows"))
    # a game is the rows from one head up to the next
    page = page.withColumn("heads", F.array_compact(F.transform("rows", lambda x, k: F.when(x.head, k + 1))))
    headed = F.slice("rows", F.coalesce(F.get("heads", F.lit(0)), F.size("rows") + 1), F.size("rows"))
    bad_head = lambda x: x.head & (x.price.isNull() | x.game_no.isNull() | x.percent_unsold.isNull() | x.total_unclaimed.isNull())
    bad_tier = lambda x: x.remaining.isNull() | (F.lit(not tolerant) & x.level.isNull())
    faults = {
        "missing data table": ~F.col("table"), "no 'as of' paragraph": F.col("source_timestamp").isNull(), "not 7 cells": F.col("narrow"),
        "orphan continuation row": (F.size("rows") > 0) & ~F.coalesce(F.get("rows", F.lit(0)).head, F.lit(False)), "malformed cell": F.exists(headed, lambda x: bad_head(x) | bad_tier(x)),
    }
    page = page.withColumn("errors", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in faults.items()])))
    errors = page.select(key, F.explode("errors").alias("error")).distinct()

    def game(at, k):
        first, past = F.get("rows", at - 1), F.coalesce(F.get("heads", k + 1), F.size("rows") + 1)
        tiers = F.transform(F.slice("rows", at, past - at), lambda x: F.struct(x.level.alias("level"), x.level_label.alias("level_label"), x.remaining.alias("remaining")))
        return F.struct(*[first[c].alias(c) for c in ("ordinal", "game_no", "name", "price", "percent_unsold", "total_unclaimed")], tiers.alias("top_prizes"))

    games = F.when(F.size("errors") == 0, F.transform("heads", game))
    out = page.select(key, "source_timestamp", F.explode(games).alias("g"))
    return out.select(key, "g.*", "source_timestamp"), errors


def articles(pages: DataFrame, key: str = "article_id", column: str = "html") -> DataFrame:
    """Metadata of article pages: every field but the id may be null."""
    found = items(pages, [key], column, kinds=("text", "h1"))
    text = F.max(F.when(F.col("kind") == "text", F.col("cells")[0]))
    name = F.min_by(F.col("cells")[0], F.when(F.col("kind") == "h1", F.col("ordinal")))
    out = found.groupBy(key).agg(text.alias("text"), name.alias("name"))
    number = lambda n: F.regexp_replace(T.label(F.col("text"), n), ",", "")
    return out.select(
        key, "name", number("game_no").try_cast("bigint").alias("game_no"), number("print_run").try_cast("bigint").alias("print_run"), number("overall_odds").try_cast("double").alias("overall_odds"),
        number("top_prize_value").try_cast("bigint").alias("top_prize_value"), T.month_day(T.label(F.col("text"), "on_sale")).alias("on_sale"),
    )


def scratch_dates(pages: DataFrame, key: str = "page", column: str = "html") -> DataFrame:
    """game_no, name, end_date, last_cash_date; other rows are skipped, the last row of a game wins."""
    rows = items(pages, [key], column, kinds=("row",)).filter("size(cells) = 4")
    cell = lambda k: T.plain(F.col("cells")[k])
    out = rows.select(key, "ordinal", cell(0).try_cast("bigint").alias("game_no"), cell(1).alias("name"), T.month_day(cell(2)).alias("end_date"), T.month_day(cell(3)).alias("last_cash_date")).filter("game_no is not null")
    w = Window.partitionBy("game_no").orderBy(F.desc(key), F.desc("ordinal"))
    return out.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", key, "ordinal")


def tile_prices(pages: DataFrame, file: str = "file", column: str = "html") -> DataFrame:
    """article_id, price: the article links of price pages, the price from the file's name."""
    links = items(pages, [file], column, kinds=("link",)).select(file, F.col("cells")[0].alias("href")).filter("contains(href, 'whatsnew/index.php') and contains(href, 'v=article')")
    price = F.nullif(F.regexp_extract(file, r"scratch(\d+)dollar", 1), F.lit("")).try_cast("double")
    found = F.nullif(F.regexp_extract("href", r"[?&]id=(\d+)", 1), F.lit(""))
    return links.select(found.alias("article_id"), price.alias("price")).filter("article_id is not null").distinct()
