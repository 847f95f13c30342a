"""Recorded captures as a data source: index files name the pages, and only pages that the filters leave are opened.

A folder holds `index/*.json`, each a JSON list `[header, *rows]` as capture indexes give it, and `pages/<digest>.html`.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..shipping import ship

#: Columns that an index has, and that filters can be pushed down to.
INDEXED = ("timestamp", "original", "digest", "status")
SCHEMA = "timestamp string, original string, digest string, status string, html string"
_TESTS = {
    EqualTo: lambda x, y: x == y, EqualNullSafe: lambda x, y: x == y, In: lambda x, y: x in y, GreaterThan: lambda x, y: x > y,
    GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y,
}
#: Rows, and bytes of pages, in a batch.
ROWS, BYTES = 1000, 8 << 20
#: Index files of a partition at most, and partitions that there are before one takes a second file.
FILES, TASKS = 64, 64


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path there."""
    return fs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


class IndexFiles(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class CaptureReader(DataSourceReader):
    """A partition for some index files; a page is opened where a row that the pushed filters let through names it, once while it is held."""

    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if len(name) == 1 and name[0] in INDEXED and type(f) in _TESTS:
                self.tests.append((name[0], type(f), f.value))
            elif len(name) == 1 and name[0] in INDEXED and isinstance(f, IsNotNull):
                self.tests.append((name[0], IsNotNull, None))
            else:
                yield f  # Spark's own

    def partitions(self) -> list[InputPartition]:
        system, path = opened(f"{self.folder}/index")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        paths = sorted(f.path for f in found if f.is_file and f.path.endswith(".json"))
        many = max(1, min(FILES, len(paths) // TASKS))
        return [IndexFiles(paths[k : k + many]) for k in range(0, len(paths), many)]

    def _fits(self, row: dict) -> bool:
        return all(row[name] is not None and (kind is IsNotNull or _TESTS[kind](row[name], value)) for name, kind, value in self.tests)

    def read(self, partition: IndexFiles | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no index
            return
        system, path = opened(self.folder)
        names = [*INDEXED, "html"]
        schema = pa.schema([(n, pa.string()) for n in names])
        held: dict[str, list] = {n: [] for n in names}
        size, pages, kept = 0, {}, 0
        for file in partition.paths:
            with system.open_input_file(file) as f:
                header, *rows = json.loads(f.read().decode("utf-8")) or [[]]
            for values in rows:
                row = dict.fromkeys(INDEXED) | {"status": None} | dict(zip(header, values, strict=False))
                if not self._fits(row):
                    continue
                html = pages.get(row["digest"])
                if html is None:
                    with system.open_input_file(f"{path}/pages/{row['digest']}.html") as page:
                        html = page.read().decode("utf-8", "replace")
                    if kept + len(html) > BYTES:
                        pages, kept = {}, 0
                    pages[row["digest"]], kept = html, kept + len(html)
                for n in INDEXED:
                    held[n].append(row[n])
                held["html"].append(html)
                size += len(html)
                if len(held["html"]) == ROWS or size > BYTES:
                    yield pa.RecordBatch.from_pydict(held, schema)
                    held, size = {n: [] for n in names}, 0
        yield pa.RecordBatch.from_pydict(held, schema)


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options["path"])


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """timestamp, original, digest, status, html of the recorded captures of a folder.

    Filters on the index's columns are applied before a page is opened, so pages out of range need not be there; a page
    that is wanted and missing is an error, as is an index that is no JSON list. No index is no row.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captures)
    return spark.read.format("captures").load(folder)


def record(index: DataFrame, pages: DataFrame, folder: str) -> None:
    """Write a folder of recordings: index (file: its name without ending, place, timestamp, original, digest, status), pages (digest, html).

    An index file is one answer of the archive's index and is written whole by one task; a file that is there is replaced.
    """
    ship(index.sparkSession)

    def put(system, path: str, text: str) -> None:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(text.encode("utf-8"))

    def indexes(table: pa.Table) -> pa.Table:
        system, path = opened(folder)
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        name = rows[0]["file"]
        put(system, f"{path}/index/{name}.json", json.dumps([list(INDEXED), *[[r[c] for c in INDEXED] for r in rows]]))
        return pa.table({"file": [name]})

    def written(batches):
        system, path = opened(folder)
        for batch in batches:
            for digest, html in zip(batch.column("digest").to_pylist(), batch.column("html").to_pylist(), strict=True):
                put(system, f"{path}/pages/{digest}.html", html)
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest")})

    index.select("file", "place", *INDEXED).groupBy("file").applyInArrow(indexes, "file string").count()
    pages.select("digest", "html").mapInArrow(written, "digest string").count()
