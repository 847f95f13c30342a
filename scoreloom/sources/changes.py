"""Changes between successive daily documents, field by field, and the documents back from them.

A document is its leaves: a path of keys and positions, the leaf's JSON text, and the leaf's place among its siblings
at each level, which keeps the order of keys. Days are compared by a full outer join of each day with the next.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

LEAVES = "as_of date, path string, value string, places array<int>"


def _walk(value, path: list, places: list[int]) -> Iterator[tuple[list, list[int], object]]:
    """Leaves: what is no object and no list, and those that are empty."""
    if isinstance(value, dict | list) and value:
        for place, (key, inner) in enumerate(value.items() if isinstance(value, dict) else enumerate(value)):
            yield from _walk(inner, [*path, key], [*places, place])
    else:
        yield path, places, value


def leaves(documents: DataFrame) -> DataFrame:
    """as_of, path (a JSON list of keys and positions), value (JSON text), places for documents (as_of, value: JSON text).

    A null document has no leaves; one that is no JSON is an error; a day has one document.
    """
    ship(documents.sparkSession)
    schema = pa.schema([("as_of", pa.date32()), ("path", pa.string()), ("value", pa.string()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for day, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(day, json.dumps(p), json.dumps(v), at) for p, at, v in _walk(json.loads(text), [], [])] if text is not None else []
                yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema)

    return documents.select(F.col("as_of").cast("date").alias("as_of"), F.col("value").cast("string").alias("value")).mapInArrow(run, LEAVES)


def changes(found: DataFrame) -> DataFrame:
    """as_of, path, before, value, places, op: what a day's leaves add to, change in, move in or take from those of the day before it.

    The first day's leaves are all added. A leaf whose value stays and whose place among its siblings doesn't is moved.
    """
    days = found.select("as_of").distinct()  # a row a day
    order = days.select("as_of", F.lead("as_of").over(Window.orderBy("as_of")).alias("next"))
    prior = found.join(F.broadcast(order.filter("next is not null")), "as_of")
    b = prior.select(F.col("next").alias("b_day"), F.col("path").alias("b_path"), F.col("value").alias("before"), F.col("places").alias("b_places"))
    both = found.join(b, (F.col("as_of") == F.col("b_day")) & (F.col("path") == F.col("b_path")), "full")
    op = F.when(F.col("b_path").isNull(), "added").when(F.col("path").isNull(), "removed").when(F.col("value") != F.col("before"), "changed").when(F.col("places") != F.col("b_places"), "moved")
    return both.select(F.coalesce("as_of", "b_day").alias("as_of"), F.coalesce("path", "b_path").alias("path"), "before", "value", "places", op.alias("op")).filter("op is not null")


def _nested(rows: list[tuple[list, str]]):
    """The document of leaves in the order of their places."""
    out: list = [None]
    for path, value in rows:
        at, key = out, 0
        for step in path:
            if at[key] is None:
                at[key] = [] if isinstance(step, int) else {}
            at, key = at[key], step
            if isinstance(at, list):
                at.extend([None] * (key + 1 - len(at)))
            else:
                at.setdefault(key, None)
        at[key] = json.loads(value)
    return out[0]


def rebuilt(changed: DataFrame, days: DataFrame, indent: int = 2) -> DataFrame:
    """as_of, value: the document of each day (days: as_of), of which the changes up to it are told, as text with `indent` spaces a level.

    A leaf holds from its change to the next one of its path. A day's document is put together in one task, as it is one row.
    """
    ship(changed.sparkSession)
    until = F.lead("as_of").over(Window.partitionBy("path").orderBy("as_of"))
    held = changed.withColumn("until", until).filter("op <> 'removed'")
    on = (F.col("day") >= F.col("as_of")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    each = held.join(F.broadcast(days.select(F.col("as_of").alias("day")).distinct()), on)  # a row a day

    def put(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["places", "path", "value"]).to_pylist(), key=lambda r: r["places"])
        whole = _nested([(json.loads(r["path"]), r["value"]) for r in rows])
        return pa.table({"as_of": pa.array([table.column("day")[0].as_py()], pa.date32()), "value": [json.dumps(whole, indent=indent)]})

    return each.select("day", "path", "value", "places").groupBy("day").applyInArrow(put, "as_of date, value string")
