"""State streams, the schema gate, gates over a history, as-of joins: worked rows and brute force."""

import bisect
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import gates, json_schema, panel
from scoreloom.streaming import lifecycle

D0 = dt.date(2024, 1, 1)
T0 = dt.datetime(2024, 1, 1)
OBSERVED = "game_key string, obs_date date, capture_ts timestamp_ntz, place long, capture_url string, percent_unsold double"


def _row(game, day, hour, place, pu):
    return (game, D0 + dt.timedelta(days=day), T0 + dt.timedelta(days=day, hours=hour), place, f"u{place}", pu)


def _fed(spark, tmp_path, batches, changes):
    """What a stream that is fed batch by batch, each in a run of its own, writes in all."""
    for rows in batches:
        spark.createDataFrame(rows, OBSERVED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(OBSERVED).parquet(f"{tmp_path}/in")
        lifecycle.fold_into(changes(stream), f"{tmp_path}/out", f"{tmp_path}/state")


def test_lifecycle_state(spark, tmp_path):
    """Exits seen and unseen, a game that comes back after its timer, a later capture of the same day, over three runs."""
    batches = [
        [_row("back", 0, 1, 1, 5.0), _row("gone", 0, 2, 2, 7.0), _row("zero", 1, 1, 3, 0.0), _row("on", 3, 1, 4, 2.0)],
        [_row("back", 6, 1, 5, 4.0), _row("on", 6, 2, 6, 1.0), _row("on", 6, 3, 7, 0.0)],
        [_row("new", 9, 1, 8, 3.0), _row("on", 9, 1, 9, 2.0)],
    ]
    _fed(spark, tmp_path, batches, lifecycle.lifecycle_changes)
    got = lifecycle.labels(spark.read.schema(lifecycle.LABELS).parquet(f"{tmp_path}/out"))
    rows = spark.createDataFrame([r for b in batches for r in b], OBSERVED)
    want = panel.with_lifecycle(panel.deduped(rows, ["place"])).select("game_key", "obs_date", "lifecycle_status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["lifecycle_status"] for r in want.collect()} == {"active", "exited_observed", "exited_unobserved"}


def test_lifecycle_games_share_a_key(spark, tmp_path, monkeypatch):
    """Games of one bucket, over three runs, with days that repeat, exits at zero, games that end and come back: the batch labels, and one version a batch."""
    monkeypatch.setattr(lifecycle, "BUCKETS", 2)
    g = random.Random(7)
    rows = sorted((_row(f"g{g.randrange(12)}", g.randrange(30), g.randrange(20), k, float(g.randrange(3))) for k in range(150)), key=lambda r: r[2])
    rows.append(_row(None, 29, 23, 150, 1.0))
    _fed(spark, tmp_path, [rows[:60], rows[60:61], rows[61:]], lifecycle.lifecycle_changes)
    raw = spark.read.schema(lifecycle.LABELS).parquet(f"{tmp_path}/out")
    want = panel.with_lifecycle(panel.deduped(spark.createDataFrame(rows, OBSERVED), ["place"])).select("game_key", "obs_date", "lifecycle_status")
    assert sorted(map(tuple, lifecycle.labels(raw).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert raw.groupBy("game_key", "obs_date", "version").count().filter("count > 1").count() == 0
    changes = lifecycle.lifecycle_changes(spark.readStream.schema(OBSERVED).parquet(f"{tmp_path}/in"))
    assert "bucket" in changes._jdf.queryExecution().analyzed().toString()


def test_superseded_in_any_order(spark, tmp_path):
    """Captures shuffled over four runs, with ties and repeated ones, come to the batch result; compaction keeps it."""
    g = random.Random(5)
    rows = [_row(g.choice("ab"), g.randrange(3), g.randrange(4), k, float(k)) for k in range(60)]
    g.shuffle(rows)
    _fed(spark, tmp_path, [rows[k::4] for k in range(4)], lifecycle.capture_changes)
    frame = spark.createDataFrame(rows, OBSERVED)
    kept = panel.deduped(frame, ["place"]).select("game_key", "obs_date", "capture_url").collect()
    lost = panel.superseded(frame, ["place"]).select("game_key", "obs_date", "superseded_capture_url", "kept_capture_url").collect()

    def same(out):
        assert sorted(map(tuple, out.filter("kind = 'panel'").select("game_key", "obs_date", "capture_url").collect())) == sorted(map(tuple, kept))
        assert sorted(map(tuple, out.filter("kind = 'superseded'").select("game_key", "obs_date", "capture_url", "kept_capture_url").collect())) == sorted(map(tuple, lost))

    same(lifecycle.folded(spark, f"{tmp_path}/out"))
    lifecycle.compacted(spark, f"{tmp_path}/out", f"{tmp_path}/small")
    same(lifecycle.folded(spark, f"{tmp_path}/small"))
    raw = spark.read.schema(lifecycle.CAPTURES).parquet(f"{tmp_path}/out")
    assert raw.filter("sign = -1").count() > 0


def test_superseded_without_python(spark, tmp_path):
    """A capture without a time loses to any other, now or later; no key's state goes through Python."""
    late = lambda place, hour: (*_row("a", 0, hour or 0, place, 1.0)[:2], T0 + dt.timedelta(hours=hour) if hour else None, *_row("a", 0, 0, place, 1.0)[3:])
    _fed(spark, tmp_path, [[late(1, None), late(2, None)], [late(3, 5)], [late(4, None)]], lifecycle.capture_changes)
    out = lifecycle.folded(spark, f"{tmp_path}/out")
    assert sorted((r.kind, r.capture_url, r.kept_capture_url) for r in out.collect()) == [("panel", "u3", None), *(("superseded", f"u{k}", "u3") for k in (1, 2, 4))]
    changes = lifecycle.capture_changes(spark.readStream.schema(OBSERVED).parquet(f"{tmp_path}/in"))
    assert "TransformWithState" not in changes._jdf.queryExecution().analyzed().toString()


def _found(spark, schema, *documents):
    rows = spark.createDataFrame([(k, d if isinstance(d, str | None) else json.dumps(d)) for k, d in enumerate(documents)], "k int, d string")
    return sorted((r["k"], r["path"], r["keyword"]) for r in json_schema.violations(rows, "d", schema).collect())


def test_schema_keywords(spark):
    """Each keyword, kept and broken; rules for one kind say nothing about others."""
    schema = {
        "type": "object",
        "properties": {
            "a": {"type": ["integer", "null"], "minimum": 2, "exclusiveMaximum": 9, "multipleOf": 2}, "b": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^x"},
            "c": {"type": "array", "uniqueItems": True, "minItems": 1, "maxItems": 3, "items": {"enum": [1, "1", None, True, [2]]}}, "d": {"const": {"q": 1}}, "e": {"not": {"type": "string"}},
            "f": {"anyOf": [{"type": "string"}, {"minimum": 5}]}, "g": {"oneOf": [{"minimum": 1}, {"maximum": 3}]}, "h": False, "i": {"allOf": [{"maximum": 4}, {"exclusiveMinimum": 1}]},
            "it's": {"type": "boolean"}, "n": {"$ref": "#/$defs/node"},
        },
        "required": ["a"], "minProperties": 1, "maxProperties": 4, "additionalProperties": {"type": "number"},
        "if": {"required": ["b"]}, "then": {"required": ["c"]}, "else": {"properties": {"e": {"type": "boolean"}}},
        "$defs": {"node": {"type": "object", "properties": {"leaf": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}}, "additionalProperties": False}},
    }
    good = [{"a": 4}, {"a": None}, {"a": 2.0, "b": "xy", "c": [1, "1", None]}, {"a": 8, "c": [True, [2]], "e": False, "zz": 1.5}, {"a": 2, "d": {"q": 1}, "f": "s", "g": 0}, {"a": 2, "it's": True, "n": {"leaf": [[1], []]}}]
    assert _found(spark, schema, *good) == []
    bad = [
        {}, {"a": "4"}, {"a": 9}, {"a": 1}, {"a": 2.5}, {"a": 4, "b": "y"}, {"a": 4, "b": "xxxx", "c": []}, {"a": 4, "c": [1, 1, "q", 2]}, {"a": 4, "d": {"q": 2}}, {"a": 4, "e": "s"}, {"a": 4, "f": 3}, {"a": 4, "g": 2},
        {"a": 4, "h": 1}, {"a": 4, "i": 9}, {"a": 4, "it's": 0}, {"a": 4, "n": {"leaf": [[1], [2, "x"]], "m": 1}}, {"a": 4, "zz": "s"}, {"a": 4, "p": 1, "q": 1, "r": 1, "s": 1}, [1], "{", None,
    ]
    assert _found(spark, schema, *bad) == sorted([
        (0, "$.a", "required"), (0, "$", "minProperties"), (1, "$.a", "type"), (2, "$.a", "exclusiveMaximum"), (2, "$.a", "multipleOf"), (3, "$.a", "minimum"), (3, "$.a", "multipleOf"), (4, "$.a", "type"), (4, "$.a", "multipleOf"),
        (5, "$.b", "minLength"), (5, "$.b", "pattern"), (5, "$.c", "required"), (6, "$.b", "maxLength"), (6, "$.c", "minItems"), (7, "$.c", "uniqueItems"), (7, "$.c", "maxItems"), (7, "$.c[2]", "enum"), (7, "$.c[3]", "enum"), (8, "$.d", "const"), (9, "$.e", "not"), (9, "$.e", "type"),
        (10, "$.f", "anyOf"), (11, "$.g", "oneOf"), (12, "$.h", "false"), (13, "$.i", "maximum"), (14, "$.it's", "type"), (15, "$.n.leaf[1][1]", "type"), (15, "$.n.m", "additionalProperties"), (16, "$.zz", "type"), (17, "$", "maxProperties"), (18, "$", "type"), (19, "$", "json"), (20, "$", "json"),
    ])
    with pytest.raises(ValueError, match="aren't known"):
        _found(spark, {"contains": {}}, {})
    with pytest.raises(ValueError, match="back to itself"):
        _found(spark, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"x": {"$ref": "#/$defs/a"}}}}}, {})
    gate = json_schema.gate(spark.createDataFrame([('{"a":1}',), ('{"a":4}',), ("x",)], "d string"), "d", schema).collect()
    assert [tuple(r) for r in gate] == [(3, 2, 3, False)]


def test_schema_kinds_are_worked_out_once(spark):
    rows = spark.createDataFrame([('{"a":[1,"x"]}',), ('{"b":null}',), ("[]",)], "d string")
    schema = {"type": ["object", "null"], "minProperties": 1, "required": ["a"], "properties": {"a": {"type": ["array", "string"], "minItems": 3, "minLength": 1}}}
    found = json_schema.violations(rows, "d", schema)
    assert sorted((r.path, r.keyword) for r in found.collect()) == [("$", "type"), ("$.a", "minItems"), ("$.a", "required")]
    assert found._jdf.queryExecution().analyzed().toString().count("schema_of_variant(") == 2  # the root and its member


def test_schema_gate_is_one_pass(spark):
    """The gate goes through the documents once; violations of one document are one broken document."""
    rows = spark.createDataFrame([('{"a":1,"b":[]}',), ('{"a":"x","b":[1,"y",null]}',), ("{",), (None,), ("[]",)], "d string")
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["number", "null"]}, "b": {"type": "array", "items": {"enum": ["y", "z", 1]}}}}
    out = json_schema.gate(rows, "d", schema)
    assert [tuple(r) for r in out.collect()] == [(5, 4, 5, False)]
    assert out.columns == ["documents", "broken", "violations", "passed"] and [t for _, t in out.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "Join" not in plan
    assert [tuple(r) for r in json_schema.gate(rows.limit(0), "d", schema).collect()] == [(0, 0, 0, True)]


def test_schema_of_kinds_below(spark):
    """Kinds of objects and arrays that are taken apart, empty ones too, and of members that hold single values alone."""
    schema = {"properties": {k: {"type": t, **more} for k, t, more in (("o", "object", {"minProperties": 0}), ("l", "array", {"maxItems": 9}), ("s", "string", {}), ("b", "boolean", {}), ("n", "null", {}), ("i", "integer", {}), ("x", "object", {}), ("y", "array", {}))}}
    values = {"o": {}, "l": [], "s": "", "b": False, "n": None, "i": 10, "x": {"q": {}}, "y": [[]]}
    assert _found(spark, schema, values, *[{k: values[k]} for k in values]) == []
    for k in values:
        wrong = [v for other, v in values.items() if other != k and {other, k} not in ({"o", "x"}, {"l", "y"})]
        assert _found(spark, schema, *[{k: v} for v in wrong]) == [(n, f"$.{k}", "type") for n in range(len(wrong))]


def test_history_gate(spark):
    """Random days against a fold by day; runs of days that fail, days without games in common."""
    g = random.Random(2)
    days = {}
    for k in range(40):
        level = g.choice([0, 0, 0, 1])
        days[D0 + dt.timedelta(days=k + k // 9)] = {n: round(g.choice([level, 0]) + g.random() / 9, 6) for n in g.sample(range(8), g.randint(0, 8))}
    rows = [(d, n, r) for d, m in days.items() for n, r in m.items()] + [(d, 99, None) for d in days]
    held = last = None
    want = []
    for d, m in sorted(days.items()):
        if held is None:
            held, last = m, d
            want.append((d, None, 0, 0, True))
            continue
        both = [n for n in m if n in held]
        moved = sum(abs(m[n] - held[n]) > 0.2 for n in both)
        ok = not both or moved / len(both) <= 0.3
        want.append((d, last, len(both), moved, ok))
        if ok:
            held, last = m, d
    got = gates.history_gate(spark.createDataFrame(rows, "as_of date, game_no long, ev_ratio double").repartition(3))
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[4] for r in want}) == 2
    assert gates.history_gate(spark.createDataFrame([], "as_of date, game_no long, ev_ratio double")).count() == 0
    assert [tuple(r) for r in gates.history_gate(spark.createDataFrame([(D0, 1, 1.0)], "as_of date, game_no long, ev_ratio double")).collect()] == [(D0, None, 0, 0, True)]


@pytest.mark.parametrize("stretch", ["month", "day"])
def test_as_of(spark, stretch):
    """The last value that was known, over stretches with and without news; nulls and equal times."""
    g = random.Random(8)
    at = lambda k: None if k is None else T0 + dt.timedelta(hours=k)
    left = [(g.choice("abc"), at(g.choice([None, *range(900)])), k) for k in range(300)]
    told = {(g.choice("abd"), g.randrange(900)): k for k in range(40)}
    right = [(key, at(t), k, None if k % 5 == 0 else f"v{k}") for (key, t), k in told.items()] + [("a", None, 7, "never")]
    got = panel.as_of(spark.createDataFrame(left, "game string, t timestamp_ntz, n int"), spark.createDataFrame(right, "game string, known timestamp_ntz, k int, v string"), ["game"], "t", "known", stretch).collect()
    want = []
    for key, t, n in left:
        mine = sorted((s, k, v) for game, s, k, v in right if game == key and s is not None)
        place = bisect.bisect_right([s for s, *_ in mine], t) if t else 0
        want.append((key, t, n, *(mine[place - 1] if place else (None, None, None))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_confirmed_end_is_an_observed_exit(spark):
    rows = [("a", D0, 5.0, D0), ("a", D0 + dt.timedelta(days=1), 5.0, D0 + dt.timedelta(days=2)), ("b", D0, 5.0, None), ("c", D0 + dt.timedelta(days=9), 5.0, D0 + dt.timedelta(days=30))]
    out = panel.with_lifecycle(spark.createDataFrame(rows, "game_key string, obs_date date, percent_unsold double, ends date"), confirmed="ends")
    assert [r["lifecycle_status"] for r in out.orderBy("game_key", F.col("obs_date")).collect()] == ["active", "exited_observed", "exited_unobserved", "active"]
