"""The distributed-lag study: window pairs, lag bins, rank correlation, weighted slope, permutation test."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from ..shipping import ship

#: Fixed lag bins in days; (45, 90] and (90, 150] are the study's own, the outer ones hold the rest.
BINS = ((0, 45), (45, 90), (90, 150), (150, 400))
#: Stretches of the values that ranks are counted in.
STRETCHES = 256
#: Counts of a histogram that a quantile is found by.
BUCKETS = 256
#: Fixed value: offsets of the permutation test are worked out modulo this prime, in whole numbers of 64 bits.
MODULUS = 2_147_483_647


def demeaned(windows: DataFrame) -> DataFrame:
    w = Window.partitionBy("game_key")
    return windows.filter("u_start > 0").withColumns({"s": F.col("s") - F.avg("s").over(w), "d": F.col("d") - F.avg("d").over(w)})


def pairs(windows: DataFrame, most: float | None = None) -> DataFrame:
    """All ordered disjoint pairs of a game's windows: A ends before B starts; with `most` only lags up to it.

    With `most`, windows meet in stretches of that many days, so a long lifecycle isn't joined with itself as a whole.
    """
    mid = lambda a, b: F.unix_date(a) + F.date_diff(b, a) / 2
    base = windows.withColumn("mid", mid("w_start", "w_end"))
    a = base.select("game_key", F.col("w_start").alias("a_start"), F.col("w_end").alias("a_end"), F.col("s"), F.col("mid").alias("a_mid"), "u_max")
    b = base.select("game_key", F.col("w_start").alias("b_start"), F.col("d"), F.col("mid").alias("b_mid"))
    keys = ["game_key"]
    if most is not None:
        at = lambda c: F.floor(F.col(c) / most)
        a, b, keys = a.withColumn("stretch", F.explode(F.array(at("a_mid"), at("a_mid") + 1))), b.withColumn("stretch", at("b_mid")), ["game_key", "stretch"]
    out = a.join(b, keys).filter("b_start >= a_end").withColumn("lag", F.col("b_mid") - F.col("a_mid"))
    return out if most is None else out.filter(F.col("lag") <= most).drop("stretch")


def binned(pairs_: DataFrame, bins=BINS) -> DataFrame:
    out = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(bins))):
        out = F.when((F.col("lag") > lo) & (F.col("lag") <= hi), k).otherwise(out)
    return pairs_.withColumn("bin", out).filter("bin is not null")


def value_ranks(counts: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """keys, column, `name`: the rank of each distinct value within keys, ties at their mean, less the mean of all ranks.

    counts: keys, column, n. The distinct values are dealt in stretches between quantiles, whose totals give the ranks
    before each, so no key's values are sorted in one task. Nulls come first.
    """
    steps = [k / STRETCHES for k in range(1, STRETCHES)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(column, steps).alias("cuts"))
    each = counts.groupBy(*keys, column).agg(F.sum("n").alias("n")).join(F.broadcast(cuts), keys)  # a row a key
    each = each.withColumn("stretch", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col(column)))).drop("cuts")
    totals = each.groupBy(*keys, "stretch").agg(F.sum("n").alias("total"))
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("total").over(key.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.join(totals.select(*keys, "stretch", before.alias("before"), F.sum("total").over(key).alias("all")), [*keys, "stretch"])
    within = F.sum("n").over(Window.partitionBy(*keys, "stretch").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("before") + within - (F.col("n") - 1) / 2 - (F.col("all") + 1) / 2
    return placed.select(*keys, column, rank.alias(name))


def _ranked(counts: DataFrame, ranks: DataFrame, column: str, keys: list[str]) -> DataFrame:
    of = ranks.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, column)], ranks.columns[-1])
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*keys, column)]
    return counts.join(of, same).drop(*[f"of_{c}" for c in (*keys, column)])


def spearman(binned_: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n_pairs, rho. Pairs of values are counted first; ranks are those of the distinct values, joined to the counts."""
    keys = keys or ["bin"]
    counts = cut(binned_.groupBy(*keys, "s", "d").agg(F.count("*").alias("n")))
    both = _ranked(_ranked(counts, value_ranks(counts, "s", keys, "rs"), "s", keys), value_ranks(counts, "d", keys, "rd"), "d", keys)
    return _rho(both, keys).select(*keys, "n_pairs", "rho")


def _rho(ranked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n_pairs, xx, rho from counted pairs (n) with their ranks (rs, rd)."""
    n, x, y = F.col("n"), F.col("rs"), F.col("rd")
    sums = ranked.groupBy(*(keys or ["bin"])).agg(F.sum(n).alias("n_pairs"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    return sums.withColumn("rho", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))).drop("xy", "yy")


def quantile(rows: DataFrame, key: str, column: str, q: float, times: str) -> DataFrame:
    """key, value: the q-quantile of `column` by key, each row counted `times` times, between two values in proportion.

    The two are found by histograms: a pass counts the values of a key in BUCKETS of the range that holds the wanted one,
    and goes on with that bucket's least and greatest value until they are the same. So a pass holds a few hundred counts
    a key, and the passes depend on how close the values lie, not on their number. Nulls and NaN don't count. The driver holds two ranges a key.
    """
    rows = cut(rows.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(key).alias("key"), F.col(column).cast("double").alias("x"), F.col(times).alias("n")))
    spark, kind = rows.sparkSession, "key int, low boolean, rank long, lo double, hi double"
    kind = kind.replace("key int", f"key {dict(rows.dtypes)['key']}")
    ends = rows.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n")).collect()
    at = {r["key"]: (r["n"] - 1) * q for r in ends}
    open_ = [(r["key"], low, int(at[r["key"]]) + 1 if low else min(r["n"], int(at[r["key"]]) + 2), r["lo"], r["hi"]) for r in ends for low in (True, False)]
    found: dict = {}
    while open_:
        found |= {(k, low): lo for k, low, _, lo, hi in open_ if lo == hi}
        open_ = [r for r in open_ if r[3] != r[4]]
        if not open_:
            break
        wanted = spark.createDataFrame(open_, kind).withColumnRenamed("key", "of")
        # halves first: the difference of two doubles can be too large for one
        place = F.floor(F.try_divide(F.col("x") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS)
        # the ends are apart in any case, so every pass gets further
        bucket = F.when(F.col("x") == F.col("hi"), BUCKETS - 1).when(F.col("x") == F.col("lo"), 0).otherwise(F.coalesce(F.greatest(F.lit(0), F.least(place, F.lit(BUCKETS - 1))), F.lit(0)))
        inside = rows.join(F.broadcast(wanted), (F.col("key") == F.col("of")) & F.col("x").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy("key", "low", "rank", bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("key", "low").orderBy("bucket"))
        chosen = counts.withColumn("upto", upto).filter("upto >= rank and upto - n < rank")
        open_ = [(r["key"], r["low"], r["rank"] - (r["upto"] - r["n"]), r["lo"], r["hi"]) for r in chosen.collect()]
    values = [(k, found[k, True] + (found[k, False] - found[k, True]) * (p - int(p))) for k, p in at.items()]
    return spark.createDataFrame(values, f"{key} {dict(rows.dtypes)['key']}, value double")


def weighted_slope(binned_: DataFrame) -> DataFrame:
    """Slope of d on s, weighted by the game's greatest unclaimed money, capped at its 90th percentile."""
    games = binned_.groupBy("bin", "u_max").agg(F.count("*").alias("n"))
    cap = quantile(games, "bin", "u_max", 0.9, "n").withColumnRenamed("value", "cap")
    out = binned_.join(F.broadcast(cap), "bin").withColumn("w", F.least("u_max", "cap"))  # a row a bin
    w, s, d = F.col("w"), F.col("s"), F.col("d")
    sums = out.groupBy("bin").agg(F.sum(w).alias("sw"), F.sum(w * s).alias("ws"), F.sum(w * d).alias("wd"), F.sum(w * s * d).alias("wsd"), F.sum(w * s * s).alias("wss"))
    return sums.withColumn("slope", F.try_divide(F.col("wsd") - F.try_divide(F.col("ws") * F.col("wd"), F.col("sw")), F.col("wss") - F.try_divide(F.col("ws") * F.col("ws"), F.col("sw"))))


def seeds(game_key):
    """A whole number under MODULUS for each game."""
    return F.conv(F.substring(F.md5(game_key.cast("string")), 1, 8), 16, 10).cast("long") % MODULUS


def offsets(seed: np.ndarray, n: np.ndarray, rep: int) -> np.ndarray:
    """By how many windows a game's responses are shifted in a repetition: 1 to n - 1, or 0 if there is one window."""
    x = (seed + 7919 * (rep + 1)) % MODULUS
    x = (x * x + rep) % MODULUS
    x = (x * x + seed) % MODULUS
    return np.where(n > 1, 1 + x % np.maximum(n - 1, 1), 0)


def permutation(windows: DataFrame, reps: int = 1000, least: int = 30, bins=BINS) -> DataFrame:
    """Family-wise p of each bin: the share of repetitions whose greatest |rho| reaches the bin's.

    In each repetition every game's responses are shifted in a circle by offsets(). A pair's first rank never moves, so
    pairs are summed up by bin and response window once. A window's response then takes over, in each repetition, what
    the window has that its value comes from, so a window's row has the sums of all its game's windows. The rows are
    dealt in ranges of their responses and sorted; a task goes through its range once, a batch at a time, and gives for each
    repetition its number of pairs and the products with ranks counted from the range's start, to which what lies before is
    added later. It holds one batch and a few numbers for each repetition, and equal responses lie in one range.
    """
    spark = windows.sparkSession
    ship(spark)
    w = Window.partitionBy("game_key")
    own = windows.withColumns({"k": F.row_number().over(w.orderBy("w_start")) - 1, "n": F.count("*").over(w)})
    real = cut(binned(pairs(windows, bins[-1][1]), bins).groupBy("bin", "game_key", "b_start", "s", "d").agg(F.count("*").alias("n")))
    counts = real.groupBy("bin", "s", "d").agg(F.sum("n").alias("n"))
    ranks = value_ranks(counts, "s", ["bin"], "rs")
    rho = cut(_rho(_ranked(_ranked(counts, ranks, "s", ["bin"]), value_ranks(counts, "d", ["bin"], "rd"), "d", ["bin"])).filter(F.col("n_pairs") >= least))
    kept = {r["bin"]: (r["n_pairs"], r["xx"]) for r in rho.collect()}  # a row a bin
    names = sorted(kept)
    place = own.select("game_key", F.col("w_start").alias("b_start"), "k")
    sums = _ranked(real, ranks, "s", ["bin"]).filter(F.col("bin").isin(names)).join(place, ["game_key", "b_start"])
    sums = sums.groupBy("game_key", "bin", "k").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("rs")).alias("x"))
    at_bin = lambda c, name: F.coalesce(F.max(F.when(F.col("bin") == name, F.col(c))), F.lit(0))
    wide = sums.groupBy("game_key", "k").agg(F.count("*").alias("rows"), *[at_bin("m", name).cast("int").alias(f"m{b}") for b, name in enumerate(names)], *[at_bin("x", name).cast("double").alias(f"x{b}") for b, name in enumerate(names)])
    low = F.coalesce(F.col("d"), F.lit(float("-inf"))) + 0.0  # nulls rank first; no negative zero
    fields = [f"{c}{b}" for c in "mx" for b in range(len(names))]
    filled = own.select("game_key", F.col("k").cast("int").alias("k"), low.alias("d")).join(wide, ["game_key", "k"], "left").fillna(0, [*fields, "rows"])
    games = cut(filled.groupBy("game_key").agg(F.sort_array(F.collect_list(F.struct("k", "d", *fields))).alias("w"), F.sum("rows").alias("rows")).filter("rows > 0"))
    flat = lambda c, kind: F.concat(*[F.col(f"w.{c}{b}") for b in range(len(names))]) if names else F.array().cast(f"array<{kind}>")
    whole = games.select(seeds(F.col("game_key")).alias("seed"), F.size("w").cast("long").alias("n"), flat("m", "int").alias("m"), flat("x", "double").alias("x"), F.posexplode("w.d").alias("k", "d"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = max(1, len(names))
    pairs_of = np.array([float(kept[name][0]) for name in names])

    def passed(batches):
        before, open_, start = np.zeros((reps, len(names))), None, None  # pairs before the open value, which may go on in the next batch
        own_x, products, squares = (np.zeros((reps, len(names))) for _ in range(3))
        held = np.zeros((reps, 2 * len(names)))

        def close(r, of):
            """Take up values, each with all its pairs, in ascending order."""
            c, x = of[..., : len(names)], of[..., len(names) :]
            upto = np.cumsum(c, axis=-2)
            own_x[r] += x.sum(axis=-2)
            products[r] += (x * (before[r][..., None, :] + upto - (c - 1) / 2)).sum(axis=-2)
            squares[r] += (c * (pairs_of - c) * (pairs_of + c)).sum(axis=-2)
            before[r] += upto[..., -1, :]

        for batch in batches:
            if not batch.num_rows:
                continue
            seed, n, k, d = (batch.column(c).to_numpy() for c in ("seed", "n", "k", "d"))
            k, at = k.astype(np.int64), np.cumsum(n) - n
            # a row for each window and each window of its game: pairs and sums by bin
            each, of = np.arange(n.sum()), np.repeat(np.arange(len(n)), n)
            place = (each + (width - 1) * at[of])[:, None] + n[of][:, None] * np.arange(len(names))
            sources = np.concatenate([batch.column(c).flatten().to_numpy()[place].astype(np.float64) for c in ("m", "x")], axis=1)
            new = (d[1:] != d[:-1]) & ~(np.isnan(d[1:]) & np.isnan(d[:-1]))
            first = np.flatnonzero(np.r_[True, new])
            start = d[0] if start is None else start
            if open_ is not None and not (d[0] == open_ or np.isnan(d[0]) and np.isnan(open_)):
                close(slice(None), held[:, None, :])
                held[:] = 0
            open_ = d[-1]
            for r in range(reps):
                back = k - offsets(seed, n, r)
                back += np.where(back < 0, n, 0)
                found = np.take(sources, at + back, axis=0)
                if len(first) < len(d):
                    found = np.add.reduceat(found, first, axis=0)
                found[0] += held[r]
                held[r] = found[-1]
                if len(found) > 1:
                    close(r, found[:-1])
        if open_ is not None:
            close(slice(None), held[:, None, :])
            columns = [np.full(reps * len(names), start), np.arange(reps * len(names), dtype=np.int32), *(a.ravel() for a in (before, own_x, products, squares))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["start", "place", "c", "x", "xy", "yy"])

    dealt = whole.repartitionByRange(ranges, "d").sortWithinPartitions("d")
    totals = dealt.mapInArrow(passed, "start double, place int, c double, x double, xy double, yy double")
    before = F.coalesce(F.sum("c").over(Window.partitionBy("place").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    known = spark.createDataFrame([(b, float(kept[name][0]), float(kept[name][1])) for b, name in enumerate(names)], "of int, pairs double, xx double")
    parts = totals.withColumns({"before": before, "of": F.col("place") % width}).join(F.broadcast(known), "of")
    # ranks less their mean; the squares of N ranks of which c are tied come to a twelfth of the sum of c (N - c) (N + c)
    product = F.col("xy") + (F.col("before") - (F.col("pairs") + 1) / 2) * F.col("x")
    parts = parts.groupBy("place", "xx").agg(F.sum(product).alias("xy"), (F.sum("yy") / 12).alias("yy"))
    each = parts.select(F.floor(F.col("place") / width).alias("r"), F.abs(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))).alias("v"))
    tops = each.groupBy("r").agg(F.max("v").alias("top"))
    # the slack is for sums in another order; it can only raise p
    return rho.select("bin", "n_pairs", "rho").crossJoin(F.broadcast(tops)).groupBy("bin", "n_pairs", "rho").agg(F.avg((F.col("top") >= F.abs("rho") - 1e-9).cast("double")).alias("p"))


def interval_coverage(rows: DataFrame) -> DataFrame:
    """One row: the share of `actual` within the 80 % and 95 % intervals, in percent, and whether both are calibrated."""
    out = rows.agg(*[(F.avg(F.col("actual").between(F.col(f"lo{p}"), F.col(f"hi{p}")).cast("double")) * 100).alias(f"within{p}") for p in (80, 95)])
    return out.withColumn("calibrated", F.col("within80").between(70, 90) & F.col("within95").between(90, 100))
