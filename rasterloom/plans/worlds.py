"""Queries on drawn worlds: knobs, water, pars and lengths, and a campaign over designs and seeds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sampling
from ..functions.geometry import banded
from ..functions.layouts import EROSION_PERIODS, GAINS, INTENSITIES, KEPT, PERIODS, RELIEF, STRENGTH_RELIEF, STRENGTHS, relief_estimate
from ..functions.noise import bind
from ..operators import features, ranking
from ..sources.tables import dealt, table, written
from .layouts import sql_table1, sql_table2

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def _u(key: str, name: str) -> str:
    return f"(('0x' || substr(md5({key} || ':{name}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _z(key: str, name: str) -> str:
    return "(" + " + ".join(_u(key, f"{name}{i}") for i in range(12)) + " - 6)"


def _step(low: float, high: float, x: str) -> str:
    t = f"least(1.0, greatest(0.0, ({x} - {low!r}) / {high - low!r}))"
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


_L = [math.log(x) for x in (16.0, 30.0, 13.0, 38.0)]
_WATER = f"""w0 AS (SELECT *, ln(relief) lr, 1 - {_step(_L[0], _L[1], "ln(relief)")} low, {_z("key", "cover")} cz FROM s),
w1 AS (SELECT *, {_u("key", "dry")} < 1 / (1 + exp(-(-2.44 + 1.46 * (lr - {math.log(38.0)!r})))) dry, {_u("key", "lake")} < 0.14 * {_step(40.0, 80.0, "relief")} lake, 3.2 - {_step(_L[2], _L[3], "lr")} base FROM w0),
w2 AS (SELECT *, least(greatest(exp(ln(base) + ({math.log(sampling.LOWLAND_COVER)!r} - ln(base)) * low + (0.9 - 0.62 * low) * cz), 0.3 + 11.7 * low), 12.0 + 15.0 * low) drawn FROM w1), w3 AS (SELECT *, CASE WHEN lake THEN 9 + 6 * {_u("key", "lake_cover")} WHEN dry THEN 0.0 ELSE drawn END cover, {_u("key", "river")} ru, {_z("key", "river_size")} rz FROM w2),
w4 AS (SELECT *, cover > 0 AND NOT lake AND ru < 0.01 major, cover > 0 AND NOT lake AND ru >= 0.01 AND ru < 0.18 minor FROM w3)"""


@query(f"""WITH s AS (SELECT p_partkey, p_partkey::VARCHAR AS key, 5 + p_retailprice::DOUBLE / 12 AS relief FROM part), {_WATER}
SELECT p_partkey, round(CASE WHEN major THEN greatest(cover, 5.5) WHEN minor THEN greatest(cover, 4.0) ELSE cover END / 100, 6) AS coverage, lake AS lake_course, round(CASE WHEN major THEN least(3.5e8, greatest(1.0e8, exp({math.log(1.8e8)!r} + 0.5 * rz))) WHEN minor THEN least(8.0e7, greatest(8.0e6, exp({math.log(2.0e7)!r} + 0.8 * rz))) ELSE 0.0 END, 2) AS river_area,
round(least(5.0e6, greatest(2.0e5, exp({math.log(8.0e5)!r} + 0.6 * (-0.4 * cz + 0.9165 * {_z("key", "channel")})))), 2) AS stream_area_min, round(least(2.2, greatest(0.5, exp(0.35 * {_z("key", "runoff")}))), 6) AS runoff, round(4000 + 4000 * {_step(45.0, 85.0, "relief")}, 4) AS min_body_area FROM w4""")
def water_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.water(F.col("p_partkey").cast("string"), 5 + F.col("p_retailprice").cast("double") / 12)
    digits = {"river_area": 2, "stream_area_min": 2, "min_body_area": 4}
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) if n == "lake_course" else F.round(c, digits.get(n, 6)).alias(n) for n, c in drawn.items()))


_ORDER = f"""d AS (SELECT s_suppkey, s_suppkey::VARCHAR AS key, {_u("s_suppkey::VARCHAR", "mix")} u FROM supplier), n AS (SELECT *, CASE {" ".join(f"WHEN u < {sum(w for _, w in sampling.MIXES[: i + 1])!r} THEN {k}" for i, (k, _) in enumerate(sampling.MIXES))} ELSE 4 END threes FROM d),
p AS (SELECT *, list_concat(list_concat(list_transform(range(threes), lambda x: 3), list_transform(range(9 - 2 * threes), lambda x: 4)), list_transform(range(threes), lambda x: 5)) pars FROM n), t AS (SELECT *, unnest(range({sampling.TRIES})) t FROM p),
x AS (SELECT s_suppkey, key, t, unnest(pars) par, generate_subscripts(pars, 1) - 1 i FROM t), o AS (SELECT s_suppkey, key, t, list(par ORDER BY md5(key || ':order' || t || '-' || i)) ord FROM x GROUP BY ALL),
w AS (SELECT *, CASE WHEN ord[1] = 3 THEN {sampling.OPENER_3} ELSE 1.0 END * CASE WHEN ord[9] = 3 THEN {sampling.CLOSER_3} ELSE 1.0 END * list_product(list_transform(range(1, 9), lambda i: CASE WHEN ord[i] = 3 AND ord[i + 1] = 3 THEN {sampling.TWICE_3} WHEN ord[i] = 5 AND ord[i + 1] = 5 THEN {sampling.TWICE_5} ELSE 1.0 END)) wt FROM o),
k AS (SELECT *, ('0x' || substr(md5(key || ':take' || t), 1, 8))::BIGINT / 4294967296.0::DOUBLE < wt taken FROM w), f AS (SELECT s_suppkey, key, ord FROM k QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY taken DESC, CASE WHEN taken THEN 0 ELSE -round(wt, 9) END, t) = 1)"""


def _drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' keys, dealt: their table is one small file, and a key's draws take 640 hashes."""
    return dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


@query(f"WITH {_ORDER} SELECT s_suppkey, array_to_string(ord, '') AS pars FROM f")
def par_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawers(spark, sf_dir).select("s_suppkey", F.array_join(F.transform(sampling.par_order(F.col("s_suppkey").cast("string")), lambda p: p.cast("string")), "").alias("pars"))


def _lengths_sql(par: str, x: str) -> str:
    out = "NULL"
    for p, knots in sampling.LENGTHS.items():
        inner = f"{knots[-1][1]}::DOUBLE"
        for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
            inner = f"CASE WHEN {x} < {x1} THEN {y0}::DOUBLE + ({x} - {x0}) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE ELSE {inner} END"
        out = f"CASE WHEN {par} = {p} THEN {inner} ELSE {out} END"
    return out


@query(f"""WITH {_ORDER}, h AS (SELECT s_suppkey, key, unnest(ord) par, generate_subscripts(ord, 1) - 1 i, list_transform(list_sort(list_transform(range(9), lambda j: md5(key || ':ninth' || j) || ':' || j)), lambda z: split_part(z, ':', 2)::INT) dealt FROM f),
q AS (SELECT *, 0.06 + 0.88 * ((dealt[i + 1] + ('0x' || substr(md5(key || ':share' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / 9.0) u FROM h) SELECT s_suppkey, (i + 1)::INT AS hole, par::INT AS par, round({_lengths_sql("par", "u")}, 4) AS length FROM q""")
def hole_length_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    # Bound, as the optimizer would put the draw of the pars in wherever they are used.
    holes = bind(sampling.par_order(key), lambda pars: F.arrays_zip(pars.alias("pars"), sampling.hole_lengths(key, pars).alias("lengths")))
    both = _drawers(spark, sf_dir).select("s_suppkey", F.posexplode(holes))
    return both.select("s_suppkey", (F.col("pos") + 1).alias("hole"), F.col("col.pars").alias("par"), F.round("col.lengths", 4).alias("length"))


def world_knobs(design: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, the knobs, relief, mode): a design point of design(point, weight, units array) by weight for each seed, jittered, in real units.

    The base period is the shrunk one, and relief the estimate with it.
    """
    cdf = ranking.cumulative(design, "point", "weight").select("point", "low", "high")
    key = F.col("seed").cast("string")
    drawn = ranking.draw(seeds.withColumn("u", sampling.uniform(key, "point")), "u", cdf, "point").join(design.select("point", "units"), "point")
    place = {name: i for i, name in enumerate(sampling.KNOBS)}
    knobs = sampling.decoded(lambda name: F.get("units", F.lit(place[name])) + sampling.JITTER * sampling.normal(key, name))
    wide = drawn.select("seed", "point", *(c.alias(n) for n, c in knobs.items()))
    shaped = ("amplitude", "base_period", "gain", "redistribution", "intensity")
    wide = wide.withColumn("base_period", sampling.shrunk_period(*(F.col(c) for c in shaped)))
    wide = wide.withColumn("relief", relief_estimate(*(F.col(c) for c in shaped)))
    return wide.withColumn("mode", banded(F.col("relief"), 20, 65))


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_nationkey") + 1).alias("weight"), F.array(*(sampling.uniform(key, f"unit{i}") for i in range(len(sampling.KNOBS)))).alias("units"))


def _knob_sql(i: int, name: str) -> str:
    low, high, log, whole = sampling.KNOBS[name]
    u = f"least(1.0, greatest(0.0, {_u('point::VARCHAR', f'unit{i}')} + {sampling.JITTER} * {_z('key', name)}))"
    v = f"{low} * power({high / low!r}::DOUBLE, {u})" if log else f"{low} + ({u}) * {high - low!r}"
    return f"{f'round({v})' if whole else v} AS {name}"


def _relief_sql(period: str) -> str:
    strong = "CASE WHEN redistribution >= 1 THEN redistribution ELSE 1 / greatest(redistribution, 1e-6) END"
    return f"greatest(amplitude * greatest({sql_table2(period, 'gain', PERIODS, GAINS, RELIEF)}, 0.05) * greatest({sql_table1(f'({strong})', STRENGTHS, STRENGTH_RELIEF)}, 0.05) * greatest({sql_table2('intensity', period, INTENSITIES, EROSION_PERIODS, KEPT)}, 0.1), 0)"


@query(f"""WITH c AS (SELECT s_suppkey AS point, (sum(s_nationkey + 1) OVER (ORDER BY s_suppkey) - (s_nationkey + 1)) / (sum(s_nationkey + 1) OVER ())::DOUBLE AS low FROM supplier), e AS (SELECT c_custkey AS seed, c_custkey::VARCHAR AS key, {_u("c_custkey::VARCHAR", "point")} u FROM customer),
d AS (SELECT seed, key, point FROM e ASOF JOIN c ON e.u >= c.low), k AS (SELECT seed, point, {", ".join(_knob_sql(i, n) for i, n in enumerate(sampling.KNOBS))} FROM d), r0 AS (SELECT *, {_relief_sql("base_period")} relief0 FROM k),
r1 AS (SELECT * EXCLUDE (base_period), least(2200.0, greatest(200.0, base_period * (1 - {sampling.SHRINK} * (1 - {_step(_L[0], _L[1], "ln(greatest(relief0, 1.0))")})))) base_period FROM r0), r2 AS (SELECT *, {_relief_sql("base_period")} relief FROM r1)
SELECT seed, point, round(amplitude, 4) AS amplitude, round(base_period, 4) AS base_period, octaves::INT AS octaves, round(gain, 6) AS gain, round(redistribution, 6) AS redistribution, round(intensity, 6) AS intensity, round(ridged_mix, 6) AS ridged_mix, round(relief, 4) AS relief, CASE WHEN relief < 20 THEN 'lowland' WHEN relief < 65 THEN 'rolling' ELSE 'mountain' END AS mode FROM r2""")
def sampled_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = world_knobs(_design(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed")))
    digits = {"amplitude": 4, "base_period": 4, "relief": 4}
    return found.select("seed", "point", *(F.col(c).cast("int").alias(c) if c == "octaves" else F.round(c, digits.get(c, 6)).alias(c) for c in ("amplitude", "base_period", "octaves", "gain", "redistribution", "intensity", "ridged_mix", "relief")), "mode")


@query()
def campaign_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs over seeds, each a generated world, through the feature table; written with the status of each run."""
    from .rasters import heights_of

    # Heights only: the features don't use hardness, and Spark can't leave out a column of a Python kernel.
    worlds = heights_of(spark, sf_dir).select("tile", (F.col("px") / 31.25).cast("int").alias("x"), (F.col("py") / 31.25).cast("int").alias("y"), "z")
    found = features.feature_table(worlds, 31.25)
    status = F.when(F.col("relief_p95_p5").isNull() | F.isnan("relief_p95_p5"), "read_fail").when(F.col("relief_p95_p5") < 0.5, "degenerate_flat").otherwise("ok")
    # Sorted within files: over all of them, the sort's sample would run every world a second time.
    return written(found.withColumn("status", status).sortWithinPartitions("tile")).select("tile", "status", *features.SCALARS)
