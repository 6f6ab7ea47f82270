"""Report folds over layouts and terrain: statistics by par, nines, gates, checks by mode, half-lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import banded
from ..operators import stencil
from ..sources.tables import LINES, RASTER, polylines, raster, table
from .rasters import SLOPE

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r4(c):
    return F.round(c, 4)


def r6(c):
    return F.round(c, 6)


# Holes of a round: a line's first 18 vertices, with a par from the value there and the length to the next.
ROUND = f"{LINES}, a AS (SELECT line, i::INT AS ref, 3 + floor(py)::BIGINT % 3 AS par, sqrt(power(lead(px) OVER w - px, 2) + power(lead(py) OVER w - py, 2)) len, py FROM l WINDOW w AS (PARTITION BY line ORDER BY i)), f AS (SELECT * FROM a WHERE ref <= 18 AND len IS NOT NULL)"


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("line").orderBy("i")
    away = F.sqrt(F.pow(F.lead("px").over(w) - F.col("px"), 2) + F.pow(F.lead("py").over(w) - F.col("py"), 2))
    return polylines(spark, sf_dir).select("line", F.col("i").alias("ref"), (3 + F.floor("py") % 3).alias("par"), away.alias("len"), "py").where("ref <= 18 and len is not null")


@query(f"WITH {ROUND} SELECT par, count(*) AS holes, round(avg(len), 4) AS mean_length, round(quantile_cont(len, 0.1), 4) AS p10, round(quantile_cont(len, 0.5), 4) AS p50, round(quantile_cont(len, 0.9), 4) AS p90 FROM f GROUP BY par")
def lengths_by_par(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Three pars, 18 lengths a line: exact percentiles over distinct lengths, combined by task first.
    p = F.percentile("len", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = rounds(spark, sf_dir).groupBy("par").agg(F.count("*").alias("holes"), r4(F.avg("len")).alias("mean_length"), p.alias("p"))
    return found.select("par", "holes", "mean_length", *(r4(F.col("p")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


NINES = f"""{ROUND}, n AS (SELECT line, CASE WHEN ref <= 9 THEN 1 ELSE 10 END AS base, list(par ORDER BY ref) AS pars, sum(len) AS total FROM f GROUP BY ALL HAVING count(*) = 9)"""


def nines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, base, pars, total): the full front and back nines."""
    base = F.when(F.col("ref") <= 9, 1).otherwise(10)
    found = rounds(spark, sf_dir).groupBy("line", base.alias("base")).agg(F.sort_array(F.collect_list(F.struct("ref", "par"))).alias("a"), F.sum("len").alias("total"), F.count("*").alias("n"))
    return found.where("n = 9").select("line", "base", F.col("a.par").alias("pars"), "total")


@query(f"""WITH {NINES}, c AS (SELECT len(list_filter(pars, lambda p: p = 3)) n3, len(list_filter(pars, lambda p: p = 4)) n4, len(list_filter(pars, lambda p: p = 5)) n5 FROM n)
SELECT n3::INT AS n3, n4::INT AS n4, n5::INT AS n5, count(*) AS nines, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY ALL""")
def par_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = lambda k: F.size(F.filter("pars", lambda p: p == k)).alias(f"n{k}")
    found = nines(spark, sf_dir).groupBy(*map(times, (3, 4, 5))).agg(F.count("*").alias("nines"))
    whole = found.agg(F.sum("nines").alias("whole"))
    # 55 mixes of nine pars, and one row of their sum.
    return found.join(F.broadcast(whole)).select("n3", "n4", "n5", "nines", r6(F.col("nines") / F.col("whole")).alias("share"))


_PAIR = lambda k: f"list_bool_or(list_transform(range(1, 9), lambda i: pars[i] = {k} AND pars[i + 1] = {k}))"
_GATES = (("par_36", 0.02, 0.6), ("opener_3", 0.0, 0.5), ("opener_5", 0.0, 0.5), ("closer_3", 0.0, 0.5), ("back_to_back_3", 0.0, 0.7), ("back_to_back_5", 0.0, 0.7))


@query(f"""WITH {NINES}, s AS (SELECT avg((list_sum(pars) = 36)::INT) par_36, avg((pars[1] = 3)::INT) opener_3, avg((pars[1] = 5)::INT) opener_5, avg((pars[9] = 3)::INT) closer_3, avg({_PAIR(3)}::INT) back_to_back_3, avg({_PAIR(5)}::INT) back_to_back_5 FROM n)
""" + " UNION ALL ".join(f"SELECT '{g}' AS gate, round({g}, 6) AS value, coalesce({g} BETWEEN {lo} AND {hi}, FALSE) AS pass FROM s" for g, lo, hi in _GATES))
def routing_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    par = lambda i: F.col("pars")[i]
    twice = lambda k: F.exists(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.get("pars", i) == k) & (F.get("pars", i + 1) == k))
    total = F.aggregate("pars", F.lit(0).cast("bigint"), lambda a, p: a + p)
    holds = {"par_36": total == 36, "opener_3": par(0) == 3, "opener_5": par(0) == 5, "closer_3": par(8) == 3, "back_to_back_3": twice(3), "back_to_back_5": twice(5)}
    s = nines(spark, sf_dir).agg(*(F.avg(c.cast("double")).alias(n) for n, c in holds.items()))
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), r6(g).alias("value"), F.coalesce(F.col(g).between(lo, hi), F.lit(False)).alias("pass")) for g, lo, hi in _GATES))
    return s.select(F.inline(rows))



# Ratios of what came out to what was asked, by mode.
_CHECK = "c AS (SELECT o_orderpriority AS mode, o_totalprice / 150000.0::DOUBLE AS ratio FROM orders)"


@query(f"""WITH {_CHECK}, s AS (SELECT coalesce(mode, 'ALL') AS mode, count(*) n, avg(ratio) m, avg(ratio * ratio) q FROM c GROUP BY GROUPING SETS ((mode), ())) SELECT mode, n, round(m, 6) AS mean, round(sqrt(greatest(q - m * m, 0)), 6) AS sd FROM s""")
def ratio_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mode"), (F.col("o_totalprice") / 150000.0).alias("ratio"))
    s = c.rollup("mode").agg(F.count("*").alias("n"), F.avg("ratio").alias("m"), F.avg(F.col("ratio") * F.col("ratio")).alias("q"))
    return s.select(F.coalesce("mode", F.lit("ALL")).alias("mode"), "n", r6("m").alias("mean"), r6(F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))).alias("sd"))


@query("""SELECT l_linestatus AS mode, count(*) AS n, round(sum(l_quantity), 4) AS cover, count(*) FILTER (l_discount = 0) AS dry, count(*) FILTER (l_quantity > 45) AS large, round(min(l_extendedprice), 4) AS least, round(quantile_cont(abs(l_discount - l_tax), 0.5), 6) AS error_p50, round(quantile_cont(abs(l_discount - l_tax), 0.9), 6) AS error_p90 FROM lineitem GROUP BY 1""")
def water_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums, least values and pooled quantiles by mode in one pass."""
    error = F.abs(F.col("l_discount") - F.col("l_tax"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("mode")).agg(F.count("*").alias("n"), r4(F.sum("l_quantity")).alias("cover"), F.count(F.when(F.col("l_discount") == 0, 1)).alias("dry"), F.count(F.when(F.col("l_quantity") > 45, 1)).alias("large"), r4(F.min("l_extendedprice")).alias("least"), F.percentile(error, F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    return found.select("mode", "n", "cover", "dry", "large", "least", r6(F.col("p")[0]).alias("error_p50"), r6(F.col("p")[1]).alias("error_p90"))


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of features, over the rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]]
    wide = table(spark, sf_dir, "lineitem").agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col(f"`{a}|{b}`")).alias("r")) for a, b in pairs))
    return wide.select(F.inline(rows))


# Half-lengths by the structure function.
HALF_LAGS = (1, 2, 3, 4, 6, 8, 11, 16, 22, 32, 45, 64, 90)
_HALF = f"""{RASTER}, t AS (SELECT tile, var_pop(z) v FROM r GROUP BY tile), s AS (SELECT a.tile, k, avg(power(b.z - a.z, 2)) d FROM r a, r b, (SELECT unnest({[k for k in HALF_LAGS if k < 32]}) k) WHERE b.tile = a.tile AND ((b.x = a.x + k AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + k)) GROUP BY ALL),
o AS (SELECT s.tile, k, d, v, lag(k) OVER w k0, lag(d) OVER w d0 FROM s JOIN t USING (tile) WINDOW w AS (PARTITION BY s.tile ORDER BY k)), f AS (SELECT * FROM o WHERE v > 0 AND d >= v QUALIFY row_number() OVER (PARTITION BY tile ORDER BY k) = 1),
half AS (SELECT tile, CASE WHEN k0 IS NULL THEN 6.0 * k ELSE 6.0 * k0 * power(k / k0::DOUBLE, least(1, greatest(0, (v - d0) / greatest(d - d0, 1e-12)))) END AS half_length FROM f)"""


def half_lengths(cells: DataFrame, cell: float, side: int) -> DataFrame:
    """(tile, half_length): where the mean squared difference first reaches the variance, between lags by their logarithms."""
    lags = [k for k in HALF_LAGS if k < side]
    pairs = stencil.pairs_at(cells, [o for k in lags for o in ((k, 0), (0, k))])
    lag = F.element_at(F.array(*map(F.lit, lags)), (F.floor(F.col("lag") / 2) + 1).cast("int"))
    s = pairs.groupBy("tile", lag.alias("k")).agg(F.avg(F.pow(F.col("b") - F.col("a"), 2)).alias("d")).join(cells.groupBy("tile").agg(F.var_pop("z").alias("v")), "tile")
    w = Window.partitionBy("tile").orderBy("k")
    o = s.withColumn("k0", F.lag("k").over(w)).withColumn("d0", F.lag("d").over(w)).where("v > 0 and d >= v")
    first = o.groupBy("tile").agg(F.min(F.struct("k", "d", "v", "k0", "d0")).alias("f")).select("tile", "f.*")
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - F.col("d0")) / F.greatest(F.col("d") - F.col("d0"), F.lit(1e-12))))
    return first.select("tile", F.when(F.col("k0").isNull(), cell * F.col("k")).otherwise(cell * F.col("k0") * F.pow(F.col("k") / F.col("k0"), u)).alias("half_length"))


@query(f"WITH {_HALF} SELECT tile, round(half_length, 4) AS half_length FROM half")
def half_length_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return half_lengths(raster(spark, sf_dir), 6.0, 32).select("tile", r4("half_length").alias("half_length"))


@query(f"""WITH {SLOPE}, a AS (SELECT tile, max(z) - min(z) relief, quantile_cont(z, 0.98) - quantile_cont(z, 0.02) core, avg(slope) mean_slope, avg((slope < 6)::INT) play FROM s GROUP BY tile)
SELECT tile, CASE WHEN relief < 30 THEN 'lowland' WHEN relief < 80 THEN 'rolling' ELSE 'mountain' END AS band, round(relief, 6) AS relief, round(core, 6) AS relief_p2_p98, round(mean_slope, 6) AS mean_slope, round(play, 6) AS play_share FROM a""")
def survey_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stencil.slope(raster(spark, sf_dir))
    a = s.groupBy("tile").agg((F.max("z") - F.min("z")).alias("relief"), F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("p"), F.avg("slope").alias("m"), F.avg((F.col("slope") < 6).cast("double")).alias("play"))
    return a.select("tile", banded(F.col("relief"), 30, 80).alias("band"), r6("relief").alias("relief"), r6(F.col("p")[1] - F.col("p")[0]).alias("relief_p2_p98"), r6("m").alias("mean_slope"), r6("play").alias("play_share"))


_BUILD = (("length_price_corr", "corr(l_quantity, l_extendedprice)", 0.5, 1.0), ("discount_tax_corr", "corr(l_discount, l_tax)", -0.2, 0.2), ("mean_quantity", "avg(l_quantity)", 20.0, 30.0), ("sd_discount", "stddev_pop(l_discount)", 0.0, 0.05), ("taxed_share", "avg((l_tax > l_discount)::INT)", 0.0, 0.8), ("rounds_per_line", "count(*) / count(DISTINCT l_orderkey)::DOUBLE", 1.0, 8.0))


@query("WITH s AS (SELECT " + ", ".join(f"{e} AS {g}" for g, e, _, _ in _BUILD) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{g}' AS gate, round({g}, 6) AS value, {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, {g} BETWEEN {lo} AND {hi} AS pass FROM s" for g, _, lo, hi in _BUILD))
def build_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # Distinct orders by a partial count; the other sums in the same pass over the lines.
    orders = li.groupBy("l_orderkey").agg(F.count("*").alias("k")).agg((F.sum("k") / F.count("*")).alias("rounds_per_line"))
    s = li.agg(F.corr("l_quantity", "l_extendedprice").alias("length_price_corr"), F.corr("l_discount", "l_tax").alias("discount_tax_corr"), F.avg("l_quantity").alias("mean_quantity"), F.stddev_pop("l_discount").alias("sd_discount"), F.avg((F.col("l_tax") > F.col("l_discount")).cast("double")).alias("taxed_share"))
    both = s.join(F.broadcast(orders))
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), r6(F.col(g).cast("double")).alias("value"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.col(g).between(lo, hi).alias("pass")) for g, _, lo, hi in _BUILD))
    return both.select(F.inline(rows))
