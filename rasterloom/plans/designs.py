"""Queries on designs, draws, fitted models and sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import models, ranking
from ..sources.tables import table

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


@query("WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR)) AS rank, count(*) OVER () AS n FROM customer) SELECT c_custkey, rank <= floor(0.3 * n) AS held_out FROM n")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.hash_order(table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey").cast("string"))
    return rows.select("c_custkey", (F.col("rank") <= F.floor(0.3 * F.col("n"))).alias("held_out"))


@query("""WITH k AS (SELECT s_suppkey, dim, s_suppkey::VARCHAR || ':' || dim AS key FROM supplier, (SELECT unnest(range(4)) AS dim)), n AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY md5(key)) AS rank, count(*) OVER (PARTITION BY dim) AS n FROM k)
SELECT s_suppkey, dim::INT AS dim, round((rank - 1 + ('0x' || substr(md5('u' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / n, 9) AS u FROM n""")
def latin_hypercube(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("dim"))
    key = F.concat_ws(":", F.col("s_suppkey").cast("string"), F.col("dim").cast("string"))
    rows = ranking.hash_order(points.withColumn("key", key), F.col("key"), ["dim"])
    return rows.select("s_suppkey", "dim", F.round((F.col("rank") - 1 + ranking.hash_unit(F.concat(F.lit("u"), "key"))) / F.col("n"), 9).alias("u"))


def _sobol_sql(dim: int) -> str:
    out = "0::BIGINT"
    for k, v in enumerate(ranking.direction_numbers(dim)):
        out = f"xor({out}, CASE WHEN (n >> {k}) & 1 = 1 THEN {v}::BIGINT ELSE 0::BIGINT END)"
    return out


@query("WITH p AS (SELECT p_partkey - 1 AS n FROM part) SELECT n + 1 AS p_partkey, " + ", ".join(f"round(({_sobol_sql(d)}) / 4294967296.0::DOUBLE, 9) AS u{d}" for d in range(5)) + " FROM p")
def sobol_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of the Sobol sequence for each part."""
    n = F.col("p_partkey") - 1
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(ranking.sobol(n, d), 9).alias(f"u{d}") for d in range(5)))


_CDF = "c AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) / (sum(p_size) OVER ())::DOUBLE AS high, (sum(p_size) OVER (ORDER BY p_partkey) - p_size) / (sum(p_size) OVER ())::DOUBLE AS low FROM part)"


@query(f"WITH {_CDF} SELECT p_partkey, round(high, 9) AS share FROM c")
def weighted_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cumulative(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "p_size").select("p_partkey", F.round("high", 9).alias("share"))


@query(f"WITH {_CDF}, d AS (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders) SELECT o_orderkey, p_partkey FROM d ASOF JOIN c ON d.u >= c.low")
def inverse_cdf_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdf = ranking.cumulative(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "p_size").select("p_partkey", "low", "high")
    draws = table(spark, sf_dir, "orders").select("o_orderkey", ranking.hash_unit(F.col("o_orderkey").cast("string")).alias("u"))
    return ranking.draw(draws, "u", cdf, "p_partkey").select("o_orderkey", "p_partkey")


@query("""WITH u AS (SELECT o_orderkey, sum(('0x' || substr(md5(o_orderkey || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS s FROM orders, (SELECT unnest(range(12)) AS k) GROUP BY 1) SELECT o_orderkey, round(s - 6, 6) AS normal FROM u""")
def irwin_hall_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    total = sum((ranking.hash_unit(F.concat(key, F.lit(f":{k}"))) for k in range(1, 12)), ranking.hash_unit(F.concat(key, F.lit(":0"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(total - 6).alias("normal"))


_E = [f"embedding[{i}]::DOUBLE" for i in range(1, 7)]


def _response(a, b, c) -> str:
    return f"({a} + 2 * {b} * {b} + 0.5 * {a} * {c})"


@query(f"""WITH f AS (SELECT {_response(*_E[:3])} AS fa, {_response(_E[3], _E[1], _E[2])} AS f0, {_response(_E[0], _E[4], _E[2])} AS f1, {_response(_E[0], _E[1], _E[5])} AS f2 FROM embeddings), v AS (SELECT var_pop(fa) v, avg(power(fa - f0, 2)) a, avg(power(fa - f1, 2)) b, avg(power(fa - f2, 2)) c FROM f)
SELECT 'x0' AS knob, round(a / (2 * v), 6) AS total_effect FROM v UNION ALL SELECT 'x1', round(b / (2 * v), 6) FROM v UNION ALL SELECT 'x2', round(c / (2 * v), 6) FROM v""")
def sobol_total_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(*(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(6)))
    f = lambda a, b, c: F.col(a) + 2 * F.col(b) * F.col(b) + 0.5 * F.col(a) * F.col(c)
    runs = e.select(f("e0", "e1", "e2").alias("base"), f("e3", "e1", "e2").alias("x0"), f("e0", "e4", "e2").alias("x1"), f("e0", "e1", "e5").alias("x2"))
    return models.total_effects(runs, "base", ["x0", "x1", "x2"]).select("knob", r6("total_effect").alias("total_effect"))


@query("""WITH c AS (SELECT l_returnflag AS metric, unnest(['l_discount', 'l_tax', 'l_quantity', 'l_linenumber']) AS knob, unnest([abs(corr(l_extendedprice, l_discount)), abs(corr(l_extendedprice, l_tax)), abs(corr(l_extendedprice, l_quantity)), abs(corr(l_extendedprice, l_linenumber))]) AS effect FROM lineitem GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY effect DESC, knob) AS rank FROM c) SELECT metric, rank::INT AS rank, knob, round(effect, 6) AS effect, CASE WHEN knob IN ('l_quantity', 'l_tax') THEN 'HIT' ELSE 'SURPRISE' END AS verdict FROM o WHERE rank <= 3""")
def intent_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    knobs = ("l_discount", "l_tax", "l_quantity", "l_linenumber")
    effects = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(*(F.abs(F.corr("l_extendedprice", k)).alias(k) for k in knobs))
    long = effects.unpivot("metric", list(knobs), "knob", "effect")
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("effect"), "knob"))).where("rank <= 3")
    return ranked.select("metric", "rank", "knob", r6("effect").alias("effect"), F.when(F.col("knob").isin("l_quantity", "l_tax"), "HIT").otherwise("SURPRISE").alias("verdict"))


@query("SELECT l_returnflag AS clip, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT l_returnflag, unnest(['l_discount', 'l_quantity', 'l_tax']) AS feature, unnest([l_discount, l_quantity, l_tax]::DOUBLE[]) AS v FROM lineitem) GROUP BY ALL HAVING stddev_pop(v) > 0")
def standardisation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ["l_discount", "l_quantity", "l_tax"]
    long = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("clip"), *(F.col(c).cast("double").alias(c) for c in features)).unpivot("clip", features, "feature", "v")
    # NaN is missing here, and a feature without spread has no score.
    kept = long.groupBy("clip", "feature").agg(F.avg(F.nanvl("v", F.lit(None))).alias("mean"), F.stddev_pop(F.nanvl("v", F.lit(None))).alias("std")).where("std > 0")
    return kept.select("clip", "feature", r6("mean").alias("mean"), r6("std").alias("std"))


# Fitted models: rows only; tests hold them against NumPy or planted structure.
def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Vectors as columns m0, m1, ..., all of them."""
    vectors = table(spark, sf_dir, "embeddings")
    names = [f"m{i}" for i in range(len(vectors.select("embedding").first()[0]))]
    return vectors.select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names))), names


@query()
def pca_scree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.principal_components(*_features(spark, sf_dir))


@query()
def hull_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of some vectors within the hull of the others, on their first two components."""
    rows, names = _features(spark, sf_dir)
    return models.hull_coverage(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), names)


@query()
def ward_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of the nations by their customers' balances and counts, and their suppliers'."""
    side = lambda t, p: table(spark, sf_dir, t).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.avg(f"{p}_acctbal").alias(f"{p}_mean"), F.count("*").cast("double").alias(f"{p}_n"))
    both = side("customer", "c").join(side("supplier", "s"), "nation")
    return models.ward(both, "nation", ["c_mean", "c_n", "s_mean", "s_n"])


@query()
def mixture_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures on the first eight components, with their silhouettes."""
    scores = models.component_scores(*_features(spark, sf_dir), "vec_id", 8)
    return models.mixture_bic(scores, [f"pc{i}" for i in range(8)], range(1, 4), starts=3)


@query()
def density_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _features(spark, sf_dir)
    real, synthetic = rows.where("vec_id % 5 = 0"), rows.where("vec_id % 5 <> 0")
    return models.density_ratio(real, synthetic, names, "vec_id")


@query()
def emulator_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _features(spark, sf_dir)
    rows = rows.withColumn("y", F.col("m0") + 2 * F.col("m1") * F.col("m1"))
    return models.emulator_r2(rows, names, "y", "vec_id", folds=3)
