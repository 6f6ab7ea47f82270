"""Queries on series, polylines and populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import polyline, population, spatial, topk
from ..sources.tables import LINES, SERIES, polylines, table

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


@query(f"""WITH {SERIES}, t AS (SELECT vec_id template_id, i - 16 AS i, v FROM e WHERE vec_id < 8 AND i BETWEEN 16 AND 47), o AS (SELECT unnest(range(0, 33, 4)) AS off),
p AS (SELECT template_id, w.vec_id, off, sum(w.v) sg, sum(w.v * w.v) sgg, sum(w.v * t.v) sgt, sum(t.v) st, sum(t.v * t.v) stt FROM t, o, e w WHERE w.vec_id >= 8 AND w.i = t.i + off GROUP BY ALL),
m AS (SELECT *, greatest((sgg - 2 * sgt + stt) / 32 - power((sg - st) / 32, 2), 0) AS mse FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY template_id, vec_id ORDER BY mse, off) k FROM m),
q AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY mse, vec_id) AS rank FROM b WHERE k = 1)
SELECT template_id, rank::INT AS rank, vec_id, off::INT AS off, round(sqrt(mse), 6) AS rmse FROM q WHERE rank <= 10""")
def match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    templates = vectors.where("vec_id < 8").select(F.col("vec_id").alias("template_id"), F.slice("v", 17, 32).alias("t"))
    best = topk.template_matches(vectors.where("vec_id >= 8"), templates, list(range(0, 33, 4)), 32)
    return topk.top_per_group(best, "template_id", ["mse", "vec_id"], 10).select("template_id", "rank", "vec_id", "off", r6(F.sqrt("mse")).alias("rmse"))


@query("WITH o AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 i, count(*) OVER (PARTITION BY p_brand) n FROM part) SELECT p_brand, p_partkey, p_retailprice FROM o WHERE i IN (round_even(0.0, 0), round_even((n - 1) / 2.0, 0), n - 1)")
def topk_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.spread_picks(table(spark, sf_dir, "part"), "p_brand", ["p_retailprice", "p_partkey"], 3).select("p_brand", "p_partkey", "p_retailprice")


@query("WITH s AS (SELECT l_returnflag, avg(l_quantity) m, stddev_pop(l_quantity) s FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) + 0.0 AS zscore FROM lineitem JOIN s USING (l_returnflag)")
def zscore_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.standardise(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select("l_orderkey", "l_linenumber", (r6("zscore") + 0.0).alias("zscore"))


@query("""WITH a AS (SELECT l_returnflag g, l_extendedprice v FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_returnflag g, l_extendedprice v FROM lineitem WHERE l_linenumber > 1), s AS (SELECT g, quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi FROM a GROUP BY g)
SELECT g AS l_returnflag, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, round(avg((v BETWEEN lo AND hi)::INT), 6) AS share FROM b JOIN s USING (g) GROUP BY g""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice")
    return population.reachability(li.where("l_linenumber = 1"), li.where("l_linenumber > 1"), "l_returnflag", "l_extendedprice").select("l_returnflag", r6("lo").alias("lo"), r6("hi").alias("hi"), r6("share").alias("share"))


WEIGHTS = """r AS (SELECT o_custkey AS key, avg(o_totalprice) r FROM orders GROUP BY 1), p AS (SELECT key, sqrt(r) w FROM r), c AS (SELECT key, least(w, (SELECT quantile_cont(w, 0.98) FROM p)) w FROM p), n AS (SELECT key, w / (SELECT sum(w) FROM c) w FROM c)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.avg("o_totalprice").alias("r"))
    return population.tempered_weights(ratio)


@query(f"WITH {WEIGHTS} SELECT key, round(w, 9) AS w FROM n")
def density_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("key", F.round("w", 9).alias("w"))


@query(f"WITH {WEIGHTS} SELECT count(*) AS n, round(1 / sum(w * w), 4) AS ess FROM n")
def effective_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).agg(F.count("*").alias("n"), F.round(1 / F.sum(F.col("w") * F.col("w")), 4).alias("ess"))


@query("""WITH u AS (SELECT l_returnflag g, l_extendedprice v, (l_linenumber = 1)::INT a FROM lineitem), d AS (SELECT g, v, sum(a) na, sum(1 - a) nb FROM u GROUP BY g, v),
c AS (SELECT g, abs(sum(na) OVER (PARTITION BY g ORDER BY v) / sum(na) OVER (PARTITION BY g) - sum(nb) OVER (PARTITION BY g ORDER BY v) / sum(nb) OVER (PARTITION BY g)) q FROM d) SELECT g AS l_returnflag, round(max(q), 6) AS ks FROM c GROUP BY g""")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice")
    return population.ks_two_sample(li.where("l_linenumber = 1"), li.where("l_linenumber > 1"), "l_returnflag", "l_extendedprice").select("l_returnflag", r6("ks").alias("ks"))


@query("""WITH a AS (SELECT c_acctbal v FROM customer), b AS (SELECT s_acctbal v FROM supplier)
SELECT round(2 * (SELECT avg(abs(a.v - b.v)) FROM a, b) - (SELECT avg(abs(x.v - y.v)) FROM a x, a y) - (SELECT avg(abs(x.v - y.v)) FROM b x, b y), 4) AS energy""")
def energy_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"))
    return population.energy_distance(a, b, "v").select(F.round("energy", 4).alias("energy"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("quantity_price"), r6(F.corr("l_quantity", "l_discount")).alias("quantity_discount"), r6(F.corr("l_discount", "l_tax")).alias("discount_tax"))


@query("""WITH e AS (SELECT [quantile_cont(c_acctbal, i) FOR i IN [0.25, 0.5, 0.75]] q FROM customer GROUP BY ALL), q AS (SELECT quantile_cont(c_acctbal, 0.25) q1, quantile_cont(c_acctbal, 0.5) q2, quantile_cont(c_acctbal, 0.75) q3 FROM customer),
b AS (SELECT s_suppkey, (s_acctbal >= q1)::INT + (s_acctbal >= q2)::INT + (s_acctbal >= q3)::INT AS bin FROM supplier, q), n AS (SELECT bin, count(*) n, least(5.0, greatest(0.2, power(0.25 / (count(*) / (SELECT count(*) FROM b)::DOUBLE), 0.5))) r FROM b GROUP BY bin)
SELECT s_suppkey, bin, round(r / (SELECT sum(n * r) FROM n), 9) AS w FROM b JOIN n USING (bin)""".replace("e AS (SELECT [quantile_cont(c_acctbal, i) FOR i IN [0.25, 0.5, 0.75]] q FROM customer GROUP BY ALL), ", ""))
def quantile_bin_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"))
    fitted = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"))
    return population.quantile_bin_ratio(target, fitted, "v", 4, 0.5).select("s_suppkey", "bin", F.round("w", 9).alias("w"))


_CURVE = [(0.0, 0.0), (10.0, 4.0), (25.0, 5.0), (40.0, 12.0), (50.0, 13.0)]


def _curve_sql(x: str) -> str:
    out = "13.0::DOUBLE"
    for (x0, y0), (x1, y1) in reversed(list(zip(_CURVE, _CURVE[1:], strict=False))):
        out = f"CASE WHEN {x} < {x1} THEN {y0}::DOUBLE + ({x} - {x0}) * {(y1 - y0) / (x1 - x0)}::DOUBLE ELSE {out} END"
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE {out} END"


@query(f"SELECT l_orderkey, l_linenumber, round({_curve_sql('l_quantity')}, 6) AS v FROM lineitem")
def table_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(scalars.piecewise(F.col("l_quantity"), _CURVE)).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(0.5 * power(40.0, l_discount * 10), 6) AS log_knob, round(round(2 + l_tax * 10 * 6), 6) AS whole_knob, round((l_quantity - 1) / 49.0, 6) AS unit FROM lineitem")
def theta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(scalars.from_unit(F.col("l_discount") * 10, 0.5, 20.0, log=True)).alias("log_knob"), r6(F.round(2 + F.col("l_tax") * 10 * 6)).alias("whole_knob"), r6(scalars.to_unit(F.col("l_quantity"), 1.0, 50.0)).alias("unit"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity >= 40 THEN 1 ELSE power((l_quantity - 10) / 30.0, 2) * (3 - 2 * (l_quantity - 10) / 30.0) END, 6) AS eased, round(greatest(0, least(1, l_quantity / 40.0)), 6) AS clamped FROM lineitem")
def easing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(scalars.smoothstep(10.0, 40.0, q)).alias("eased"), r6(scalars.clamp(q / 40.0)).alias("clamped"))


@query("SELECT s_suppkey, round((s_acctbal / 1000 + 100) * 111320.0 * cos(radians(50.0)), 4) AS east, round((s_acctbal / 500 - 50) * 111320.0, 4) AS north, round((s_acctbal / 1000 + 180) / 360 * 1024, 6) AS tile_x, round((1 - ln(tan(radians(s_acctbal / 500)) + 1 / cos(radians(s_acctbal / 500))) / pi()) / 2 * 1024, 6) AS tile_y FROM supplier")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("s_acctbal") / 500, F.col("s_acctbal") / 1000
    east, north = scalars.local_metres(lat, lon, 50.0, -100.0)
    x, y = scalars.tile_fraction(lat, lon, 10)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"), r6(x).alias("tile_x"), r6(y).alias("tile_y"))


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN (" + ", ".join(f"'{s}'" for s in (*scalars.STOP, "")) + ")))"


@query(f"""WITH a AS (SELECT p_partkey, {_TOKENS.format("p_name")} ta FROM part), b AS (SELECT p_brand AS brand, {_TOKENS.format("min(p_name)")} tb FROM part GROUP BY 1),
c AS (SELECT p_partkey, brand, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE, 6) AS score FROM a, b WHERE len(ta) > 0 AND len(tb) > 0)
SELECT * FROM c WHERE score >= 0.34 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, brand) = 1""")
def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the brands' first names for each part, if it is like enough."""
    part = table(spark, sf_dir, "part")
    a = part.select("p_partkey", scalars.name_tokens(F.col("p_name")).alias("ta"))
    b = part.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_name").alias("n")).select("brand", scalars.name_tokens(F.col("n")).alias("tb"))
    return population.best_names(a, "p_partkey", "ta", b, "brand", "tb", 0.34).select("p_partkey", "brand", r6("score").alias("score"))


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum, max(json_extract(props, '$.k')::BIGINT) AS k_max FROM events GROUP BY 1")
def json_props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def exclude_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(out, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING avg((s_acctbal > 0)::INT) >= 0.5)")
def usable_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.avg((F.col("s_acctbal") > 0).cast("double")).alias("share")).where("share >= 0.5")
    return table(spark, sf_dir, "customer").join(usable, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT n_nationkey, round(avg(c_acctbal), 6) AS mean_balance, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def left_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("k"))
    return table(spark, sf_dir, "nation").join(per, "n_nationkey", "left").select("n_nationkey", r6("m").alias("mean_balance"), F.coalesce("k", F.lit(0)).alias("customers"))


@query("""WITH a AS (SELECT c_nationkey k, max(c_acctbal) v FROM customer WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT s_nationkey k, max(s_acctbal) v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS nationkey, round(coalesce(a.v, b.v), 6) AS v FROM a FULL JOIN b ON a.k = b.k""")
def prioritised_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.max("c_acctbal").alias("a"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.max("s_acctbal").alias("b"))
    return a.join(b, "nationkey", "full_outer").select("nationkey", r6(F.coalesce("a", "b")).alias("v"))


@query("SELECT 'customer' AS side, c_nationkey AS nationkey, round(c_acctbal, 6) AS v FROM customer UNION ALL SELECT 'supplier', s_nationkey, round(s_acctbal, 6) FROM supplier")
def union_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nationkey"), r6("c_acctbal").alias("v"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nationkey"), r6("s_acctbal").alias("v")))


@query("""WITH s AS (SELECT avg((l_discount <= 0.10)::INT) d, quantile_cont(l_quantity, 0.5) q, count(*) FILTER (l_quantity < 0) bad FROM lineitem)
SELECT 'discount_share' AS gate, round(d, 6) AS value, d >= 0.95 AS pass FROM s UNION ALL SELECT 'quantity_p50', round(q, 6), q <= 30 FROM s UNION ALL SELECT 'violations', bad, bad = 0 FROM s""")
def gates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    (median,) = population.quantiles(li, "l_quantity", [0.5])
    s = li.agg(F.avg((F.col("l_discount") <= 0.10).cast("double")).alias("d"), F.lit(median).alias("q"), F.count(F.when(F.col("l_quantity") < 0, 1)).alias("bad"))
    gates = F.array(*(F.struct(F.lit(n).alias("gate"), r6(F.col(c).cast("double")).alias("value"), ok.alias("pass")) for n, c, ok in (("discount_share", "d", F.col("d") >= 0.95), ("quantity_p50", "q", F.col("q") <= 30), ("violations", "bad", F.col("bad") == 0))))
    return s.select(F.inline(gates))


@query("SELECT l_orderkey AS id, 'ship before order' AS violation FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT l_orderkey, 'discount over 8 %' FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT o_orderkey, 'order without lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def verify_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    named = lambda df, c, what: df.select(F.col(c).alias("id"), F.lit(what).alias("violation"))
    early = li.join(o, li.l_orderkey == o.o_orderkey).where("l_shipdate < o_orderdate")
    alone = o.join(li, li.l_orderkey == o.o_orderkey, "left_anti")
    return named(early, "l_orderkey", "ship before order").unionAll(named(li.where("l_discount > 0.08"), "l_orderkey", "discount over 8 %")).unionAll(named(alone, "o_orderkey", "order without lines"))


# Polylines.
SEG = f"{LINES}, g AS (SELECT *, coalesce(sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)), 0) seg FROM l WINDOW w AS (PARTITION BY line ORDER BY i)), s AS (SELECT *, sum(seg) OVER (PARTITION BY line ORDER BY i) s FROM g)"


@query(f"WITH {SEG} SELECT line, count(*) AS vertices, round(sum(seg), 4) AS length FROM s GROUP BY line")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.arc_lengths(polylines(spark, sf_dir)).groupBy("line").agg(F.count("*").alias("vertices"), F.round(F.sum("seg"), 4).alias("length"))


@query(f"""WITH {SEG}, a AS (SELECT line, s, px, py, lead(s) OVER w s1, lead(px) OVER w qx, lead(py) OVER w qy FROM s WINDOW w AS (PARTITION BY line ORDER BY i)), k AS (SELECT a.*, unnest(range(ceil(s / 50.0)::BIGINT, ceil(s1 / 50.0)::BIGINT)) k FROM a WHERE s1 > s)
SELECT line, k, round(px + (k * 50.0 - s) / (s1 - s) * (qx - px), 4) AS px, round(py + (k * 50.0 - s) / (s1 - s) * (qy - py), 4) AS py FROM k""")
def resample_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.resample(polylines(spark, sf_dir), 50.0).select("line", "k", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query(f"WITH {LINES}, n AS (SELECT *, lag(py) OVER w a, lead(py) OVER w b FROM l WINDOW w AS (PARTITION BY line ORDER BY i)) SELECT line, i::INT AS i, round(CASE WHEN a IS NULL OR b IS NULL THEN py ELSE (a + 2 * py + b) / 4 END, 6) AS py FROM n")
def smooth_121(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.smooth_121(polylines(spark, sf_dir)).select("line", "i", r6("py").alias("py"))


@query(f"WITH {LINES} SELECT line, i::INT AS i, round(min(py) OVER (PARTITION BY line ORDER BY i), 6) AS lowest FROM l")
def running_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polylines(spark, sf_dir).select("line", "i", r6(F.min("py").over(polyline.along())).alias("lowest"))


@query(f"WITH {LINES}, d AS (SELECT line, py - lag(py) OVER (PARTITION BY line ORDER BY i) d FROM l) SELECT line, round(sum(greatest(d, 0)), 4) AS climb, round(sum(greatest(-d, 0)), 4) AS descent FROM d WHERE d IS NOT NULL GROUP BY line")
def climb_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = polylines(spark, sf_dir).select("line", (F.col("py") - F.lag("py").over(polyline.along())).alias("d")).where("d is not null")
    return d.groupBy("line").agg(F.round(F.sum(F.greatest("d", F.lit(0.0))), 4).alias("climb"), F.round(F.sum(F.greatest(-F.col("d"), F.lit(0.0))), 4).alias("descent"))


@query(f"WITH {LINES}, h AS (SELECT line, i, (py > 50)::INT h FROM l), g AS (SELECT *, sum(1 - h) OVER (PARTITION BY line ORDER BY i) g FROM h), r AS (SELECT line, g, sum(h) n FROM g GROUP BY ALL) SELECT line, max(n)::BIGINT AS longest FROM r GROUP BY line")
def islands_max_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.longest_run(polylines(spark, sf_dir), F.col("py") > 50)


@query("WITH o AS (SELECT user_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) r FROM events) SELECT user_id, bool_or(coalesce(r, FALSE)) AS repeats, count(*) FILTER (r) AS times FROM o GROUP BY user_id")
def adjacent_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    again = F.col("event_type") == F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("user_id", again.alias("r"))
    return e.groupBy("user_id").agg(F.bool_or(F.coalesce("r", F.lit(False))).alias("repeats"), F.count(F.when(F.col("r"), 1)).alias("times"))


@query(f"WITH RECURSIVE {LINES}, f AS (SELECT line, i, py AS e FROM l WHERE i = 1 UNION ALL SELECT l.line, l.i, 0.6 * l.py + 0.4 * f.e FROM f JOIN l ON l.line = f.line AND l.i = f.i + 1) SELECT line, i::INT AS i, round(e, 6) AS e FROM f")
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.ema(polylines(spark, sf_dir)).select("line", "i", r6("e").alias("e"))


@query(f"""WITH {LINES}, s AS (SELECT line, i, px ax, py ay, lead(px) OVER w bx, lead(py) OVER w b_y FROM l WINDOW w AS (PARTITION BY line ORDER BY i)), q AS (SELECT * FROM s WHERE bx IS NOT NULL),
c AS (SELECT a.line, a.i, b.i j, ((a.bx - a.ax) * (b.ay - a.ay) - (a.b_y - a.ay) * (b.ax - a.ax)) * ((a.bx - a.ax) * (b.b_y - a.ay) - (a.b_y - a.ay) * (b.bx - a.ax)) u, ((b.bx - b.ax) * (a.ay - b.ay) - (b.b_y - b.ay) * (a.ax - b.ax)) * ((b.bx - b.ax) * (a.b_y - b.ay) - (b.b_y - b.ay) * (a.bx - b.ax)) v FROM q a JOIN q b ON b.line = a.line AND b.i > a.i)
SELECT line, count(*) FILTER (u < 0 AND v < 0) AS crossings FROM c GROUP BY line""")
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spatial.segments(polylines(spark, sf_dir))
    crossed = spatial.crossings(lines, cell=16.0).groupBy("line").agg(F.count("*").alias("crossings"))
    return lines.select("line").distinct().join(crossed, "line", "left").select("line", F.coalesce("crossings", F.lit(0)).alias("crossings"))
