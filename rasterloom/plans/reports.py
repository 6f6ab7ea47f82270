"""Queries on scalars, geometry, joins and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import spatial, stencil
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


def r6(c):
    return F.round(c, 6)


@query("SELECT l_orderkey, l_linenumber, least(65535, greatest(0, round(l_extendedprice / 4 * 10, 0)))::BIGINT AS half_away, least(65535, greatest(0, round_even(l_extendedprice / 4 * 10, 0)))::BIGINT AS half_even FROM lineitem")
def quantise_decimetres(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice") / 4 * 10
    clip = lambda c: F.least(F.lit(65535), F.greatest(F.lit(0), c.cast("long")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clip(F.round(v)).alias("half_away"), clip(F.rint(v)).alias("half_even"))


@query("SELECT l_orderkey, l_linenumber, round((l_partkey % 256) * 256 + (l_suppkey % 256) + (l_orderkey % 256) / 256.0 - 32768, 6) AS metres FROM lineitem")
def terrarium_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.col(c) % 256
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(geometry.terrarium(byte("l_partkey"), byte("l_suppkey"), byte("l_orderkey"))).alias("metres"))


_WIDTH = "least(90, greatest(2.5, 0.005 * sqrt(l_tax * 10 * l_extendedprice * 100)))"


@query(f"SELECT l_orderkey, l_linenumber, round({_WIDTH}, 6) AS width, CASE WHEN {_WIDTH} < 4 THEN 'brook' WHEN {_WIDTH} < 8 THEN 'creek' ELSE 'river' END AS class FROM lineitem")
def stream_width_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = geometry.stream_width(F.col("l_tax") * 10, F.col("l_extendedprice") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(width).alias("width"), geometry.stream_class(width).alias("class"))


@query(f"WITH {RASTER}, s AS (SELECT tile, max(z) - min(z) AS relief, quantile_cont(z, 0.98) - quantile_cont(z, 0.02) AS core FROM r GROUP BY tile) SELECT tile, CASE WHEN relief < 30 THEN 'lowland' WHEN relief < 80 THEN 'rolling' ELSE 'mountain' END AS survey_band, CASE WHEN core < 20 THEN 'lowland' WHEN core < 65 THEN 'rolling' ELSE 'mountain' END AS mode_band FROM s")
def relief_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raster(spark, sf_dir).groupBy("tile").agg((F.max("z") - F.min("z")).alias("relief"), F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    return s.select("tile", geometry.banded(F.col("relief"), 30, 80).alias("survey_band"), geometry.banded(F.col("p")[1] - F.col("p")[0], 20, 65).alias("mode_band"))


@query("""SELECT p_partkey, substr(sha1('{"brand": "' || p_brand || '", "size": ' || p_size || '}'), 1, 12) AS hash FROM part""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"brand": "%s", "size": %s}', "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha1(text), 1, 12).alias("hash"))


@query("SELECT l_orderkey, l_linenumber, unnest(['discount', 'tax']) AS knob, round(unnest([l_discount, l_tax]::DOUBLE[]), 6) AS v FROM lineitem")
def knobs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax")).alias("config"))
    return li.select("l_orderkey", "l_linenumber", "config.*").unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "knob", "v").withColumn("v", r6("v"))


@query(f"WITH {SLOPE} SELECT tile, x, y, round(greatest(0, (sin(radians(45.0)) + cos(radians(45.0)) * (sin(radians(315.0)) * -gx + cos(radians(315.0)) * -gy)) / sqrt(1 + gx * gx + gy * gy)), 6) + 0.0 AS shade FROM s")
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stencil.gradient(raster(spark, sf_dir))
    return g.select("tile", "x", "y", (r6(geometry.hillshade(F.col("gx"), F.col("gy"), 315.0, 45.0)) + 0.0).alias("shade"))


_POLYGON = ((3.0, 2.5), (28.0, 6.5), (20.0, 15.5), (29.0, 27.5), (8.0, 24.5))
_CROSSES = " + ".join(f"(({y0} > y) <> ({y1} > y) AND x < {x0} + (y - {y0}) / ({y1 - y0}) * ({x1 - x0}))::INT" for (x0, y0), (x1, y1) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True))


@query(f"WITH {RASTER} SELECT tile, x, y FROM r WHERE ({_CROSSES}) % 2 = 1")
def polygon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).where(geometry.inside_polygon(F.col("x"), F.col("y"), _POLYGON)).select("tile", "x", "y")


@query(f"WITH {LINES}, b AS (SELECT line, min(px) x0, max(px) x1, min(py) y0, max(py) y1 FROM l GROUP BY line), s AS (SELECT *, greatest((x1 - x0) * 1.2, 900) w, greatest((y1 - y0) * 1.2, 900) h FROM b), a AS (SELECT *, greatest(w, h / 2.2) w2, greatest(h, w / 2.2) h2 FROM s) SELECT line, round((x0 + x1 - w2) / 2, 4) AS x0, round((y0 + y1 - h2) / 2, 4) AS y0, round((x0 + x1 + w2) / 2, 4) AS x1, round((y0 + y1 + h2) / 2, 4) AS y1 FROM a")
def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = spatial.padded_box(polylines(spark, sf_dir), "line", pad=0.1, least=900.0, aspect=2.2)
    return box.select("line", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < a + b AND l_quantity > abs(a - b) THEN 180 - degrees(acos((a * a + b * b - l_quantity * l_quantity) / (2 * a * b))) END, 6) AS turn FROM (SELECT *, 20.0::DOUBLE AS a, (10 + l_tax * 100)::DOUBLE AS b FROM lineitem)")
def dogleg_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(geometry.dogleg_turn(F.lit(20.0), 10 + F.col("l_tax") * 100, F.col("l_quantity"))).alias("turn"))


@query("WITH o AS (SELECT l_returnflag, l_extendedprice v, row_number() OVER w - 1 i, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber)) SELECT l_returnflag, round(max(CASE WHEN i = floor((n - 1) * 0.9) THEN v END), 6) AS p90, round(max(CASE WHEN i = n // 2 THEN v END), 6) AS upper_median FROM o GROUP BY 1")
def truncated_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.order_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p90": lambda n: F.floor((n - 1) * F.lit(0.9)), "upper_median": lambda n: F.floor(n / 2)}).select("l_returnflag", r6("p90").alias("p90"), r6("upper_median").alias("upper_median"))


@query(f"WITH {LINES}, g AS (SELECT line, i, CASE WHEN py > 20 THEN py END v FROM l) SELECT line, i::INT AS i, round(last_value(v IGNORE NULLS) OVER (PARTITION BY line ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS v FROM g")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("py") > 20, F.col("py"))
    return polylines(spark, sf_dir).select("line", "i", r6(F.last(v, ignorenulls=True).over(Window.partitionBy("line").orderBy("i"))).alias("v"))


@query(f"""WITH {RASTER}, v AS (SELECT tile, var_pop(z) v FROM r GROUP BY tile), s AS (SELECT a.tile, k, avg(power(a.z - b.z, 2)) g FROM r a, r b, (SELECT unnest([1, 2, 4, 8]) k) WHERE b.tile = a.tile AND ((b.x = a.x + k AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + k)) GROUP BY ALL)
SELECT s.tile, coalesce(min(CASE WHEN g >= v THEN k END), max(k))::INT AS first_lag FROM s JOIN v USING (tile) GROUP BY s.tile""")
def correlation_half_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, lags = raster(spark, sf_dir), (1, 2, 4, 8)
    pairs = stencil.pairs_at(cells, [o for k in lags for o in ((k, 0), (0, k))])
    lag = F.element_at(F.array(*map(F.lit, lags)), (F.floor(F.col("lag") / 2) + 1).cast("int"))
    s = pairs.groupBy("tile", lag.alias("k")).agg(F.avg(F.pow(F.col("a") - F.col("b"), 2)).alias("g"))
    return s.join(cells.groupBy("tile").agg(F.var_pop("z").alias("v")), "tile").groupBy("tile").agg(F.coalesce(F.min(F.when(F.col("g") >= F.col("v"), F.col("k"))), F.max("k")).alias("first_lag"))


@query(f"WITH {RASTER}, s AS (SELECT tile, count(*) n, max(z) - min(z) relief, bool_or(isnan(z)) nans FROM r GROUP BY tile) SELECT tile, CASE WHEN n < 16 THEN 'read_fail' WHEN nans THEN 'nan' WHEN relief < 0.5 THEN 'degenerate_flat' ELSE 'ok' END AS status FROM s")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raster(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("relief"), F.bool_or(F.isnan("z")).alias("nans"))
    return s.select("tile", F.when(F.col("n") < 16, "read_fail").when(F.col("nans"), "nan").when(F.col("relief") < 0.5, "degenerate_flat").otherwise("ok").alias("status"))


_KNOWN = ("GERMANY", "FRANCE", "KENYA", "JAPAN")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY coalesce(list_position(['GERMANY', 'FRANCE', 'KENYA', 'JAPAN'], n_name), 999), n_name)::INT AS place FROM nation")
def known_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, _KNOWN)), F.col("n_name"))
    # The keys are a fixed dimension of some dozens.
    return table(spark, sf_dir, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(999), "n_name")).alias("place"))


@query(f"WITH {LINES} SELECT a.line, a.i::INT AS i, round(sqrt(power(b.px - a.px, 2) + power(b.py - a.py, 2)), 6) AS gap FROM l a JOIN l b ON b.line = a.line AND b.i = a.i + 1")
def consecutive_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("line").orderBy("i")
    ahead = polylines(spark, sf_dir).select("line", "i", r6(F.sqrt(F.pow(F.lead("px").over(w) - F.col("px"), 2) + F.pow(F.lead("py").over(w) - F.col("py"), 2))).alias("gap"))
    return ahead.where("gap is not null")


@query("SELECT r_name AS region, list(n_name ORDER BY n_nationkey DESC)::VARCHAR AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    listed = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")), asc=False)["n_name"]
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("nations"))


@query("""WITH g AS (SELECT l_returnflag AS mode, l_linenumber AS theta, avg(l_quantity) q, avg(l_discount) d FROM lineitem GROUP BY ALL), t AS (SELECT avg(l_quantity) q0, avg(l_discount) d0 FROM lineitem), o AS (SELECT theta, sum(abs(q - q0) + 10 * abs(d - d0)) AS cost FROM g, t GROUP BY theta) SELECT theta, round(cost, 6) AS cost FROM o QUALIFY row_number() OVER (ORDER BY cost, theta) <= 3""")
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_discount")
    aim = li.agg(F.avg("l_quantity").alias("q0"), F.avg("l_discount").alias("d0"))
    g = li.groupBy("l_returnflag", F.col("l_linenumber").alias("theta")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    cost = F.sum(F.abs(F.col("q") - F.col("q0")) + 10 * F.abs(F.col("d") - F.col("d0")))
    return g.join(F.broadcast(aim)).groupBy("theta").agg(cost.alias("cost")).orderBy("cost", "theta").limit(3).select("theta", r6("cost").alias("cost"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.segments(polylines(spark, sf_dir))


_NEAR = f"""{LINES}, s AS (SELECT line, i, px ax, py ay, lead(px) OVER w bx, lead(py) OVER w cy FROM l WINDOW w AS (PARTITION BY line ORDER BY i)), q AS (SELECT *, power(bx - ax, 2) + power(cy - ay, 2) AS d FROM s WHERE bx IS NOT NULL), p AS (SELECT s_suppkey, (s_suppkey % 40) / 10.0::DOUBLE AS px, (s_suppkey % 97)::DOUBLE AS py FROM supplier),
t AS (SELECT s_suppkey, line, i, px, py, ax, ay, bx, cy, CASE WHEN d > 0 THEN greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (cy - ay)) / d)) ELSE 0 END u FROM p, q), m AS (SELECT s_suppkey, line, i, round(sqrt(power(px - (ax + u * (bx - ax)), 2) + power(py - (ay + u * (cy - ay)), 2)), 6) AS distance FROM t)
SELECT s_suppkey, line, i::INT AS i, distance FROM m WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, line, i) = 1"""


@query(f"WITH {_NEAR}")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 40) / 10.0).alias("px"), (F.col("s_suppkey") % 97).cast("double").alias("py"))
    return spatial.nearest_segment(points, "s_suppkey", _segments(spark, sf_dir), reach=2.0)


def _mark(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


@query(f"WITH {SLOPE}, m AS (SELECT tile, (slope < 6)::INT AS play, (z > 30)::INT AS water FROM s) SELECT tile, round(avg(play), 6) AS play_share, round(avg(water), 6) AS water_share, round(sum(play * (1 - water)) / greatest(sum(1 - water), 1)::DOUBLE, 6) AS dry_play_share FROM m GROUP BY tile HAVING avg(water) <= 0.28")
def cover_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stencil.slope(raster(spark, sf_dir)).select("tile", _mark(F.col("slope") < 6).alias("play"), _mark(F.col("z") > 30).alias("water"))
    dry = 1 - F.col("water")
    out = m.groupBy("tile").agg(F.avg("play").alias("p"), F.avg("water").alias("w"), (F.sum(F.col("play") * dry) / F.greatest(F.sum(dry), F.lit(1))).alias("d")).where("w <= 0.28")
    return out.select("tile", r6("p").alias("play_share"), r6("w").alias("water_share"), r6("d").alias("dry_play_share"))
