"""Queries that put rules, lines and grids together: violations, carved channels, finished lines, tables of factors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import noise
from ..operators import corridors, kernels, polyline, spatial, stencil, water
from ..operators.landforms import fill_nearest
from ..sources.tables import RASTER, dealt, polylines, raster, scratch, table, written
from . import layouts, rasters
from .layouts import HOLES, holes
from .populations import SEG

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


# Every rule that a line of play breaks.
_OF = layouts.ORACLES
VIOLATIONS = f"""SELECT tile, line, 'too steep' AS violation FROM ({_OF["corridor_grades"]}) WHERE NOT ok UNION ALL SELECT tile, line, 'through water' FROM ({_OF["corridor_water"]}) WHERE NOT water_ok UNION ALL SELECT tile, line, 'blind start' FROM ({_OF["blind_starts"]}) WHERE blind
UNION ALL SELECT tile, line, 'out of the square' FROM ({_OF["plane_vectors"]}) WHERE NOT in_box UNION ALL SELECT tile, line, 'too close' FROM (SELECT DISTINCT line FROM (SELECT line FROM ({_OF["close_lines"]}) UNION ALL SELECT other FROM ({_OF["close_lines"]}))), (WITH {RASTER} SELECT DISTINCT tile FROM r)"""


def played(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cells, written once for all rules, and the lines, dealt once: a line's samples then stay in its task."""
    cells = written(raster(spark, sf_dir))
    return cells, dealt(holes(spark, sf_dir, cells), "tile", "line")


def violations(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(tile, line, violation): a row for each rule broken."""
    found = lambda rows, broken, what: rows.where(broken).select("tile", "line", F.lit(what).alias("violation"))
    # Which lines have one too close is asked, not which pairs are; lines are the same on all tiles.
    close = corridors.crowded(layouts.on_first(lines), layouts.CELL, layouts.APART).select("line").crossJoin(cells.select("tile").distinct())
    parts = [
        found(layouts.grades_of(cells, lines), "not ok", "too steep"),
        found(layouts.water_of(cells, lines), "not water_ok", "through water"),
        found(corridors.blind(cells, lines, layouts.CELL), "blind", "blind start"),
        found(layouts.vectors_of(lines), "not in_box", "out of the square"),
        close.select("tile", "line", F.lit("too close").alias("violation")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(VIOLATIONS)
def layout_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(*played(spark, sf_dir))


@query(f"WITH {RASTER}, {HOLES}, b AS ({VIOLATIONS}) SELECT h.tile, h.line FROM h ANTI JOIN b ON b.tile = h.tile AND b.line = h.line")
def sound_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break no rule."""
    cells, lines = played(spark, sf_dir)
    return lines.select("tile", "line").join(violations(cells, lines), ["tile", "line"], "left_anti")


# Channels along lines.
@query(f"""WITH {RASTER}, {HOLES}, g AS (SELECT DISTINCT line, ax, ay, bx, b_y FROM h WHERE line % 5 = 1), c AS (SELECT DISTINCT x, y FROM r),
d AS (SELECT c.x, c.y, min(round({layouts._reach("g", "c.x", "c.y")}, 6)) AS distance FROM c, g GROUP BY ALL) SELECT tile, r.x, r.y, round(distance, 6) AS distance, round(z - 2.0 * (1 - power(distance / 1.5, 2)), 6) AS z FROM r JOIN d ON d.x = r.x AND d.y = r.y WHERE distance <= 1.5""")
def carved_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells near every fifth line, cut by a parabola of the distance to the nearest."""
    cells = raster(spark, sf_dir)
    lines = holes(spark, sf_dir).where("line % 5 = 1").select("line", F.lit(1).alias("i"), "ax", "ay", "bx", "by").distinct()
    places = cells.select("x", "y").distinct().select(F.struct("x", "y").alias("cell"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    near = spatial.nearest_segment(places, "cell", lines, reach=1.5).select("cell.x", "cell.y", "distance")
    cut = 2.0 * (1 - F.pow(F.col("distance") / 1.5, 2))
    return cells.join(near, ["x", "y"]).select("tile", "x", "y", "distance", r6(F.col("z") - cut).alias("z"))


# Lines at even spacing, smoothed, falling.
_FINISHED = f"""{SEG}, a0 AS (SELECT line, s, px, py, lead(s) OVER w s1, lead(px) OVER w qx, lead(py) OVER w qy FROM s WINDOW w AS (PARTITION BY line ORDER BY i)), k0 AS (SELECT a0.*, unnest(range(ceil(s / 40.0)::BIGINT, ceil(s1 / 40.0)::BIGINT)) i FROM a0 WHERE s1 > s),
m0 AS (SELECT line, i, px + (i * 40.0 - s) / (s1 - s) * (qx - px) px, py + (i * 40.0 - s) / (s1 - s) * (qy - py) py FROM k0), """ + ", ".join(f"m{k} AS (SELECT line, i, px, CASE WHEN lag(py) OVER w IS NULL OR lead(py) OVER w IS NULL THEN py ELSE (lag(py) OVER w + 2 * py + lead(py) OVER w) / 4 END py FROM m{k - 1} WINDOW w AS (PARTITION BY line ORDER BY i))" for k in range(1, 5))


@query(f"WITH {_FINISHED} SELECT line, i, round(px, 4) AS px, round(py, 4) AS py, round(min(py) OVER (PARTITION BY line ORDER BY i), 4) AS falling FROM m4")
def finished_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = polyline.resample(polylines(spark, sf_dir), 40.0).select("line", F.col("k").alias("i"), "px", "py")
    smooth = polyline.smooth_121(points, 4)
    return smooth.select("line", "i", r4("px").alias("px"), r4("py").alias("py"), r4(F.min("py").over(polyline.along())).alias("falling"))


# Bodies of water by their proportions.
@query(f"""WITH RECURSIVE {rasters.LABELS}, q AS (SELECT tile, root, n, 0.5 * (a + b + 1 / 6.0::DOUBLE) h, (a + 1 / 12.0::DOUBLE) * (b + 1 / 12.0::DOUBLE) - c * c d FROM shape), e AS (SELECT tile, root, n, h + sqrt(greatest(h * h - d, 0)) l1, greatest(h - sqrt(greatest(h * h - d, 0)), 1e-9) l2 FROM q)
SELECT tile, root % 32 AS x, root // 32 AS y, n AS cells, round(sqrt(l1 / l2), 6) AS aspect, round(sqrt(12 * l2) * 6, 6) AS width_m, round(sqrt(12 * l1) * 6, 6) AS length_m, (sqrt(l1 / l2) <= 3.1 OR sqrt(12 * l2) * 6 >= 21.3) AND sqrt(l1 / l2) <= 8.2 AND sqrt(12 * l1) * 6 >= 11.7 AS ok FROM e""")
def body_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body's aspect, width and length as a strip's, and whether these are a lake's; named by its first cell."""
    import numpy as np

    def run(z):
        import pandas as pd

        labels = kernels.label_components(np.nan_to_num(z, nan=-1.0) > 27)
        out = []
        for k in range(1, labels.max() + 1):
            y, x = np.nonzero(labels == k)
            out.append((int(x[0]), int(y[0]), len(y), float(x.var()), float(y.var()), float(np.mean((x - x.mean()) * (y - y.mean())))))
        return pd.DataFrame(out, columns=["x", "y", "cells", "a", "b", "c"])

    found = kernels.per_tile(raster(spark, sf_dir), run, "x int, y int, cells long, a double, b double, c double")
    half = 0.5 * (F.col("a") + F.col("b") + 1 / 6)
    root = F.sqrt(F.greatest(half * half - ((F.col("a") + 1 / 12) * (F.col("b") + 1 / 12) - F.col("c") * F.col("c")), F.lit(0.0)))
    axes = found.withColumn("l1", half + root).withColumn("l2", F.greatest(half - root, F.lit(1e-9)))
    aspect, width, length = F.sqrt(F.col("l1") / F.col("l2")), F.sqrt(12 * F.col("l2")) * 6, F.sqrt(12 * F.col("l1")) * 6
    ok = ((aspect <= 3.1) | (width >= 21.3)) & (aspect <= 8.2) & (length >= 11.7)
    return axes.select("tile", "x", "y", "cells", r6(aspect).alias("aspect"), r6(width).alias("width_m"), r6(length).alias("length_m"), ok.alias("ok"))


@query()
def lake_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins deep and large enough for lakes by tile: their share of the cells, that of all basins, and the five largest."""
    found = kernels.per_tile(raster(spark, sf_dir), lambda z: water.basins(fill_nearest(z), 6.0, 1e-3, 1), "basin int, cells int, depth double, volume double, surface double")
    cells = raster(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("n"))
    fits = (F.col("depth") >= 0.4) & (F.col("cells") >= 3)
    sums = found.groupBy("tile").agg(F.sum(F.when(fits, F.col("cells")).otherwise(0)).alias("q"), F.sum("cells").alias("t"), F.slice(F.sort_array(F.collect_list(F.when(fits, F.col("cells") * 36.0)), asc=False), 1, 5).alias("largest_m2"))
    return cells.join(sums, "tile", "left").select("tile", r6(F.coalesce(F.col("q") / F.col("n"), F.lit(0.0))).alias("fit_share"), r6(F.coalesce(F.col("t") / F.col("n"), F.lit(0.0))).alias("basin_share"), F.coalesce("largest_m2", F.array().cast("array<double>")).alias("largest_m2"))


# Heights with detail.
def _noise_sql(seed: int, scale: float, octaves: int) -> str:
    """(i, j, v) of lattice noise over the places of lat(i, j), as a query."""
    g = rasters._G
    norm = sum(0.5**o for o in range(octaves))
    return f"""(WITH p AS (SELECT i, j, o, ({seed} + o * 2654435769::BIGINT) % 4294967296 AS sd, i * {scale}::DOUBLE * power(2, o) px, j * {scale}::DOUBLE * power(2, o) py, power(0.5, o) amp FROM lat, (SELECT unnest(range({octaves})) o)), q AS (SELECT *, floor(px)::BIGINT x0, floor(py)::BIGINT y0 FROM p),
k0 AS (SELECT q.*, dx, dy, x0 + dx cx, y0 + dy cy FROM q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)), k1 AS (SELECT *, ((xor(sd::BIGINT, 2654435769::BIGINT))::HUGEINT + cx::HUGEINT * 2246822507) % 4294967296 a FROM k0), k2 AS (SELECT *, (xor(a::BIGINT, a::BIGINT >> 15)::HUGEINT + cy::HUGEINT * 3266489909) % 4294967296 b FROM k1),
k3 AS (SELECT *, (xor(b::BIGINT, b::BIGINT >> 13)::HUGEINT * 668265263) % 4294967296 c FROM k2), h AS (SELECT *, xor(c::BIGINT, c::BIGINT >> 16) hash FROM k3), k AS (SELECT *, ({g[0]} * (px - x0 - dx) + {g[1]} * (py - y0 - dy)) v FROM h),
w AS (SELECT i, j, o, any_value(amp) amp, any_value(px - x0) tx, any_value(py - y0) ty, sum(v) FILTER (dx = 0 AND dy = 0) a, sum(v) FILTER (dx = 1 AND dy = 0) b, sum(v) FILTER (dx = 0 AND dy = 1) c, sum(v) FILTER (dx = 1 AND dy = 1) d FROM k GROUP BY i, j, o),
e AS (SELECT *, tx * tx * tx * (tx * (tx * 6.0 - 15.0) + 10.0) eu, ty * ty * ty * (ty * (ty * 6.0 - 15.0) + 10.0) ev FROM w) SELECT i, j, sum(amp * ((a + eu * (b - a)) + ev * ((c + eu * (d - c)) - (a + eu * (b - a))))) * sqrt(2.0::DOUBLE) / {norm} AS v FROM e GROUP BY i, j)"""


_EASE = lambda low, high, x: f"power(least(1.0, greatest(0.0, ({x} - {low}) / {high - low!r})), 2) * (3.0 - 2.0 * least(1.0, greatest(0.0, ({x} - {low}) / {high - low!r})))"
_AT = "SELECT tile, i, j, i * 0.9713::DOUBLE AS px, j * 0.9713::DOUBLE AS py FROM lat, (SELECT DISTINCT tile FROM s)"
_BLENDS = {"zm": "z", "sl": "slope", "lk": "greatest(z - 29, 0) / 10", "wt": "(z > 32)::INT"}


@query(f"""WITH {rasters.SLOPE}, lat AS (SELECT i, j FROM (SELECT unnest(range(32)) i), (SELECT unnest(range(32)) j)), {", ".join(f"c_{n} AS (SELECT tile, x, y, {e} AS z FROM s), {n} AS (SELECT * FROM (WITH p AS ({_AT}), {layouts.blend(f'c_{n}')} SELECT tile, i, j, v FROM v))" for n, e in _BLENDS.items())}, dt AS (SELECT * FROM {_noise_sql(7, 0.37, 2)}), pt AS (SELECT * FROM {_noise_sql(9, 0.11, 1)})
SELECT zm.tile, i::INT AS i, j::INT AS j, round(zm.v + 1.3 * (0.2 + 0.8 * {_EASE(2.0, 9.0, "sl.v")}) * (1 - {_EASE(0.02, 0.10, "lk.v")}) * greatest(1 - wt.v, 0) * greatest(1 + 0.5 * pt.v, 0) * dt.v, 6) AS z FROM zm JOIN sl USING (tile, i, j) JOIN lk USING (tile, i, j) JOIN wt USING (tile, i, j) JOIN dt USING (i, j) JOIN pt USING (i, j)""")
def composed_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended heights at another spacing, with detail on slopes and none on water."""
    cells = stencil.slope(raster(spark, sf_dir)).select("tile", "x", "y", "z", "slope")
    side = F.sequence(F.lit(0), F.lit(31))
    places = cells.select("tile").distinct().withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).withColumn("px", F.col("i") * 0.9713).withColumn("py", F.col("j") * 0.9713)
    out, values = None, {"zm": F.col("z"), "sl": F.col("slope"), "lk": F.greatest(F.col("z") - 29, F.lit(0.0)) / 10, "wt": (F.col("z") > 32).cast("double")}
    for name, value in values.items():
        part = stencil.bilinear(cells.select("tile", "x", "y", value.alias("z")), places).select("tile", "i", "j", F.col("v").alias(name))
        out = part if out is None else out.join(part, ["tile", "i", "j"])
    at = lambda scale, seed, octaves: noise.fbm(F.col("i") * scale, F.col("j") * scale, F.lit(seed), octaves)
    lattice = spark.range(32 * 32).select((F.col("id") % 32).cast("int").alias("i"), F.floor(F.col("id") / 32).cast("int").alias("j"))
    grain = lattice.select("i", "j", at(0.37, 7, 2).alias("dt"), at(0.11, 9, 1).alias("pt"))
    z = noise.composed(*(F.col(c) for c in ("zm", "sl", "lk", "wt", "dt", "pt")), 1.3, 0.2, 0.5, (2.0, 9.0))
    return out.join(grain, ["i", "j"]).select("tile", "i", "j", r6(z).alias("z"))


@query()
def river_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside river by tile: the border cell with the longest way down, and the drained area along it."""
    import numpy as np

    def run(z):
        import pandas as pd

        path, area = water.outside_river(fill_nearest(z), 6.0, 5000.0)
        y, x = np.divmod(path, z.shape[1])
        return pd.DataFrame({"step": np.arange(len(path), dtype=np.int32), "x": x.astype(np.int32), "y": y.astype(np.int32), "area": area.ravel()[path]})

    return kernels.per_tile(raster(spark, sf_dir), run, "step int, x int, y int, area double")


@query()
def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by tile: level, prominent, dry places apart from each other; a second, closer pass where there are few."""
    import numpy as np

    def run(z):
        import pandas as pd

        score = water.site_scores(fill_nearest(z), 6.0, np.nan_to_num(z) > 31)
        sites = water.sites(score, 5.0, 3.0, 24, 16)
        y, x = np.divmod(sites, z.shape[1])
        return pd.DataFrame({"rank": np.arange(1, len(sites) + 1, dtype=np.int32), "x": x.astype(np.int32), "y": y.astype(np.int32), "score": score.ravel()[sites]})

    return kernels.per_tile(raster(spark, sf_dir), run, "rank int, x int, y int, score double")


# Tables of features and factors.
_SIDES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
_STANDARD = "SELECT l_returnflag AS clip, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT l_returnflag, unnest(['l_discount', 'l_quantity', 'l_tax']) AS feature, unnest([l_discount, l_quantity, l_tax]::DOUBLE[]) AS v FROM lineitem) GROUP BY ALL HAVING stddev_pop(v) > 0"


@query(_STANDARD)
def standardisation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations written as one nested JSON object, {clip: {feature: {mean, std}}}, and read again."""
    from .designs import QUERIES as designs

    rows = designs["standardisation_table"](spark, sf_dir)
    inner = rows.groupBy("clip").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.struct("mean", "std"))))).alias("features"))
    # Clips and features are a few dozen names: one object.
    whole = inner.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("clip", F.to_json("features")))))).alias("value"))
    path = f"{scratch(spark)}/standard-{uuid.uuid4().hex}"
    whole.write.text(path)
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("clip", "text"))
    return back.select("clip", F.explode(F.from_json("text", "map<string, struct<mean: double, std: double>>")).alias("feature", "s")).select("clip", "feature", "s.mean", "s.std")


@query("WITH u AS (SELECT l_returnflag = 'R' AS real, unnest([" + ", ".join(f"'{c}'" for c in _SIDES) + "]) AS feature, unnest([" + ", ".join(f"{c}::DOUBLE" for c in _SIDES) + "]) AS v FROM lineitem), s AS (SELECT feature, count(*) FILTER (real AND isfinite(v)) r, count(*) FILTER (NOT real AND isfinite(v)) m, stddev_pop(v) FILTER (real) sr, stddev_pop(v) FILTER (NOT real) sm FROM u GROUP BY feature) SELECT feature, r AS real_n, m AS made_n, r > 0 AND m > 0 AND sr > 1e-9 AND sm > 1e-9 AS usable FROM s")
def usable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are finite on both sides and vary there."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("real"), *(F.col(c).cast("double").alias(c) for c in _SIDES)).unpivot("real", list(_SIDES), "feature", "v")
    fine = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    real, made = F.col("real") & fine, ~F.col("real") & fine
    s = li.groupBy("feature").agg(F.count(F.when(real, 1)).alias("real_n"), F.count(F.when(made, 1)).alias("made_n"), F.stddev_pop(F.when(real, F.col("v"))).alias("sr"), F.stddev_pop(F.when(made, F.col("v"))).alias("sm"))
    return s.select("feature", "real_n", "made_n", ((F.col("real_n") > 0) & (F.col("made_n") > 0) & (F.col("sr") > 1e-9) & (F.col("sm") > 1e-9)).alias("usable"))


@query("""WITH m AS (SELECT l_linenumber AS period, l_returnflag AS gain, avg(l_extendedprice) relief, count(*) n FROM lineitem WHERE NOT (l_linenumber % 3 = 0 AND l_returnflag = 'A') GROUP BY ALL), g AS (SELECT period, gain FROM (SELECT DISTINCT l_linenumber AS period FROM lineitem), (SELECT DISTINCT l_returnflag AS gain FROM lineitem)),
k AS (SELECT g.period, g.gain, relief / first_value(relief) OVER (PARTITION BY g.gain ORDER BY g.period) AS factor, coalesce(n, 0) n FROM g LEFT JOIN m USING (period, gain))
SELECT period, gain, n, round(last_value(factor IGNORE NULLS) OVER (PARTITION BY gain ORDER BY period ROWS UNBOUNDED PRECEDING), 6) AS factor FROM k""")
def factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean relief by period and gain over that of the first period; a cell without runs keeps the factor of the period before."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("period"), F.col("l_returnflag").alias("gain"), "l_extendedprice")
    m = li.where("not (period % 3 = 0 and gain = 'A')").groupBy("period", "gain").agg(F.avg("l_extendedprice").alias("relief"), F.count("*").alias("n"))
    # Both axes are stated lists of a few values.
    grid = li.select("period").distinct().crossJoin(li.select("gain").distinct())
    w = Window.partitionBy("gain").orderBy("period")
    k = grid.join(m, ["period", "gain"], "left").withColumn("factor", F.col("relief") / F.first("relief").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return k.select("period", "gain", F.coalesce("n", F.lit(0)).alias("n"), r6(F.last("factor", ignorenulls=True).over(w)).alias("factor"))


@query("""WITH g AS (SELECT l_linenumber AS a, (l_discount * 100)::INT AS b, l_returnflag AS mode, avg(l_quantity) q, avg(l_tax) t FROM lineitem GROUP BY ALL), o AS (SELECT a, b, sum(abs(q - 25.5) + 20 * abs(t - 0.04)) AS cost FROM g GROUP BY a, b), k AS (SELECT *, row_number() OVER (ORDER BY cost, a, b) AS rank, row_number() OVER (PARTITION BY a ORDER BY cost, b) AS within FROM o)
SELECT a, b, round(cost, 6) AS cost, rank <= 6 AS among_best, within = 1 AS best_of_a FROM k WHERE rank <= 6 OR within = 1""")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs over the whole grid of two settings, modes added up: the six least, and the least of each first setting."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), F.round(F.col("l_discount") * 100).cast("int").alias("b"), F.col("l_returnflag").alias("mode"), "l_quantity", "l_tax")
    g = li.groupBy("a", "b", "mode").agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"))
    costs = g.groupBy("a", "b").agg(F.sum(F.abs(F.col("q") - 25.5) + 20 * F.abs(F.col("t") - 0.04)).alias("cost"))
    # The grid is a stated one, some dozens of settings.
    ranked = costs.withColumn("rank", F.row_number().over(Window.orderBy("cost", "a", "b"))).withColumn("within", F.row_number().over(Window.partitionBy("a").orderBy("cost", "b")))
    return ranked.where("rank <= 6 or within = 1").select("a", "b", r6("cost").alias("cost"), (F.col("rank") <= 6).alias("among_best"), (F.col("within") == 1).alias("best_of_a"))
