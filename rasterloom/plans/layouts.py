"""Queries on lines of play, their bends and rules, and on the lookups behind a world's knobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layouts, scalars
from ..functions.geometry import banded
from ..operators import corridors, stencil
from ..sources.tables import RASTER, raster, table
from .rasters import SLOPE

QUERIES: dict = {}
ORACLES: dict = {}
#: Metres a cell of the raster is here, and how near lines are too close.
CELL, APART = 60.0, 45.0


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def r4(c):
    return F.round(c, 4)


# Lines of play: a start and an end on every tile for each supplier.
HOLES = """h AS (SELECT tile, s_suppkey AS line, (s_suppkey * 7 % 61) / 2.0::DOUBLE ax, (s_suppkey * 11 % 59) / 2.0::DOUBLE ay, (s_suppkey * 13 % 62) / 2.0::DOUBLE bx, (s_suppkey * 17 % 57) / 2.0::DOUBLE b_y FROM supplier, (SELECT DISTINCT tile FROM r)),
hl AS (SELECT *, 60.0::DOUBLE * sqrt(power(bx - ax, 2) + power(b_y - ay, 2)) len FROM h)"""


def holes(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    part = lambda by, of: (F.col("s_suppkey") * by % of) / 2.0
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line"), part(7, 61).alias("ax"), part(11, 59).alias("ay"), part(13, 62).alias("bx"), part(17, 57).alias("by"))
    # Every line lies on every tile.
    return (cells or raster(spark, sf_dir)).select("tile").distinct().crossJoin(lines)


def samples(step: float) -> str:
    return f"""hn AS (SELECT *, greatest(ceil(len / {step}), 1)::INT n FROM hl), hk AS (SELECT *, unnest(range(n + 1)) k FROM hn),
p AS (SELECT tile, line, len, n, k, (k / n::DOUBLE) * len AS s, ax + (bx - ax) * (k / n::DOUBLE) px, ay + (b_y - ay) * (k / n::DOUBLE) py FROM hk)"""


def blend(cells: str, value: str = "z", points: str = "p") -> str:
    """v: the blend of the four cells around each of points(tile, px, py, ...), held within 0 to 31."""
    corner = lambda name, x, y: f"LEFT JOIN {cells} {name} ON {name}.tile = k0.tile AND {name}.x = {x} AND {name}.y = {y}"
    return f"""q0 AS (SELECT *, least(greatest(px, 0), 31) hx, least(greatest(py, 0), 31) hy FROM {points}), k0 AS (SELECT *, floor(hx)::INT x0, floor(hy)::INT y0, least(floor(hx) + 1, 31)::INT x1, least(floor(hy) + 1, 31)::INT y1 FROM q0),
b0 AS (SELECT k0.*, ca.{value} za, cb.{value} zb, cc.{value} zc, cd.{value} zd FROM k0 {corner("ca", "x0", "y0")} {corner("cb", "x1", "y0")} {corner("cc", "x0", "y1")} {corner("cd", "x1", "y1")}),
v AS (SELECT *, (za + (hx - x0) * (zb - za)) + (hy - y0) * ((zc + (hx - x0) * (zd - zc)) - (za + (hx - x0) * (zb - za))) AS v FROM b0)"""


@query(f"WITH {SLOPE}, {HOLES}, {samples(25.0)}, {blend('s', 'slope')} SELECT tile, line, round(avg(v), 6) AS mean_slope, round(avg((v > 9)::INT), 6) AS steep_share, avg((v > 9)::INT) <= 0.35 AS ok FROM v GROUP BY ALL")
def corridor_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades_of(raster(spark, sf_dir), holes(spark, sf_dir))


def grades_of(cells: DataFrame, lines: DataFrame) -> DataFrame:
    slopes = stencil.slope(cells).select("tile", "x", "y", F.col("slope").alias("z"))
    found = corridors.grades(slopes, lines, CELL, 9.0, 0.35)
    return found.select("tile", "line", r6("mean_slope").alias("mean_slope"), r6("steep_share").alias("steep_share"), "ok")


_KIND = "CASE WHEN z > 32 THEN 'lake' WHEN z > 29 THEN 'stream' WHEN z > 26 THEN 'wetland' ELSE 'dry' END"


def _classes(cells: DataFrame) -> DataFrame:
    z = F.col("z")
    kind = F.when(z > 32, "lake").when(z > 29, "stream").when(z > 26, "wetland").otherwise("dry")
    return cells.select("tile", "x", "y", "z", kind.alias("kind")).withColumn("blocks", corridors.blocking(F.col("kind"), z - 29.75))


@query(f"WITH {RASTER}, c AS (SELECT tile, {_KIND} AS kind, z FROM r) SELECT tile, kind, count(*) AS cells, count(*) FILTER (kind IN ('lake', 'pond', 'wetland') OR (kind = 'stream' AND z - 29.75 >= 0.75)) AS blocking FROM c GROUP BY ALL")
def blocking_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _classes(raster(spark, sf_dir)).withColumn("closed", corridors.blocking(F.col("kind"), F.col("z") - 29.75, wetland=True))
    return cells.groupBy("tile", "kind").agg(F.count("*").alias("cells"), F.count(F.when(F.col("closed"), 1)).alias("blocking"))


@query(f"""WITH {RASTER}, {HOLES}, {samples(5.0)}, c AS (SELECT tile, x, y, {_KIND} AS kind, z > 32 OR (z > 29 AND z - 29.75 >= 0.75) AS blocks FROM r),
m AS (SELECT p.*, kind, blocks, coalesce(kind = 'wetland', FALSE)::INT wet FROM p LEFT JOIN c ON c.tile = p.tile AND c.x = floor(px + 0.5) AND c.y = floor(py + 0.5)),
g AS (SELECT *, sum(1 - wet) OVER (PARTITION BY tile, line ORDER BY k) run FROM m),
q AS (SELECT tile, line, run, sum(wet) * any_value(len) / any_value(n) carry, bool_or(coalesce(blocks, FALSE)) blocks, bool_or(coalesce(kind = 'stream' AND NOT blocks AND s BETWEEN 100 AND 900, FALSE)) creek FROM g GROUP BY ALL)
SELECT tile, line, round(max(carry), 4) AS carry_m, bool_or(blocks) AS blocked, NOT bool_or(blocks) AND max(carry) < 120 AS water_ok, bool_or(creek) AS creek FROM q GROUP BY ALL""")
def corridor_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water_of(raster(spark, sf_dir), holes(spark, sf_dir))


def water_of(cells: DataFrame, lines: DataFrame) -> DataFrame:
    found = corridors.crossings_of_water(_classes(cells), lines, CELL, 120.0, 100.0, 900.0)
    return found.select("tile", "line", r4("carry_m").alias("carry_m"), "blocked", "water_ok", "creek")


@query(f"""WITH {RASTER}, {HOLES}, {samples(15.0)}, {blend('r')}, e AS (SELECT tile, line, max(v) FILTER (k = 0) z0, max(v) FILTER (k = n) z1 FROM v GROUP BY ALL)
SELECT tile, line, bool_or(coalesce(k BETWEEN 1 AND n - 1 AND len >= 40 AND v > z0 + 1.7 + (z1 + 0.5 - z0 - 1.7) * k / n + 0.5, FALSE)) AS blind FROM v JOIN e USING (tile, line) GROUP BY ALL""")
def blind_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corridors.blind(raster(spark, sf_dir), holes(spark, sf_dir), CELL)


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line in two legs, over a place beside its middle."""
    mx, my = (F.col("ax") + F.col("bx")) / 2 + 1.5, (F.col("ay") + F.col("by")) / 2 - 1.25
    both = F.array(F.struct(F.lit(1).alias("leg"), F.col("ax"), F.col("ay"), mx.alias("bx"), my.alias("by")), F.struct(F.lit(2).alias("leg"), mx.alias("ax"), my.alias("ay"), F.col("bx"), F.col("by")))
    return holes(spark, sf_dir).select("tile", "line", F.inline(both))


LEGS = f"""{HOLES}, hm AS (SELECT *, (ax + bx) / 2 + 1.5 mx, (ay + b_y) / 2 - 1.25 my FROM h), g0 AS (SELECT tile, line, 1 leg, ax, ay, mx bx, my b_y FROM hm UNION ALL SELECT tile, line, 2, mx, my, bx, b_y FROM hm),
g1 AS (SELECT *, 60.0::DOUBLE * sqrt(power(bx - ax, 2) + power(b_y - ay, 2)) m FROM g0), g2 AS (SELECT *, sum(m) OVER w s1, sum(m) OVER w - m s0, lead(leg) OVER w IS NULL AS last FROM g1 WINDOW w AS (PARTITION BY tile, line ORDER BY leg))"""


@query(f"""WITH {RASTER}, {LEGS}, g3 AS (SELECT *, greatest(ceil(m / 25.0), 1)::INT n FROM g2 WHERE m >= 1e-9), g4 AS (SELECT *, unnest(range(n + 1)) k FROM g3),
g5 AS (SELECT *, CASE WHEN s1 >= 137 AND s0 < 137 AND m > 0 THEN (137 - s0) / m ELSE 1.0 END u FROM g2 WHERE (s1 >= 137 AND s0 < 137 AND m > 0) OR (last AND s1 < 137)),
p AS (SELECT tile, line, leg, k, n, m, s0, 'piece' what, ax + (bx - ax) * (k / n::DOUBLE) px, ay + (b_y - ay) * (k / n::DOUBLE) py FROM g4 UNION ALL SELECT tile, line, leg, 0, 1, m, s0, 'drive', ax + (bx - ax) * u, ay + (b_y - ay) * u FROM g5), {blend('r')},
w AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY tile, line, leg, what ORDER BY k)) rise, m / n d, s0 + (m / n) * (k - 0.5) middle, row_number() OVER (PARTITION BY tile, line, what ORDER BY leg, k) i, row_number() OVER (PARTITION BY tile, line, what ORDER BY leg DESC, k DESC) j FROM v)
SELECT tile, line, round(max(v) FILTER (what = 'piece' AND j = 1) - max(v) FILTER (what = 'piece' AND i = 1), 4) AS dz, round(max(v) FILTER (what = 'piece' AND i = 1) - max(v) FILTER (what = 'drive'), 4) AS drive_drop,
round(sum(CASE WHEN what = 'piece' AND k > 0 AND middle >= 150 AND d >= 1 THEN greatest(rise / d - 0.07, 0) * d ELSE 0 END), 4) AS steep_m FROM w GROUP BY ALL""")
def line_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corridors.elevations(raster(spark, sf_dir), legs(spark, sf_dir), CELL)
    return found.select("tile", "line", r4("dz").alias("dz"), r4("drive_drop").alias("drive_drop"), r4("steep_m").alias("steep_m"))


def _cross(a: str, b: str, x: str, y: str) -> str:
    """Twice the area of the triangle of segment ends and a point; a: the segment's alias."""
    return f"(({a}.bx - {a}.ax) * ({y} - {a}.ay) - ({a}.b_y - {a}.ay) * ({x} - {a}.ax))"


def _reach(s: str, x: str, y: str) -> str:
    u = f"CASE WHEN power({s}.bx - {s}.ax, 2) + power({s}.b_y - {s}.ay, 2) > 0 THEN greatest(0.0, least(1.0, (({x} - {s}.ax) * ({s}.bx - {s}.ax) + ({y} - {s}.ay) * ({s}.b_y - {s}.ay)) / (power({s}.bx - {s}.ax, 2) + power({s}.b_y - {s}.ay, 2)))) ELSE 0.0 END"
    return f"sqrt(power({x} - ({s}.ax + ({u}) * ({s}.bx - {s}.ax)), 2) + power({y} - ({s}.ay + ({u}) * ({s}.b_y - {s}.ay)), 2))"


_ON = lambda s, x, y, d: f"({d} = 0 AND {x} BETWEEN least({s}.ax, {s}.bx) AND greatest({s}.ax, {s}.bx) AND {y} BETWEEN least({s}.ay, {s}.b_y) AND greatest({s}.ay, {s}.b_y))"


@query(f"""WITH {RASTER}, {HOLES}, t AS (SELECT * FROM h WHERE tile = (SELECT min(tile) FROM r)),
c AS (SELECT a.tile, a.line, b.line AS other, {_cross('b', '', 'a.ax', 'a.ay')} d1, {_cross('b', '', 'a.bx', 'a.b_y')} d2, {_cross('a', '', 'b.ax', 'b.ay')} d3, {_cross('a', '', 'b.bx', 'b.b_y')} d4, least({_reach('b', 'a.ax', 'a.ay')}, {_reach('b', 'a.bx', 'a.b_y')}, {_reach('a', 'b.ax', 'b.ay')}, {_reach('a', 'b.bx', 'b.b_y')}) apart,
{_ON('b', 'a.ax', 'a.ay', _cross('b', '', 'a.ax', 'a.ay'))} OR {_ON('b', 'a.bx', 'a.b_y', _cross('b', '', 'a.bx', 'a.b_y'))} OR {_ON('a', 'b.ax', 'b.ay', _cross('a', '', 'b.ax', 'b.ay'))} OR {_ON('a', 'b.bx', 'b.b_y', _cross('a', '', 'b.bx', 'b.b_y'))} AS touch FROM t a JOIN t b ON a.line < b.line),
g AS (SELECT tile, line, other, 60 * CASE WHEN touch OR (d1 * d2 < 0 AND d3 * d4 < 0) THEN 0 ELSE apart END gap FROM c) SELECT tile, line, other, round(gap, 4) AS gap FROM g WHERE gap < 45""")
def close_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lines that come nearer than 45 m, on the first tile (lines are the same on all)."""
    found = corridors.near_pairs(on_first(holes(spark, sf_dir)), CELL, APART)
    return found.select("tile", "line", "other", r4("gap").alias("gap"))


def on_first(lines: DataFrame) -> DataFrame:
    first = lines.agg(F.min("tile").alias("tile"))
    return lines.join(F.broadcast(first), "tile")


_TURN = "180 - degrees(acos(least(1, greatest(-1, (f * f + g * g - d * d) / (2 * f * g)))))"


@query(f"""WITH {RASTER}, {HOLES}, t AS (SELECT line, ax, ay, bx, b_y, sqrt(power(bx - ax, 2) + power(b_y - ay, 2)) d, CASE WHEN line % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE side FROM h WHERE tile = (SELECT min(tile) FROM r)), l AS (SELECT *, 1.07 * d * 0.55 f, 1.07 * d * 0.45 g FROM t WHERE d > 1),
s AS (SELECT *, {_TURN} turn, (d * d + f * f - g * g) / (2 * d) al FROM l), o AS (SELECT *, side * sqrt(greatest(f * f - al * al, 0)) off FROM s WHERE turn <= 55)
SELECT line, round(ax + (bx - ax) / d * al - (b_y - ay) / d * off, 4) AS x, round(ay + (b_y - ay) / d * al + (bx - ax) / d * off, 4) AS y, round(turn, 4) AS turn FROM o""")
def single_bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = holes(spark, sf_dir).drop("tile").distinct()
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    d = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    side = F.when(F.col("line") % 2 == 0, 1.0).otherwise(-1.0)
    found = lines.select("line", layouts.bend(*ends, 1.07 * d, F.lit(0.55), side).alias("b")).where("b is not null")
    return found.select("line", r4("b.x").alias("x"), r4("b.y").alias("y"), r4("b.turn").alias("turn"))


@query(f"""WITH {RASTER}, {HOLES}, t AS (SELECT line, ax, ay, bx, b_y, sqrt(power(bx - ax, 2) + power(b_y - ay, 2)) d FROM h WHERE tile = (SELECT min(tile) FROM r)), l AS (SELECT *, 1.06 * d * 0.4 one, 1.06 * d * (0.75 - 0.4) two, 1.06 * d * (1 - 0.75) three, (bx - ax) / d ux, (b_y - ay) / d uy FROM t WHERE d > 1),
v AS (SELECT *, ax + (ux * cos(0.2) - uy * sin(0.2)) * one x1, ay + (ux * sin(0.2) + uy * cos(0.2)) * one y1 FROM l), c AS (SELECT *, sqrt(power(bx - x1, 2) + power(b_y - y1, 2)) c FROM v),
s AS (SELECT *, two f, three g, (c * c + two * two - three * three) / (2 * c) al FROM c WHERE c < two + three AND c > abs(two - three) + 1e-9), o AS (SELECT *, {_TURN.replace('d * d', 'c * c')} turn2, x1 + (bx - x1) / c * al + (b_y - y1) / c * sqrt(greatest(two * two - al * al, 0)) x2, y1 + (b_y - y1) / c * al - (bx - x1) / c * sqrt(greatest(two * two - al * al, 0)) y2 FROM s),
q AS (SELECT *, degrees(acos(least(1, greatest(-1, ((x1 - ax) * (x2 - x1) + (y1 - ay) * (y2 - y1)) / (one * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))))))) turn1 FROM o)
SELECT line, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, round(greatest(turn1, turn2), 4) AS turn FROM q WHERE c > 1 AND turn1 <= 55 AND turn2 <= 55""")
def double_bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = holes(spark, sf_dir).drop("tile").distinct()
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    d = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    found = lines.select("line", layouts.two_bends(*ends, 1.06 * d, (0.4, 0.75), 0.2, F.lit(-1.0)).alias("b")).where("b is not null")
    return found.select("line", *(r4(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "turn")))


@query(f"WITH {RASTER}, {HOLES} SELECT tile, line, round(len, 4) AS length, CASE WHEN len > 0 THEN round((bx - ax) * 60 / len, 6) + 0.0 ELSE 0.0 END AS ux, CASE WHEN len > 0 THEN round((b_y - ay) * 60 / len, 6) + 0.0 ELSE 0.0 END AS uy, round(ax * bx + ay * b_y, 4) AS dot, round(ax * b_y - ay * bx, 4) AS perp, round(ax + (bx - ax) * 0.25, 6) AS quarter_x, ax * 60 BETWEEN 250 + 30 AND 1750 - 30 AND ay * 60 BETWEEN 250 + 30 AND 1750 - 30 AS in_box FROM hl")
def plane_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_of(holes(spark, sf_dir))


def vectors_of(lines: DataFrame) -> DataFrame:
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    length = CELL * F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2))
    unit = lambda d: F.when(length > 0, r6(d * CELL / length) + 0.0).otherwise(0.0)
    return lines.select("tile", "line", r4(length).alias("length"), unit(bx - ax).alias("ux"), unit(by - ay).alias("uy"), r4(ax * bx + ay * by).alias("dot"), r4(ax * by - ay * bx).alias("perp"), r6(ax + (bx - ax) * 0.25).alias("quarter_x"), corridors.in_box(ax * CELL, ay * CELL, 30.0).alias("in_box"))


# Lookups.
def sql_table1(x: str, axis, values) -> str:
    out = f"{values[-1]}::DOUBLE"
    for (x0, v0), (x1, v1) in reversed(list(zip(zip(axis, values, strict=True), zip(axis[1:], values[1:], strict=True), strict=False))):
        out = f"CASE WHEN {x} <= {x1} THEN {v0}::DOUBLE + (greatest({x}, {axis[0]}) - {x0}) * {(v1 - v0) / (x1 - x0)!r}::DOUBLE ELSE {out} END"
    return out


def sql_table2(x: str, y: str, rows, columns, values) -> str:
    along = [f"({sql_table1(y, columns, v)})" for v in values]
    out = along[-1]
    for i in reversed(range(len(rows) - 1)):
        out = f"CASE WHEN {x} <= {rows[i + 1]} THEN {along[i]} + ({along[i + 1]} - {along[i]}) * ((greatest({x}, {rows[0]}) - {rows[i]}) / {rows[i + 1] - rows[i]}) ELSE {out} END"
    return out


_KNOBS = "k AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE * 0.93711 + l_extendedprice::DOUBLE / 7919 amplitude, 200 + l_extendedprice::DOUBLE / 20 period, 0.45 + l_tax::DOUBLE * 5 gain, 0.2 + l_discount::DOUBLE * 40 power, l_linenumber::DOUBLE intensity FROM lineitem), e AS (SELECT *, CASE WHEN power >= 1 THEN power ELSE 1 / greatest(power, 1e-6) END strong FROM k)"
_SKEW = sql_table1("strong", layouts.STRENGTHS, layouts.STRENGTH_SKEW)


@query(f"""WITH {_KNOBS}, f AS (SELECT *, greatest({sql_table2("period", "gain", layouts.PERIODS, layouts.GAINS, layouts.RELIEF)}, 0.05) a, greatest({sql_table1("strong", layouts.STRENGTHS, layouts.STRENGTH_RELIEF)}, 0.05) b, greatest({sql_table2("intensity", "period", layouts.INTENSITIES, layouts.EROSION_PERIODS, layouts.KEPT)}, 0.1) c FROM e), g AS (SELECT *, greatest(amplitude * a * b * c, 0) relief FROM f)
SELECT l_orderkey, l_linenumber, round(relief, 6) AS relief, CASE WHEN relief < 20 THEN 'lowland' WHEN relief < 65 THEN 'rolling' ELSE 'mountain' END AS mode, round(CASE WHEN power >= 1 THEN {_SKEW} ELSE -({_SKEW}) END, 6) AS skew, least(7, greatest(3, ceil(ln(greatest(period / 30.0, 2.0)) / {0.6931471805599453}) + 1))::INT AS octaves, round(0.10 * period, 6) AS warp, round(1.15 * period, 6) AS warp_period FROM g""")
def knob_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda c: F.col(c).cast("double")
    k = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (f("l_quantity") * 0.93711 + f("l_extendedprice") / 7919).alias("amplitude"), (200 + f("l_extendedprice") / 20).alias("period"), (0.45 + f("l_tax") * 5).alias("gain"), (0.2 + f("l_discount") * 40).alias("power"), f("l_linenumber").alias("intensity"))
    k = k.withColumn("relief", layouts.relief_estimate(*(F.col(c) for c in ("amplitude", "period", "gain", "power", "intensity"))))
    return k.select("l_orderkey", "l_linenumber", r6("relief").alias("relief"), banded(F.col("relief"), 20, 65).alias("mode"), r6(layouts.skew_estimate(F.col("power"))).alias("skew"), layouts.octaves(F.col("period")).cast("int").alias("octaves"), r6(0.10 * F.col("period")).alias("warp"), r6(1.15 * F.col("period")).alias("warp_period"))


_EASED = [(5.0, 1.0), (15.0, 4.0), (30.0, 2.0), (45.0, 9.0)]
_LENGTHS = [(0.0, 120.0), (0.25, 150.0), (0.5, 165.0), (0.9, 200.0), (1.0, 230.0)]


def _eased_sql(x: str) -> str:
    out = "9.0::DOUBLE"
    for (x0, y0), (x1, y1) in reversed(list(zip(_EASED, _EASED[1:], strict=False))):
        u = f"(({x} - {x0}) / {x1 - x0})"
        out = f"CASE WHEN {x} <= {x1} THEN {y0}::DOUBLE + {y1 - y0} * ({u} * {u} * (3 - 2 * {u})) ELSE {out} END"
    return f"CASE WHEN {x} <= 5 THEN 1.0 ELSE {out} END"


def _lengths_sql(x: str) -> str:
    out = "230.0::DOUBLE"
    for (x0, y0), (x1, y1) in reversed(list(zip(_LENGTHS, _LENGTHS[1:], strict=False))):
        out = f"CASE WHEN {x} < {x1} THEN {y0}::DOUBLE + ({x} - {x0}) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE ELSE {out} END"
    return f"CASE WHEN {x} <= 0 THEN 120.0 ELSE {out} END"


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE q, l_discount::DOUBLE * 10 u FROM lineitem)
SELECT l_orderkey, l_linenumber, round({_eased_sql("q")}, 6) AS eased, round({_lengths_sql("u")}, 6) AS length, round(1 / (1 + exp(-(q - 25) / 5)), 6) AS sigmoid, round(CASE WHEN u > 0 THEN 30 * u * tanh(least(20, greatest(-20, q / (30 * u)))) ELSE q END, 6) AS soft FROM q""")
def shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount").cast("double") * 10).alias("u"))
    q, u = F.col("q"), F.col("u")
    return li.select("l_orderkey", "l_linenumber", r6(layouts.eased_knots(q, _EASED)).alias("eased"), r6(scalars.piecewise(u, _LENGTHS)).alias("length"), r6(layouts.sigmoid((q - 25) / 5)).alias("sigmoid"), r6(layouts.soft_clamp(q, 30 * u)).alias("soft"))


@query("""WITH a AS (SELECT o_orderkey, xor(o_orderkey, 2654435769::BIGINT) h FROM orders), b AS (SELECT o_orderkey, xor(h, h >> 16)::HUGEINT h FROM a), c AS (SELECT o_orderkey, ((h * 2146121005) % 4294967296)::BIGINT h FROM b), d AS (SELECT o_orderkey, xor(h, h >> 15)::HUGEINT h FROM c), e AS (SELECT o_orderkey, ((h * 2221713035) % 4294967296)::BIGINT h FROM d)
SELECT o_orderkey, round(xor(h, h >> 16) / 4294967296.0::DOUBLE, 9) AS share FROM e""")
def hash_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(layouts.hash_share(F.col("o_orderkey")), 9).alias("share"))


_METRICS = ("relief_p95_p5", "slope_mean", "rms_roughness_small", "drainage_density", "frac_flat", "highfreq_energy_frac", "canopy_fraction")
_TEXTS = ("Relief and amplitude of the macro field", "flat share, steep faces", "rough texture, high-freq band", "drainage and valley spacing", "canopy_fraction only", "")


@query(f"""WITH t AS (SELECT unnest([{", ".join(repr(t) for t in _TEXTS)}]) AS text), m AS (SELECT unnest([{", ".join(repr(m) for m in _METRICS)}]) AS metric), a AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in layouts.ALIASES.items())}) a(first, alias)),
c AS (SELECT p_partkey, p_partkey % {len(_TEXTS)} AS t FROM part), x AS (SELECT p_partkey, ([{", ".join(repr(t) for t in _TEXTS)}])[t + 1] AS text, metric FROM c, m)
SELECT p_partkey, metric, contains(lower(text), metric) OR contains(lower(text), split_part(metric, '_', 1)) OR coalesce(contains(lower(text), alias), FALSE) AS named FROM x LEFT JOIN a ON a.first = split_part(metric, '_', 1)""")
def metric_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS) + 1).cast("int"))
    each = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.explode(F.array(*map(F.lit, _METRICS))).alias("metric"))
    return each.select("p_partkey", "metric", layouts.names_metric(F.col("text"), F.col("metric")).alias("named"))


@query("SELECT s_suppkey, round((s_acctbal / 10000 + 1) * 111320.0 * cos(radians((40.0 + 41.0) / 2)), 4) AS east, round((41.0 - (40.5 + s_acctbal / 30000)) * 110540.0, 4) AS south FROM supplier")
def survey_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, south = layouts.survey_metres(40.5 + F.col("s_acctbal") / 30000, F.col("s_acctbal") / 10000, F.lit(40.0), F.lit(41.0), F.lit(-1.0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r4(east).alias("east"), r4(south).alias("south"))


@query(f"WITH {RASTER}, {HOLES}, {samples(60.0)}, {blend('r')} SELECT tile, line, k::INT AS k, round(s, 4) AS at, round(v, 6) AS z FROM v")
def line_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = stencil.bilinear(raster(spark, sf_dir), corridors.sampled(holes(spark, sf_dir), CELL, 60.0))
    return on.select("tile", "line", "k", r4("at").alias("at"), r6("v").alias("z"))
