"""Joins and aggregates of points, lines and boxes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt


def segments(points: DataFrame) -> DataFrame:
    """(line, i, ax, ay, bx, by) between the vertices of each line."""
    w = Window.partitionBy("line").orderBy("i")
    return points.select("line", "i", F.col("px").alias("ax"), F.col("py").alias("ay"), F.lead("px").over(w).alias("bx"), F.lead("py").over(w).alias("by")).where("bx is not null")


#: Tasks that share the segments of a cell, and pairs from which places no longer split.
SHARES, FEW_PAIRS = 8, 1 << 12


def _gaps(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distances of points to segments (4 x n: ax, ay, bx, by); to_segment on arrays."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    length2 = dx * dx + dy * dy
    u = np.clip(((x - s[0]) * dx + (y - s[1]) * dy) / np.where(length2 > 0, length2, 1.0), 0.0, 1.0)
    ex, ey = x - (s[0] + u * dx), y - (s[1] + u * dy)
    return np.sqrt(ex * ex + ey * ey)


def first_nearest(at: np.ndarray, s: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place (2 x m) the nearest segment (4 x n), the first on ties of millionths, and its distance so rounded.

    Places split in halves, each with the segments that can be nearest to any of its own: none within r of the
    middle is further from that than the middle's nearest and 2 r. Places with nothing within reach get -1.
    """
    best, least = np.full(at.shape[1], -1), np.full(at.shape[1], np.inf)
    todo = [(np.arange(at.shape[1]), np.arange(s.shape[1]))]
    while todo:
        here, may = todo.pop()
        x, y = at[:, here]
        if len(here) * len(may) > FEW_PAIRS and len(here) > 1:
            mx, my = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
            r = np.sqrt((x - mx) ** 2 + (y - my) ** 2).max()
            gap = _gaps(mx, my, s[:, may])
            may = may[gap <= min(gap.min() + 2 * r, reach + r) + 1e-5]
            order = np.argsort(x if np.ptp(x) > np.ptp(y) else y, kind="stable")
            todo += [(half, may) for half in np.array_split(here[order], 2)] if len(may) else []
            continue
        for k in range(0, len(here), max(1, FEW_PAIRS // max(1, len(may)))) if len(may) else ():
            part = here[k : k + max(1, FEW_PAIRS // len(may))]
            gap = np.floor(_gaps(at[0, part, None], at[1, part, None], s[:, may]) * 1e6 + 0.5) / 1e6
            first = gap.argmin(axis=1)
            least[part], best[part] = gap[np.arange(len(part)), first], may[first]
    best[least > reach] = -1
    return best, least


def nearest_segment(points: DataFrame, key: str, lines: DataFrame, reach: float) -> DataFrame:
    """(key, line, i, distance): the nearest segment within reach of each point(key, px, py), first by line and i on ties.

    Distinct places stand in cells, four times `reach` wide, segments in every cell of their box widened by
    reach, as far as there are points. So places and segments meet by equal cells, never pair by pair as rows:
    on arrays the nearest is found by halving places. The segments of a cell are dealt over several tasks.
    """
    cell = lambda c: F.floor(c / (4 * reach))
    finite = lambda *names: reduce(lambda a, b: a & b, (F.abs(c) < float("inf") for c in names))
    known = points.where(finite("px", "py"))
    extent = known.agg(*(f(c).alias(f"__{n}") for n, f, c in (("x0", F.min, "px"), ("x1", F.max, "px"), ("y0", F.min, "py"), ("y1", F.max, "py"))))
    near = lines.where(finite("ax", "ay", "bx", "by")).crossJoin(F.broadcast(extent))
    for c in "xy":
        low, high = F.greatest(F.least(f"a{c}", f"b{c}") - reach, F.col(f"__{c}0")), F.least(F.greatest(f"a{c}", f"b{c}") + reach, F.col(f"__{c}1"))
        near = near.where(low <= high).withColumn(f"c{c}", F.explode(F.sequence(cell(low), cell(high))))
    keys = ["cx", "cy", "share"]
    boxed = near.select("cx", "cy", (F.abs(F.hash("line", "i")) % SHARES).alias("share"), "line", "i", *(F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")))
    places = known.select(F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).distinct()
    spread = places.select(cell(F.col("px")).alias("cx"), cell(F.col("py")).alias("cy"), F.explode(F.array(*(F.lit(k) for k in range(SHARES)))).alias("share"), "px", "py")

    def run(places: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values(["line", "i"], ignore_index=True)
        best, least = first_nearest(places[["px", "py"]].to_numpy().T, np.ascontiguousarray(near[["ax", "ay", "bx", "by"]].to_numpy().T), reach)
        found = near.loc[best[best >= 0], ["line", "i"]].reset_index(drop=True)
        return places.loc[best >= 0, ["px", "py"]].reset_index(drop=True).join(found).assign(distance=least[best >= 0])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    met = dealt(spread, *keys).groupBy(*keys).cogroup(dealt(boxed, *keys).groupBy(*keys))
    found = met.applyInPandas(run, f"px double, py double, line {kinds['line']}, i {kinds['i']}, distance double")
    of_place = found.groupBy("px", "py").agg(F.min(F.struct("distance", "line", "i")).alias("b"))
    best = known.select(key, F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).join(of_place, ["px", "py"]).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, "b.line", "b.i", "b.distance")


def crossings(lines: DataFrame, cell: float) -> DataFrame:
    """(line, i, j): segments i < j of one line(line, i, ax, ay, bx, by) that cross, touching apart.

    Segments are cut at multiples of `cell` along x and stand, piece by piece, in every cell that their
    piece's box meets, so pairs come from equi-joins on cells; a pair that meets in several counts once.
    """
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    column = lines.withColumn("cx", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    # The piece within the column; upright segments are their own piece.
    flat = F.col("bx") == F.col("ax")
    at = lambda x: F.when(flat, F.lit(None)).otherwise(F.col("ay") + (x - F.col("ax")) / (F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay")))
    left, right = at(F.greatest(low, F.col("cx") * F.lit(cell))), at(F.least(high, (F.col("cx") + 1) * F.lit(cell)))
    ends = F.least("ay", "by"), F.greatest("ay", "by")
    # A little wider, against rounding at the cuts.
    bottom, top = F.coalesce(F.least(left, right), ends[0]) - 1e-6, F.coalesce(F.greatest(left, right), ends[1]) + 1e-6
    placed = column.withColumn("cy", F.explode(F.sequence(F.floor(bottom / cell), F.floor(top / cell))))
    a, b = placed.alias("a"), placed.alias("b")
    side = lambda p, x, y: (F.col(f"{p}.bx") - F.col(f"{p}.ax")) * (F.col(y) - F.col(f"{p}.ay")) - (F.col(f"{p}.by") - F.col(f"{p}.ay")) * (F.col(x) - F.col(f"{p}.ax"))
    u, v = side("a", "b.ax", "b.ay") * side("a", "b.bx", "b.by"), side("b", "a.ax", "a.ay") * side("b", "a.bx", "a.by")
    met = a.join(b, (F.col("a.line") == F.col("b.line")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.i") < F.col("b.i")))
    return met.where((u < 0) & (v < 0)).select("a.line", "a.i", F.col("b.i").alias("j")).distinct()


def padded_box(points: DataFrame, group: str, pad: float, least: float, aspect: float) -> DataFrame:
    """(group, x0, y0, x1, y1): boxes of points(px, py), padded on each side, at least so wide and high, no longer than aspect."""
    b = points.groupBy(group).agg(F.min("px").alias("a"), F.max("px").alias("b"), F.min("py").alias("c"), F.max("py").alias("d"))
    w, h = (F.greatest((F.col(p) - F.col(q)) * (1 + 2 * pad), F.lit(least)) for p, q in (("b", "a"), ("d", "c")))
    width, height = F.greatest(w, h / aspect), F.greatest(h, w / aspect)
    x, y = (F.col("a") + F.col("b")) / 2, (F.col("c") + F.col("d")) / 2
    return b.select(group, (x - width / 2).alias("x0"), (y - height / 2).alias("y0"), (x + width / 2).alias("x1"), (y + height / 2).alias("y1"))


def order_statistics(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, a column for each place): the value at a 0-based place of the sorted group, a function of its size.

    Counts by distinct value pre-aggregate, so the running counts go over distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(group)
    ranked = counts.withColumn("__to", F.sum("__c").over(w.orderBy("__v"))).withColumn("__n", F.sum("__c").over(w))
    at = {name: F.max(F.when((place(F.col("__n")) < F.col("__to")) & (place(F.col("__n")) >= F.col("__to") - F.col("__c")), F.col("__v"))) for name, place in places.items()}
    return ranked.groupBy(group).agg(*(c.alias(name) for name, c in at.items()))
