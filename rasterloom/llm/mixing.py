"""Mixing sources to target weights by entropy balancing, in DataFrame operations throughout.

Token mass x is moved to the mixture that is nearest in Kullback-Leibler divergence among those
that meet the token constraints, with no rate over a cap. The dual is convex, with one multiplier
for each constraint: documents get the exponentially tilted rate exp(sum of the multipliers of
their constraints), or the cap where that is less. Constraints come in two families, whose
combinations are the cells, sufficient statistics of the documents: the sources, of which there may
be any number and whose targets hold exactly, and length classes, a few, whose targets (their natural
shares) have slack: a quadratic term in the dual, so that the sources' targets can always be met.
Given the classes' multipliers a source's is known in closed form, class by class to the cap; put
into the dual that leaves a convex function of the classes' multipliers alone. Each Newton iteration
is one distributed aggregation over the sources: gradient and Hessian, whose off-diagonal blocks
enter by the Schur complement, of the joint problem. Only these sums reach the driver, which solves
the few equations. Rates differ from source to source and, within a source, by length.

Rates become copies by systematic rounding: within each shard of a source, in order of falling
size, a document gets as many copies as the running sum of rates passes half-integers. Neighbours
are of like size, so rounding errors mostly cancel; what a shard is still off by is made up by one
copy more or less of documents of an eighth of it at most. Shards hold about 4096 documents, so no
source, however hot, meets in one task. Texts stay out of these steps: copies are decided on sizes
and keys of the rows, and joined to the rows afterwards. Running sums are of integers (parts in a
thousand million), so reruns agree.

Null sources are a source of their own, null texts have size 0 and take nothing. A null doc_id is a
value like any other. Repeated rows count as rows and get copies each; equal rows are told apart by
nothing, so ties between them change nothing. A text of any length counts wholly. An empty table
gives no rows. repeat_copies() returns the columns of docs, whatever their names are.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

MOST_COPIES, SHARD_DOCS = 3, 4096
#: Upper bounds of the length classes in words; the last class is open. Slack of a class, in shares of all tokens for a tilt by one.
LENGTHS, SLACK = (64, 256, 1024, 4096), 0.02
#: Rates are counted in these parts.
PARTS = 10**9


def word_count(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_class(size: Column) -> Column:
    return reduce(lambda a, b: a + b, ((size > b).cast("int") for b in LENGTHS))


def source_targets(space: Workspace, sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """sources(source, source_size, ...) with target: shares by the weights 1, 2, 3, repeating in code point order, nulls last.

    A target is the lesser of weight * level and most * source size; the level at which they add
    up to all tokens is found by rounds of one aggregation over the sources each. Ranks come from a
    sort by ranges: the place within a partition, and the rows of the partitions before it.
    """
    placed = space.save(sources.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    # One row a partition.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before.alias("before"))
    rank = F.col("before") + F.col("at") - F.shiftleft("part", 33)
    weighed = placed.withColumn("part", part).join(F.broadcast(base), "part").withColumn("weight", (rank % 3 + 1).cast("long"))
    weighed = space.save(weighed.select(*sources.columns, "weight"), "weighed")
    cap = F.col("source_size") * most
    level, full = 0.0, -1
    while True:
        over = cap < F.col("weight") * F.lit(level)
        total, capped, weight, now = weighed.agg(F.sum("source_size"), F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if not total or not weight or now == full:
            break
        full, level = now, (total - capped) / weight
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return weighed.select(*sources.columns, target.alias("target"))


def _solve(rows: list[list[float]], right: list[float]) -> list[float]:
    """The few equations of a Newton step, by elimination with pivots."""
    n, a = len(right), [[*r, y] for r, y in zip(rows, right, strict=True)]
    for i in range(n):
        best = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[best] = a[best], a[i]
        if not a[i][i]:
            continue
        for k in range(n):
            if k != i and a[k][i]:
                times = a[k][i] / a[i][i]
                a[k] = [x - times * y for x, y in zip(a[k], a[i], strict=True)]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def _bind(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _log_rate(tilt: Column, many: int, cap: float) -> Column:
    """A source's multiplier: at it, min(cap, exp(multiplier + tilt)) times its mass by class adds up to its target.

    With the k classes of the greatest tilts at the cap the rest's equation is closed; the first k that holds is right.
    """
    falling = F.array_sort(F.zip_with("mass", tilt, lambda m, t: F.struct((-t).alias("t"), m.cast("double").alias("m"))))

    def with_capped(p: Column, k: Column) -> Column:
        at_cap = _sum(F.transform(F.slice(p, F.lit(1), k), lambda x: x["m"]))
        free = _sum(F.transform(F.slice(p, k + 1, F.lit(many) - k), lambda x: x["m"] * F.exp(-x["t"])))
        sums = F.struct((F.col("target") - F.lit(cap) * at_cap).alias("left"), free.alias("free"))
        value = _bind(sums, lambda v: F.when((v["free"] > 0) & (v["left"] > 0), F.log(v["left"] / v["free"])))
        return _bind(value, lambda v: F.when(v - F.get(p, k)["t"] <= log(cap), v))

    tried = _bind(falling, lambda p: F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: with_capped(p, k)))
    # Every class is at the cap where none holds.
    return F.when(F.col("target") > 0, F.coalesce(F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0)), F.lit(700.0))).otherwise(F.lit(-700.0))


def balance(sources: DataFrame, aims: list[float], cap: float, slack: float, close: float = 1e-10, rounds: int = 100) -> DataFrame:
    """sources(mass, target, ...) with a column rates: mass and rates are arrays by class.

    aims: the classes' targets; slack: tokens that a class may miss for a tilt by one (0: none). The
    multipliers come into the plan as one array, so that every round runs the same generated code.
    """
    many = len(aims)
    tilt, whole, step, last = [0.0] * many, max(1.0, sum(aims)), [0.0] * many, None

    def rated(tilt: list[float], rows: DataFrame) -> DataFrame:
        tilts = F.array(*map(F.lit, tilt))
        logs = rows.withColumn("own", _log_rate(tilts, many, cap)).withColumn("logs", F.transform(tilts, lambda t: F.col("own") + t))
        return logs.withColumn("rates", F.transform("logs", lambda x: F.when(x >= log(cap), F.lit(cap)).otherwise(F.exp(x)))).drop("own")

    def sums(tilt: list[float]):
        cell = lambda c, i: F.get(c, F.lit(i))
        rows = rated(tilt, sources.where("target > 0").select("mass", "target"))
        rows = rows.withColumn("moved", F.zip_with("mass", "rates", lambda m, r: m * r))
        rows = rows.withColumn("free", F.zip_with("moved", "logs", lambda m, x: F.when(x < log(cap), m).otherwise(0.0)))
        # The dual's value given the sources' constraints: their KL against the tilted mass.
        part = F.zip_with("rates", F.array(*map(F.lit, tilt)), lambda r, t: F.log(r) - t - 1)
        rows = rows.select("moved", "free", _sum(F.col("free")).alias("all"), _sum(F.zip_with("moved", part, lambda m, x: m * x)).alias("value"))
        across = [F.sum(F.when(F.col("all") > 0, cell("free", i) * cell("free", j) / F.col("all")).otherwise(0.0)) for i in range(many) for j in range(i + 1)]
        return rows.agg(F.sum("value"), *(F.sum(cell("moved", i)) for i in range(many)), *(F.sum(cell("free", i)) for i in range(many)), *across).first()

    for _ in range(rounds):
        found = [x or 0.0 for x in sums(tilt)]
        moved, free, across = found[1 : 1 + many], found[1 + many : 1 + 2 * many], found[1 + 2 * many :]
        # The profile dual to be made least: the aims' part and the slack come in here.
        value = -found[0] - sum(t * a for t, a in zip(tilt, aims, strict=True)) + slack / 2 * sum(t * t for t in tilt)
        if last is not None and value > last + 1e-12 * whole:
            step = [s / 2 for s in step]
            tilt = [t + s for t, s in zip(tilt, step, strict=True)]
            if max(map(abs, step), default=0) < 1e-12:
                break
            continue
        last = value
        slope = [m - a + slack * t for m, a, t in zip(moved, aims, tilt, strict=True)]
        if max(map(abs, slope), default=0) <= close * whole:
            break
        curve = [[0.0] * many for _ in range(many)]
        for i in range(many):
            for j in range(i + 1):
                curve[i][j] = curve[j][i] = -across[i * (i + 1) // 2 + j]
            curve[i][i] += free[i] + slack + 1e-9 * whole
        step = [max(-2.0, min(2.0, x)) for x in _solve(curve, slope)]
        if max(map(abs, step), default=0) < 1e-11:
            break
        tilt = [t - s for t, s in zip(tilt, step, strict=True)]
    return rated([round(t, 12) for t in tilt], sources).drop("logs")


def entropy_balance(space: Workspace, cells: DataFrame, families: dict[str, DataFrame], cap: float = 1e6, slack: float = 0.0, close: float = 1e-10) -> DataFrame:
    """cells with a column rate: cells has `mass` and the columns of two families, given with their (value, target).

    The first family may have any number of values, the second 64 at most. Raises if the second's
    targets, without slack, contradict the first's.
    """
    (first, targets), (second, aims) = families.items()
    values = aims.orderBy(F.asc_nulls_last(second)).limit(65).collect()
    if len(values) > 64:
        raise ValueError("the second family has over 64 values")
    masses = F.array(*(F.sum(F.when(F.col(second).eqNullSafe(F.lit(r[second])), F.col("mass")).otherwise(0.0)) for r in values))
    sums = cells.groupBy(F.col(first).alias("value")).agg(masses.alias("mass"))
    wide = space.save(sums.join(targets, sums["value"].eqNullSafe(targets[first])).select("value", "mass", "target"), "wide")
    rated = space.save(balance(wide, [float(r["target"]) for r in values], cap, slack, close).select("value", "mass", "rates"), "rated")
    held = rated.agg(*(F.sum(F.get("mass", F.lit(i)) * F.get("rates", F.lit(i))) for i in range(len(values)))).first()
    if not slack and any(abs((h or 0) - r["target"]) > 1e-6 * sum(x["target"] for x in values) for h, r in zip(held, values, strict=True)):
        raise ValueError("the token constraints can't be met together")
    rate = F.coalesce(*(F.when(F.col(second).eqNullSafe(F.lit(r[second])), F.get("rates", F.lit(i))) for i, r in enumerate(values)))
    return cells.join(rated, cells[first].eqNullSafe(rated["value"])).select(*(cells[c] for c in cells.columns), rate.alias("rate"))


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row; columns that hold maps have no hash and are left out."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))


def copies(spark: SparkSession, docs: DataFrame, most: int = MOST_COPIES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, row_key, size, source_size, target, rate, copies) of each row of docs(doc_id, text, source, ...)."""
    space = Workspace(spark, "mixing")
    # One scan of the texts; what follows works on sizes and keys.
    rows = space.save(docs.select("doc_id", F.col("source").alias("source"), word_count(F.col("text")).alias("size"), row_key(docs).alias("row_key")), "rows")
    kind = length_class(F.col("size"))
    masses = F.array(*(F.sum(F.when(kind == j, F.col("size")).otherwise(0)) for j in range(len(LENGTHS) + 1)))
    sources = rows.groupBy("source").agg(masses.alias("mass"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = space.save(source_targets(space, space.save(sources, "sources"), most), "targets")
    aims = targets.agg(*(F.coalesce(F.sum(F.get("mass", F.lit(j))), F.lit(0)) for j in range(len(LENGTHS) + 1))).first()
    targets = balance(targets, [float(x) for x in aims], float(most), SLACK * max(1, sum(aims)))
    parts = F.transform("rates", lambda x: F.least(F.round(x * PARTS), F.lit(most * PARTS)).cast("long"))
    rated = space.save(targets.select(F.col("source").alias("name"), "source_size", "target", parts.alias("parts"), F.ceil(F.col("docs") / shard_docs).alias("shards")), "rates")
    rated = rows.join(rated, rows["source"].eqNullSafe(rated["name"])).drop("name").withColumn("part", F.get("parts", kind)).withColumn("shard", F.pmod(F.xxhash64("row_key"), F.col("shards")))
    order = Window.partitionBy("source", "shard").orderBy(F.desc("size"), "doc_id", "row_key")
    reach = lambda last: F.floor((2 * F.coalesce(F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, last)), F.lit(0)) + PARTS) / (2 * PARTS))
    copied = rated.withColumn("copies", F.least(reach(0) - reach(-1), F.lit(most)).cast("long"))
    # What a shard is off by, over or under, goes to documents of an eighth of it or less, in an order by hash.
    shard = Window.partitionBy("source", "shard")
    off = F.sum((F.col("part") - F.col("copies") * PARTS).cast("decimal(20,0)") * F.col("size")).over(shard)
    copied = copied.withColumn("off", (off / PARTS).cast("double"))
    fits = F.col("size").between(1, F.abs("off") / 8) & F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    given = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(shard.orderBy("row_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    more = F.when(fits & (given <= F.abs("off")), F.signum("off").cast("long")).otherwise(0)
    return copied.select("doc_id", "row_key", "size", "source_size", "target", (F.col("part") / PARTS).alias("rate"), (F.col("copies") + more).alias("copies"))


def repeat_copies(spark: SparkSession, docs: DataFrame, most: int = MOST_COPIES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row of docs for each of its copies.

    Equal rows get the sum of their copies: they meet before the join, combined by each task first.
    """
    taken = copies(spark, docs, most, shard_docs).groupBy("row_key").agg(F.sum("copies").alias("times")).where("times > 0")
    once = docs.select(row_key(docs).alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    once = once.groupBy("row_key").agg(F.first("row").alias("row"))
    # array_repeat holds what one row is repeated; a row that repeats a million times makes an array of 3 MB.
    out = once.join(taken, "row_key").select(F.explode(F.array_repeat(F.lit(False), F.col("times").cast("int"))).alias("again"), "row")
    return out.select("row.*")
