"""Draws of pars and lengths: what is used often is evaluated once."""

import time

from pyspark.sql import functions as F

from rasterloom import catalogue
from rasterloom.functions import sampling


def test_draws_of_many_keys(spark):
    # As expressions put in wherever they are used, an order was sorted 19 times or more a try.
    plan = spark.range(1).select(sampling.par_order(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort(") == 1 and plan.count(":order") == 1 and plan.count(":take") == 1
    key = F.col("id").cast("string")
    began = time.time()
    got = spark.range(2000).select("id", sampling.par_order(key).alias("pars")).select("id", "pars", sampling.hole_lengths(key, F.col("pars")).alias("m")).collect()
    assert time.time() - began < 60
    assert all(sorted(r.pars) == [3] * r.pars.count(3) + [4] * r.pars.count(4) + [5] * r.pars.count(3) and sum(r.pars) == 36 for r in got)
    ends = {p: (knots[0][1], knots[-1][1]) for p, knots in sampling.LENGTHS.items()}
    assert all(ends[p][0] <= m <= ends[p][1] for r in got for p, m in zip(r.pars, r.m))


def test_lengths_draw_pars_once(spark):
    plan = catalogue.QUERIES["hole_length_draws"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(") == 1


def test_draws_stop_at_the_first_accepted_try(spark, monkeypatch):
    draw = lambda: {r.id: r.p for r in spark.range(100).select("id", sampling.par_order(F.col("id").cast("string")).alias("p")).collect()}
    few = draw()
    monkeypatch.setattr(sampling, "TRIES", 40000)
    began = time.time()
    many = draw()
    # All tries of all keys would be 40 million hashes.
    assert time.time() - began < 15 and sum(few[k] != many[k] for k in few) <= 5
