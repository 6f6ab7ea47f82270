"""Records, seeds, settings, background jobs and commands."""

import json
import time

import pytest
from pyspark.sql import functions as F

from rasterloom import __main__, jobs
from rasterloom.sources import records


def test_seeds_come_in_chunks(spark):
    got = records.seeds(spark, 100, 1300)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 1300
    assert {(r.chunk, r.n) for r in got.groupBy("chunk").agg(F.count("*").alias("n")).collect()} == {(0, 512), (1, 512), (2, 276)}


def test_manifest_draws_what_is_left_out(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": 1, "seed": 5, "gain": 0.6}, {"id": 2, "seed": 7}]))
    got = records.manifest(spark, f"file://{tmp_path}/m.json", "id long, seed long, gain double", {"gain": F.col("seed") / 100.0}).orderBy("id").collect()
    assert [r.gain for r in got] == [0.6, 0.07]
    (tmp_path / "bad.json").write_text('[{"id": "x"}]')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|Malformed"):
        records.manifest(spark, f"file://{tmp_path}/bad.json", "id long").collect()


def test_records_of_a_folder_and_embedded_ones(spark, tmp_path):
    for name, body in (("b", {"name": "B", "par": 70}), ("a", {"name": "A"}), ("c", {"name": "C", "par": 72})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "note.txt").write_text("no record")
    got = records.records(spark, f"file://{tmp_path}", "name string, par int", ("par",)).orderBy("key").collect()
    assert [(r.key, r.name) for r in got] == [("b", "B"), ("c", "C")]
    (tmp_path / "page.html").write_text('<script>window.ITEMS={"x": {"name": "X", "par": 3}, "y": {"name": "Y"}};</script>')
    found = records.embedded(spark, f"file://{tmp_path}/page.html", "window.ITEMS=", "</script>", "name string, par int").collect()
    assert {r.key: r.record.par for r in found} == {"x": 3, "y": None}


def test_settings_files(tmp_path):
    (tmp_path / "s.yaml").write_text('# all\nseed: 5\nslope:\n  flat_deg: 3.0   # level\n  band: [30.0, 400.0]\nmodel: "exponential"\nmask:\n  water: true\n')
    assert records.settings(str(tmp_path / "s.yaml")) == {"seed": 5, "slope": {"flat_deg": 3.0, "band": [30.0, 400.0]}, "model": "exponential", "mask": {"water": True}}
    (tmp_path / "s.json").write_text('{"a": [1, 2]}')
    assert records.settings(str(tmp_path / "s.json")) == {"a": [1, 2]}


def test_jobs_finish_fail_and_stop(spark, tmp_path):
    done = jobs.Job(spark, lambda s: s.range(100).select((F.col("id") * 2).alias("x")), f"file://{tmp_path}/done")
    assert done.result(120).agg(F.sum("x")).first()[0] == 9900 and done.state == "done"
    bad = jobs.Job(spark, lambda s: s.range(3).select("nothing"), f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="nothing"):
        bad.result(120)
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    long = jobs.Job(spark, lambda s: s.range(0, 4000, 1, 8).select(slow("id").alias("x")), f"file://{tmp_path}/long")
    deadline = time.time() + 60
    while long.progress()[1] == 0 and time.time() < deadline:
        time.sleep(0.2)
    assert long.progress()[1] > 0 and long.result(0.1) is None
    long.cancel()
    assert long.result(60) is None and long.state == "cancelled"


def test_commands(spark, tmp_path, capsys):
    assert __main__.main(["list"]) == 0 and "match_topk (SQL)" in capsys.readouterr().out
    assert __main__.main(["sql", "tile_stats"]) == 0 and "GROUP BY tile" in capsys.readouterr().out
    assert __main__.main(["run", "nowhere"]) == 2
    assert __main__.main(["run", "tile_stats", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out", "--format", "json"]) == 0
    assert spark.read.json(f"file://{tmp_path}/out").count() >= 4
