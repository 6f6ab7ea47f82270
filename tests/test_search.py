"""The two-stage search: offsets, kept courses without hits, stale results."""

import pytest

from rasterloom.operators import search


@pytest.mark.parametrize(("slack", "step", "want"), [(32, 10, [0, 10, 20, 30, 32]), (30, 10, [0, 10, 20, 30]), (0, 5, [0]), (3, 0, [0, 1, 2, 3])])
def test_offsets_have_both_ends(slack, step, want):
    assert search.axis_offsets(slack, step) == want


def inputs(spark):
    worlds = [(i, [float((i * 37 + j * j * 11 + i * j * 5) % 101) for j in range(12)]) for i in range(6)]
    templates = [(100, worlds[3][1][4:8]), (101, [5.0, 5.0, 5.0, 5.0])]
    return spark.createDataFrame(worlds, "vec_id bigint, v array<double>"), spark.createDataFrame(templates, "template_id bigint, t array<double>")


def test_finds_where_it_was_cut_from_and_makes_worlds_once(spark):
    worlds, templates = inputs(spark)
    asked = []

    def make(ids):
        asked.extend(r.vec_id for r in ids.collect())
        return worlds.join(ids, "vec_id")

    got = {r.template_id: r.best for r in search.two_stage(worlds, templates, 12, 4, 3, 1, 4, 2, make).collect()}
    first = got[100][0]
    assert (first.vec_id, first.off, first.rmse, first.rank) == (3, 4, 0.0, 1) and len(got[100]) == 2
    assert len(asked) == len(set(asked)) <= 6


def test_templates_without_worlds_stay(spark):
    worlds, templates = inputs(spark)
    got = search.two_stage(worlds.limit(0), templates, 12, 4, 3, 1, 4, 2).collect()
    assert sorted((r.template_id, r.best) for r in got) == [(100, []), (101, [])]


def test_stale_results_are_refused(spark, tmp_path):
    worlds, templates = inputs(spark)
    settings = {"size": 12, "length": 4, "sparse": 3, "dense": 1, "shortlist": 4, "keep": 2}
    mark, path = search.fingerprint(templates, settings), f"file://{tmp_path}/results"
    assert mark == search.fingerprint(templates.repartition(3), dict(reversed(settings.items())))
    results = search.two_stage(worlds, templates, **settings)
    search.save_results(results, path, mark)
    assert sorted(map(str, search.load_results(spark, path, mark).collect())) == sorted(map(str, results.collect()))
    other = search.fingerprint(templates, settings | {"keep": 3})
    assert other != mark and search.load_results(spark, path, other) is None
