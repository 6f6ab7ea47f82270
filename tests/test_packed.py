"""Packed files: exact round trips, and damage that raises."""

import base64

import numpy as np
import pytest

from rasterloom.sources import packed

CELLS = np.arange(256 * 256)


def small(par):
    z = 100 + (CELLS % 977) / 10
    return {"key": "a", "label": "A", "arch": "x", "group": 1, "wm": 1600.0, "hm": 1200.0, "emin": 100.0, "emax": 197.6, "waterpct": 1.0, "treepct": 2.0, "bbox": [1.0, 2.0, 3.0, 4.0], "z": z, "water": CELLS % 13 == 0, "trees": CELLS % 7 == 0, "holes": [(1, par, [(0.5, 1.5), (2.5, 3.5)])]}


@pytest.mark.parametrize("par", [None, 0, 4])
def test_survey_round_trip(par):
    want = small(par)
    raw = packed.encode_survey([want, want | {"key": "b", "holes": []}])
    got = list(packed.decode_survey(raw))
    assert [r["key"] for r in got] == ["a", "b"]
    assert np.array_equal(got[0]["z"], want["z"].astype(np.float32))
    assert np.array_equal(got[0]["water"], want["water"]) and np.array_equal(got[0]["trees"], want["trees"])
    assert got[0]["holes"] == [(1, par, [[0.5, 1.5], [2.5, 3.5]])]
    again = [r | {"z": r["z"].astype(float)} for r in got]
    assert packed.encode_survey(again) == raw


def test_damage_raises():
    raw = packed.encode_survey([small(3)])
    for bad in (b"x" + raw[1:], raw[:-1], raw + b"x"):
        with pytest.raises(ValueError):
            list(packed.decode_survey(bad))
    grid = packed.encode_grid(np.zeros((2, 3), np.float32), np.zeros((2, 3)), 6.0)
    for bad in (b"x" + grid[1:], grid[:-1]):
        with pytest.raises(ValueError):
            packed.decode_grid(bad)
    with pytest.raises(ValueError):
        packed.unpack_bits(b"a", 9)
    with pytest.raises(ValueError):
        packed.decode_heights(base64.b64encode(b"abc").decode(), 0.0, 1)


def test_bits_and_decimetres():
    assert packed.pack_bits(np.array([1, 0, 0, 0, 0, 0, 0, 1, 1])) == b"\x81\x80"
    assert packed.to_decimetres(np.array([-1.0, 0.05, 0.25, 1e9]), 0.0).tolist() == [0, 1, 3, 65535]
    assert packed.decode_heights(base64.b64encode(b"\x0a\x00\x00\x01").decode(), 5.0, 2).tolist() == pytest.approx([6.0, 30.6])


def test_fingerprint_of_nothing_is_the_offset():
    assert packed.fingerprint([]) == packed.FNV_OFFSET
    assert packed.fingerprint([("a", b"")]) == 0xAF63DC4C8601EC8C


def test_grid_files(spark, tmp_path):
    spark.dataSource.register(packed.GridFiles)
    folder = str(tmp_path / "grids")
    rows = [("a", 1, 2, 6.0, [1.5, None], [True, False]), ("b", 2, 1, 3.0, [0.0, 2.0], [False, False])]
    spark.createDataFrame(rows, packed.GRID_SCHEMA).write.format("gridfile").option("path", folder).mode("append").save()
    got = {r.name: r for r in spark.read.format("gridfile").option("path", folder).load().collect()}
    assert set(got) == {"a", "b"} and got["b"].z == [0.0, 2.0] and got["a"].water == [True, False]
    assert got["a"].z[0] == 1.5 and np.isnan(got["a"].z[1])
    assert not [f for f in (tmp_path / "grids").iterdir() if f.name.startswith("_")]


def test_pages_without_records_give_none(spark):
    pages = spark.createDataFrame([("<html></html>",), (None,), ("<script>window.COURSES={};</script>",)], "html string")
    assert packed.embedded_records(pages).count() == 0
