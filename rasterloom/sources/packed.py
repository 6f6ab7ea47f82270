"""Packed survey files and grid files: codecs, a Spark data source for grids, embedded JSON records.

A grid file holds one grid, north row first. A survey file holds many records, each with a
square grid of decimetres over its lowest point, two bit masks and lines of points. Damaged
input raises: a wrong magic, a short payload or bytes left over.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the two formats and of the FNV-1a hash.
GRID_MAGIC, SURVEY_MAGIC = b"HG01", b"GATLAS2\n"
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
BANDS = ("lowland", "rolling", "mountain")

GRID_SCHEMA = "name string, ny int, nx int, cell float, z array<float>, water array<boolean>"
RECORD = "struct<label: string, arch: string, group: string, b64: string, tb64: string, wb64: string, treepct: double, waterpct: double, wm: double, hm: double, emin: double, emax: double, bbox: array<double>, holes: array<struct<ref: int, par: int, pts: array<array<double>>>>>"


def encode_grid(z: np.ndarray, water: np.ndarray, cell: float) -> bytes:
    """z[y, x] with row 0 in the north; masked cells are NaN."""
    ny, nx = z.shape
    return GRID_MAGIC + struct.pack("<IIf", ny, nx, cell) + z.astype("<f4").tobytes() + water.astype(np.uint8).tobytes()


def decode_grid(raw: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    if raw[:4] != GRID_MAGIC:
        raise ValueError("not a grid file")
    ny, nx, cell = struct.unpack_from("<IIf", raw, 4)
    if len(raw) != 16 + 5 * ny * nx:
        raise ValueError(f"a grid of {ny} x {nx} takes {16 + 5 * ny * nx} bytes, found {len(raw)}")
    z = np.frombuffer(raw, "<f4", ny * nx, 16).reshape(ny, nx)
    return z, np.frombuffer(raw, np.uint8, ny * nx, 16 + 4 * ny * nx).reshape(ny, nx).astype(bool), cell


def to_decimetres(z: np.ndarray, lowest: float) -> np.ndarray:
    """Heights over the lowest point in unsigned 16-bit decimetres, halves up, clipped."""
    return np.clip(np.floor((z - lowest) * 10 + 0.5), 0, 65535).astype("<u2")


def from_decimetres(units: np.ndarray, lowest: float) -> np.ndarray:
    return (lowest + units / 10).astype(np.float32)


def pack_bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask.astype(bool).ravel()).tobytes()


def unpack_bits(raw: bytes, cells: int) -> np.ndarray:
    if len(raw) != -(-cells // 8):
        raise ValueError(f"a mask of {cells} cells takes {-(-cells // 8)} bytes, found {len(raw)}")
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=cells).astype(bool)


def decode_heights(text: str, lowest: float, cells: int) -> np.ndarray:
    raw = base64.b64decode(text)
    if len(raw) != 2 * cells:
        raise ValueError(f"{cells} heights take {2 * cells} bytes, found {len(raw)}")
    return from_decimetres(np.frombuffer(raw, "<u2"), lowest)


def band_of(relief: float) -> int:
    """The code of a record's band by its whole relief in metres."""
    return 0 if relief < 30 else 1 if relief < 80 else 2


def encode_survey(records: list[dict], side: int = 256) -> bytes:
    """records: key, label, arch, group (code), wm, hm, emin, emax, waterpct, treepct, bbox, z, water, trees, holes (ref, par or None, pts)."""
    out = [SURVEY_MAGIC, struct.pack("<I", len(records))]
    for r in records:
        for name in ("key", "label", "arch"):
            raw = r[name].encode()
            out.append(struct.pack("<I", len(raw)) + raw)
        out.append(struct.pack("<B10d", r["group"], r["wm"], r["hm"], r["emin"], r["emax"], r["waterpct"], r["treepct"], *r["bbox"]))
        out += [to_decimetres(np.asarray(r["z"], float), r["emin"]).tobytes(), pack_bits(r["water"]), pack_bits(r["trees"])]
        if np.size(r["z"]) != side * side:
            raise ValueError(f"{r['key']}: the grid has {np.size(r['z'])} cells, not {side * side}")
        out.append(struct.pack("<I", len(r["holes"])))
        for ref, par, points in r["holes"]:
            out.append(struct.pack("<III", ref, 0 if par is None else par + 1, len(points)) + np.asarray(points, "<f8").tobytes())
    return b"".join(out)


def decode_survey(raw: bytes, side: int = 256) -> Iterator[dict]:
    """The records of a survey file, one at a time."""
    if raw[:8] != SURVEY_MAGIC:
        raise ValueError("not a survey file")
    at, cells = 12, side * side

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise ValueError("the survey file ends within a record")
        at += n
        return raw[at - n : at]

    def number() -> int:
        return struct.unpack("<I", take(4))[0]

    for _ in range(struct.unpack_from("<I", raw, 8)[0]):
        r = {name: take(number()).decode() for name in ("key", "label", "arch")}
        r["group"], *rest = struct.unpack("<B10d", take(81))
        if r["group"] >= len(BANDS):
            raise ValueError(f"{r['key']}: no band {r['group']}")
        r |= dict(zip(("wm", "hm", "emin", "emax", "waterpct", "treepct"), rest[:6], strict=True)) | {"bbox": rest[6:]}
        r["units"] = np.frombuffer(take(2 * cells), "<u2")
        r["z"] = from_decimetres(r["units"], r["emin"])
        r["water"], r["trees"] = (unpack_bits(take(-(-cells // 8)), cells) for _ in range(2))
        r["holes"] = []
        for _ in range(number()):
            ref, par, points = struct.unpack("<III", take(12))
            r["holes"].append((ref, par - 1 if par else None, np.frombuffer(take(16 * points), "<f8").reshape(-1, 2).tolist()))
        yield r
    if at != len(raw):
        raise ValueError(f"{len(raw) - at} bytes follow the last record")


def fingerprint(records: list[tuple[str, bytes]]) -> int:
    """FNV-1a over keys and their heights in decimetres, in order."""
    h = FNV_OFFSET
    for key, units in records:
        for b in key.encode() + units:
            h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def embedded_records(pages: DataFrame, marker: str = "window.COURSES=") -> DataFrame:
    """pages(html) -> (key, band, record...): the JSON map between a marker and the end of its script.

    Where a record has no group, its band is by its relief. Pages without the marker give no rows;
    a map that is no JSON fails the query when its rows are read.
    """
    inside = F.regexp_extract("html", rf"(?s)\Q{marker}\E\s*(.*?)\s*;?\s*</script>", 1)
    found = pages.select(inside.alias("json")).where("json <> ''")
    kept = found.select(F.explode(F.from_json("json", f"map<string, {RECORD}>", {"mode": "FAILFAST"})).alias("key", "r")).select("key", "r.*")
    relief = F.col("emax") - F.col("emin")
    return kept.withColumn("band", F.coalesce("group", F.when(relief < 30, BANDS[0]).when(relief < 80, BANDS[1]).otherwise(BANDS[2])))


def _file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.removeprefix("file:"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _GridReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        from pyarrow.fs import FileSelector

        fs, base = _file_system(self.path)
        return [_File(f.path) for f in sorted(fs.get_file_info(FileSelector(base)), key=lambda f: f.path) if f.path.endswith(".grid")]

    def read(self, partition: _File):
        fs, _ = _file_system(self.path)
        with fs.open_input_file(partition.path) as file:
            z, water, cell = decode_grid(file.read())
        yield partition.path.rsplit("/", 1)[-1].removesuffix(".grid"), z.shape[0], z.shape[1], cell, z.ravel().tolist(), water.ravel().tolist()


class _Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _GridWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> _Written:
        import uuid

        fs, base = _file_system(self.path)
        fs.create_dir(base, recursive=True)
        moves = []
        for row in rows:
            temporary = f"{base}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as file:
                file.write(encode_grid(np.array([np.nan if v is None else v for v in row.z], np.float32).reshape(row.ny, row.nx), np.array(row.water, bool).reshape(row.ny, row.nx), row.cell))
            moves.append((temporary, f"{base}/{row.name}.grid"))
        return _Written(moves)

    def commit(self, messages) -> None:
        # Only files of attempts that won get their names: repeated and lost tasks leave none.
        fs, _ = _file_system(self.path)
        for message in messages:
            for temporary, name in message.moves if message else []:
                fs.move(temporary, name)

    def abort(self, messages) -> None:
        fs, _ = _file_system(self.path)
        for message in messages:
            for temporary, _name in message.moves if message else []:
                fs.delete_file(temporary)


class GridFiles(DataSource):
    """spark.read.format("gridfile"): a row (name, ny, nx, cell, z, water) for each .grid file of a folder; writes likewise."""

    @classmethod
    def name(cls) -> str:
        return "gridfile"

    def schema(self) -> str:
        return GRID_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _GridReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _GridWriter(self.options["path"])
