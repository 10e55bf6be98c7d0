"""GeoTIFF: a small codec (uncompressed strips), a Spark reader and a Spark data source.

Reading goes through Spark's binary files, so any store Spark reads will do. The data
source "geotiff" writes one file for each band with the data first and the directory
after it, one row for each strip, little-endian.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# TIFF sample formats by (kind, bits), and the sizes of TIFF field types.
DTYPES = {"Int16": "<i2", "Int32": "<i4", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}
DEPTHS = {1: "bits", 8: "<u1", 16: "<u2", 32: "<u4", -16: "<i2", -32: "<f4"}
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


@dataclass
class Georeference:
    """Origin of the top-left corner, pixel width, (negative) pixel height; keys of the coordinate system."""

    x: float = 0.0
    y: float = 0.0
    dx: float = 1.0
    dy: float = -1.0
    geokeys: dict[int, int | float | str] = field(default_factory=dict)

    def bounds(self, n_rows: int, n_cols: int) -> tuple[float, float, float, float]:
        """top, left, right, bottom."""
        return self.y, self.x, self.x + n_cols * self.dx, self.y + n_rows * self.dy


def pack_bits(a: np.ndarray) -> bytes:
    """Rows of 0 and 1, most significant bit first; the width must be a multiple of eight."""
    if a.shape[1] % 8:
        raise ValueError("the width of a one-bit image must be a multiple of 8")
    return np.packbits(a.astype(bool), axis=1).tobytes()


def _oriented(a: np.ndarray, orientation: int) -> np.ndarray:
    """The array as stored so that readers who honour the orientation see it upright."""
    if orientation >= 5:
        a = np.swapaxes(a, 0, 1)
        orientation = {5: 1, 6: 2, 7: 3, 8: 4}[orientation]
    if orientation in (2, 3):
        a = a[:, ::-1]
    if orientation in (3, 4):
        a = a[::-1]
    return a


def encode(data: np.ndarray, geo: Georeference | None = None, dtype: str | int = "Float32", nodata: float | None = None, orientation: int = 1, colormap: np.ndarray | None = None, nan_to: float | None = None) -> bytes:
    """A TIFF of (rows, cols) or (rows, cols, bands). dtype is a name of DTYPES or a bit depth of DEPTHS."""
    kinds = {**DTYPES, **DEPTHS}
    if dtype not in kinds:
        raise ValueError(f"unknown data type: {dtype}; known are {', '.join(map(str, kinds))}")
    a = np.asarray(data)
    a = a[:, :, None] if a.ndim == 2 else a
    if nan_to is not None:
        a = np.where(np.isnan(a), nan_to, a)
    a = _oriented(a, orientation)
    rows, cols, bands = a.shape
    bits = kinds[dtype] == "bits"
    if bits:
        body = pack_bits(a[:, :, 0])
        depth, fmt = 1, 1
    else:
        t = np.dtype(kinds[dtype])
        body = np.ascontiguousarray(a.astype(t)).tobytes()
        depth, fmt = t.itemsize * 8, {"u": 1, "i": 2, "f": 3}[t.kind]
    stride = len(body) // rows if rows else 0
    tags: list[tuple[int, int, list]] = [
        (256, 4, [cols]), (257, 4, [rows]), (258, 3, [depth] * bands), (259, 3, [1]), (262, 3, [3 if colormap is not None else 2 if bands == 3 and depth == 8 else 1]),
        (273, 4, [8 + i * stride for i in range(rows)]), (274, 3, [orientation]), (277, 3, [bands]), (278, 4, [1]), (279, 4, [stride] * rows), (284, 3, [1]), (339, 3, [fmt] * bands),
    ]
    if colormap is not None:
        tags.append((320, 3, (np.clip(np.asarray(colormap), 0, 1) * 65535).round().astype(int).T.ravel().tolist()))
    if geo is not None:
        tags += [(33550, 12, [geo.dx, -geo.dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, geo.x, geo.y, 0.0])]
        if geo.geokeys:
            head, doubles, text = [1, 1, 0, len(geo.geokeys)], [], ""
            for k, v in sorted(geo.geokeys.items()):
                if isinstance(v, str):
                    head += [k, 34737, len(v) + 1, len(text)]
                    text += v + "|"
                elif isinstance(v, float):
                    head += [k, 34736, 1, len(doubles)]
                    doubles.append(v)
                else:
                    head += [k, 0, 1, v]
            tags.append((34735, 3, head))
            if doubles:
                tags.append((34736, 12, doubles))
            if text:
                tags.append((34737, 2, [text.encode() + b"\0"]))
    if nodata is not None:
        tags.append((42113, 2, [f"{nodata:g}".encode() + b"\0"]))
    tags.sort(key=lambda t: t[0])
    at = 8 + len(body) + len(body) % 2
    extra, entries = b"", b""
    after = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = values[0] if kind == 2 else struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
        n = len(raw) if kind == 2 else len(values)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, n, after + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def decode(raw: bytes) -> tuple[np.ndarray, Georeference, float | None]:
    """(rows, cols, bands) upright, georeference and NoData value of an uncompressed TIFF of either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        size = _SIZE.get(kind, 1) * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
        tags[tag] = raw[where : where + size] if kind == 2 else list(struct.unpack_from(f"{order}{n}{_CODE[kind]}", raw, where)) if kind in _CODE else []
    if tags.get(259, [1])[0] != 1:
        raise ValueError("compressed TIFF files are not supported")
    cols, rows, bands, depth = tags[256][0], tags[257][0], tags.get(277, [1])[0], tags.get(258, [1])[0]
    body = b"".join(raw[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    if depth == 1:
        a = np.unpackbits(np.frombuffer(body, np.uint8).reshape(rows, -1), axis=1)[:, :cols, None]
    else:
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]]
        t = np.dtype(f"{order}{kind}{depth // 8}")
        a = np.frombuffer(body, t, rows * cols * bands).reshape(rows, cols, bands)
    a = _unoriented(a, tags.get(274, [1])[0])
    geo = Georeference()
    if 33550 in tags and 33922 in tags:
        sx, sy, _ = tags[33550][:3]
        i, j, _, x, y, _ = tags[33922][:6]
        geo = Georeference(x - i * sx, y + j * sy, sx, -sy)
    if 34735 in tags:
        keys = tags[34735]
        for k, where, n, v in zip(*[iter(keys[4:])] * 4, strict=True):
            geo.geokeys[k] = v if where == 0 else tags[34736][v] if where == 34736 else tags[34737][v : v + n].decode().rstrip("|\0")
    nodata = tags.get(42113)
    return a, geo, float(nodata.rstrip(b"\0 ")) if nodata else None


def _unoriented(a: np.ndarray, orientation: int) -> np.ndarray:
    if orientation >= 5:
        a = _unoriented(a, {5: 1, 6: 2, 7: 3, 8: 4}[orientation])
        return np.swapaxes(a, 0, 1)
    return _oriented(a, orientation)


def read(spark: SparkSession, paths: list[str] | str, columns: list[str] | None = None, inside: bool = False) -> DataFrame:
    """band (the file's stem), row, col, v (double) of every cell; with ``columns`` only these bands' files are opened.

    Only the first sample of each cell is read, as the maps have one band for each file.
    ``inside`` leaves out the cells that hold the NoData value the file names.
    """
    files = spark.read.format("binaryFile").load(paths)
    stem = F.regexp_extract("path", r"([^/]+)\.tiff?$", 1)
    if columns is not None:
        files = files.where(stem.isin(columns))

    return decoded(files.select(stem.alias("band"), "content"), inside)


def decoded(files: DataFrame, inside: bool = False) -> DataFrame:
    """band, row, col, v of rasters given as (band, content)."""

    def run(batches):
        for pdf in batches:
            for band, raw in zip(pdf["band"], pdf["content"], strict=True):
                a, _, nodata = decode(bytes(raw))
                for lo in range(0, a.shape[0], 256):  # strips of rows bound the batches
                    part = a[lo : lo + 256, :, 0].astype(float)
                    r, c = np.indices(part.shape)
                    cells = pd.DataFrame({"band": band, "row": r.ravel() + lo, "col": c.ravel(), "v": part.ravel()})
                    yield cells if not inside or nodata is None else cells[cells["v"].notna() if math.isnan(nodata) else cells["v"] != nodata]

    return files.mapInPandas(run, "band string, row long, col int, v double")


def metadata(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """band, n_rows, n_cols, top, left, right, bottom, nodata of each file."""
    files = spark.read.format("binaryFile").load(paths)
    return described(files.select(F.regexp_extract("path", r"([^/]+)\.tiff?$", 1).alias("band"), "content"))


def described(files: DataFrame) -> DataFrame:
    """metadata() of rasters given as (band, content)."""

    def one(batches):
        for pdf in batches:
            rows = []
            for band, raw in zip(pdf["band"], pdf["content"], strict=True):
                a, geo, nodata = decode(bytes(raw))
                rows.append((band, a.shape[0], a.shape[1], *geo.bounds(*a.shape[:2]), math.nan if nodata is None else nodata))
            yield pd.DataFrame(rows, columns=["band", "n_rows", "n_cols", "top", "left", "right", "bottom", "nodata"])

    return files.mapInPandas(one, "band string, n_rows int, n_cols int, top double, left double, right double, bottom double, nodata double")


def encoded(cells: DataFrame, geo: Georeference | None = None, dtype: str | int = "Float32", fill: float = 0.0, outside: float | None = None) -> DataFrame:
    """band and its TIFF bytes, one group for each raster (band, row, col, v).

    NaN and null become ``fill``; so do places of the rectangle that have no row, unless
    ``outside`` is given, which is then the NoData value that the file names.
    """
    if dtype not in {**DTYPES, **DEPTHS}:
        raise ValueError(f"unknown data type: {dtype}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), fill if outside is None else outside)
        a[pdf["row"], pdf["col"]] = pdf["v"].fillna(fill)
        return pd.DataFrame([(pdf["band"].iloc[0], encode(a, geo, dtype, outside))], columns=["band", "content"])

    return cells.groupBy("band").applyInPandas(one, "band string, content binary")


class GeoTiffSource(DataSource):
    """Sink for (band, content): df.write.format("geotiff").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "band string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = re.sub(r"^file:/+", "/", folder)

    def write(self, rows):
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        for row in rows:  # a name of its own first: a task that is tried again leaves no half file
            part = os.path.join(self.folder, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(bytes(row["content"]))
            os.replace(part, os.path.join(self.folder, f"{row['band']}.tif"))
        return WriterCommitMessage()


def write(cells: DataFrame, folder: str, geo: Georeference | None = None, dtype: str | int = "Float32", outside: float | None = None) -> None:
    """One file for each band of (band, row, col, v) in a folder that all executors mount."""
    cells.sparkSession.dataSource.register(GeoTiffSource)
    encoded(cells, geo, dtype, outside=outside).write.format("geotiff").mode("append").save(folder)
