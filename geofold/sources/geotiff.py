"""GeoTIFF reading and writing with numpy, and a Spark data source over it.

Reads little- and big-endian TIFF: strips or tiles, chunky or planar bands, no
compression, LZW, deflate or PackBits, horizontal differencing, integers and floats.
Bounds come from the model tags. The data source plans a partition for each run of
strips or tiles; bands that are not asked for and strips or tiles outside the bounds that
filters set on row, col, x and y are not decoded.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# TIFF tags and the sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
EXTENSIONS = (".tif", ".tiff", ".geotiff")


@dataclass
class Header:
    """What is known of a raster before its pixels are read."""

    width: int
    height: int
    bands: int
    dtype: str
    west: float
    north: float
    res_x: float
    res_y: float
    crs: str | None
    nodata: float | None
    tags: dict
    order: str

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.west, self.north - self.height * self.res_y, self.west + self.width * self.res_x, self.north


def read_header(f) -> Header:
    f.seek(0)
    head = f.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    f.seek(struct.unpack(order + "I", head[4:8])[0])
    n = struct.unpack(order + "H", f.read(2))[0]
    raw = f.read(12 * n)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", raw[12 * i : 12 * i + 8])
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * count
        data = raw[12 * i + 8 : 12 * i + 12]
        if size > 4:
            f.seek(struct.unpack(order + "I", data)[0])
            data = f.read(size)
        if kind == 2:
            tags[tag] = data[:count].rstrip(b"\0").decode("latin-1")
        else:
            tags[tag] = struct.unpack(order + code * count, data[:size])
    one = lambda t, d: tags[t][0] if t in tags else d
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    res_x, res_y = (tags[SCALE][0], abs(tags[SCALE][1])) if SCALE in tags else (1.0, 1.0)
    tie = tags.get(TIEPOINT, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (2048, 3072)), None)
    nodata = tags.get(NODATA)
    return Header(one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), f"{kind}{one(BITS, 8) // 8}", tie[3] - tie[0] * res_x, tie[4] + tie[1] * res_y, res_x, res_y, f"EPSG:{epsg}" if epsg else None, float(nodata) if nodata else None, tags, order)


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    out, table, bits, width, pos, prev = bytearray(), [], 0, 9, 0, None
    held = 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFFFF
        bits += 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 256:
                table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else prev + prev[:1]
            out += entry
            if prev is not None:
                table.append(prev + entry[:1])
                if len(table) + 1 >= 1 << width and width < 12:
                    width += 1
            prev = entry
        pos += 1
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def blocks(h: Header) -> list[tuple[int, int, int, int, int]]:
    """(index, band or -1, first row, first column, rows) of the strips or tiles."""
    tiled = TILES in h.tags
    bh = h.tags[TILE_H][0] if tiled else min(h.tags.get(ROWS, (h.height,))[0], h.height)
    bw = h.tags[TILE_W][0] if tiled else h.width
    planes = range(h.bands) if h.tags.get(PLANAR, (1,))[0] == 2 else (-1,)
    places = [(p, r, c) for p in planes for r in range(0, h.height, bh) for c in range(0, h.width, bw)]
    return [(i, p, r, c, bh) for i, (p, r, c) in enumerate(places)]


def read_block(f, h: Header, index: int) -> np.ndarray:
    """A strip or tile as (bands in it, rows, columns), its overhang included."""
    tiled = TILES in h.tags
    at, size = h.tags[TILES if tiled else STRIPS][index], h.tags[TILE_BYTES if tiled else STRIP_BYTES][index]
    f.seek(at)
    method = h.tags.get(COMPRESSION, (1,))[0]
    if method not in _UNPACK:
        raise ValueError(f"compression {method} is not supported")
    raw = _UNPACK[method](f.read(size))
    planar = h.tags.get(PLANAR, (1,))[0] == 2
    n = 1 if planar else h.bands
    w = h.tags[TILE_W][0] if tiled else h.width
    kind = np.dtype(h.order + h.dtype)
    x = np.frombuffer(raw, kind, len(raw) // kind.itemsize)
    x = x[: len(x) // (w * n) * w * n].reshape(-1, w, n)
    if h.tags.get(PREDICTOR, (1,))[0] == 2:
        x = np.cumsum(x, axis=1, dtype=x.dtype.newbyteorder("="))
    return x.transpose(2, 0, 1)


def read(f, bands: list[int] | None = None) -> tuple[np.ndarray, Header]:
    """(bands, height, width) of a file object; bands count from 1."""
    h = read_header(f)
    out = np.zeros((h.bands, h.height, h.width), h.dtype)
    for i, p, r, c, _ in blocks(h):
        x = read_block(f, h, i)
        rows, cols = min(x.shape[1], h.height - r), min(x.shape[2], h.width - c)
        out[(slice(None) if p < 0 else slice(p, p + 1)), r : r + rows, c : c + cols] = x[:, :rows, :cols]
    return (out if bands is None else out[[b - 1 for b in bands]]), h


def encode(data: np.ndarray, west: float, north: float, res: float, epsg: int | None = None, nodata: float | None = None, rows_per_strip: int = 256) -> bytes:
    """A deflate-compressed GeoTIFF of (height, width) or (bands, height, width)."""
    data = np.asarray(data)
    data = data[None] if data.ndim == 2 else data
    n, height, width = data.shape
    data = data.astype(data.dtype.newbyteorder("<"))
    strips = [zlib.compress(np.ascontiguousarray(data[b, r : r + rows_per_strip]).tobytes()) for b in range(n) for r in range(0, height, rows_per_strip)]
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    fields: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (data.dtype.itemsize * 8,) * n), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (STRIPS, 4, (0,) * len(strips)), (SAMPLES, 3, (n,)),
        (ROWS, 4, (rows_per_strip,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (2,)), (FORMAT, 3, (kind,) * n), (SCALE, 12, (res, res, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, west, north, 0.0)),
    ]
    if epsg:
        fields.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)))
    if nodata is not None:
        fields.append((NODATA, 2, f"{nodata:g}".encode() + b"\0"))
    fields.sort(key=lambda x: x[0])
    pack = lambda k, v: v if isinstance(v, bytes) else struct.pack("<" + TYPES[k] * len(v), *v)
    first = 8 + 2 + 12 * len(fields) + 4
    extra = sum((len(pack(k, v)) + 1) // 2 * 2 for _, k, v in fields if len(pack(k, v)) > 4)
    at = first + extra
    offsets = []
    for s in strips:
        offsets.append(at)
        at += len(s)
    out, tail = io.BytesIO(), b""
    out.write(b"II*\0" + struct.pack("<IH", 8, len(fields)))
    for tag, k, v in fields:
        raw = pack(k, tuple(offsets) if tag == STRIPS else v)
        out.write(struct.pack("<HHI", tag, k, len(v)))
        if len(raw) > 4:
            out.write(struct.pack("<I", first + len(tail)))
            tail += raw + b"\0" * (len(raw) % 2)
        else:
            out.write(raw.ljust(4, b"\0"))
    out.write(struct.pack("<I", 0) + tail + b"".join(strips))
    return out.getvalue()


SCHEMA = "path string, band int, row long, col long, x double, y double, v double"


class _Blocks(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))


class GeoTiffReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.run = int(options.get("blocksPerPartition", "64"))
        self.low, self.high = {}, {}

    def pushFilters(self, filters):
        """Keeps the bounds on row, col, x and y; every filter goes back to Spark, since bounds choose blocks and not pixels."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("row", "col", "x", "y"):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[name] = max(f.value, self.low.get(name, f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[name] = min(f.value, self.high.get(name, f.value))
            yield f

    def wanted(self, h: Header) -> list[tuple[int, int, int, int, int]]:
        """The blocks that reach into the bounds and hold an asked band."""
        wide = h.tags[TILE_W][0] if TILES in h.tags else h.width
        out = []
        for block in blocks(h):
            _, plane, r, c, high = block
            r1, c1 = min(r + high, h.height) - 1, min(c + wide, h.width) - 1
            spans = {"row": (r, r1), "col": (c, c1)}
            spans["x"] = tuple(sorted(h.west + (k + 0.5) * h.res_x for k in (c, c1)))
            spans["y"] = tuple(sorted(h.north - (k + 0.5) * h.res_y for k in (r, r1)))
            inside = all(hi >= self.low.get(k, hi) and lo <= self.high.get(k, lo) for k, (lo, hi) in spans.items())
            if inside and not (plane >= 0 and self.bands and plane + 1 not in self.bands):
                out.append(block)
        return out

    def partitions(self):
        out = []
        for p in self.paths:
            with _open(p) as f:
                n = len(self.wanted(read_header(f)))
            out += [_Blocks(p, i, min(n, i + self.run)) for i in range(0, n, self.run)]
        return out

    def read(self, partition):
        import pyarrow as pa

        if partition is None:  # what Spark passes where no block is wanted
            return
        path, first, last = partition.value
        with _open(path) as f:
            h = read_header(f)
            for i, p, r, c, _ in self.wanted(h)[first:last]:
                x = read_block(f, h, i)
                rows, cols = min(x.shape[1], h.height - r), min(x.shape[2], h.width - c)
                for b in range(x.shape[0]):
                    band = (p if p >= 0 else b) + 1
                    if self.bands and band not in self.bands:
                        continue
                    v = x[b, :rows, :cols].astype(float).ravel()
                    row, col = np.repeat(np.arange(r, r + rows), cols), np.tile(np.arange(c, c + cols), rows)
                    bad = np.isnan(v) if h.nodata is None else (v == h.nodata) | np.isnan(v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(v)), pa.array(np.full(len(v), band, np.int32)), pa.array(row), pa.array(col), pa.array(h.west + (col + 0.5) * h.res_x), pa.array(h.north - (row + 0.5) * h.res_y), pa.array(v, mask=bad)],
                        ["path", "band", "row", "col", "x", "y", "v"],
                    )


class GeoTiff(DataSource):
    """``spark.read.format("geotiff").load(path)``: a row per pixel and band, NULL for nodata. Options: bands, paths, blocksPerPartition."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GeoTiffReader(self.options)


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(at)


def register(spark: SparkSession) -> None:
    """Makes the source known; filters reach Python sources only where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.tif") -> list[str]:
    """Paths in order: by pattern, else all raster extensions."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path").collect()
    if not found:
        glob = "*{" + ",".join(EXTENSIONS) + "}"
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path").orderBy("path").collect()
    return [r["path"] for r in found]


META = "raster string, west double, south double, east double, north double, res_x double, res_y double, width int, height int, bands int, dtype string, crs string, nodata double"


def metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row of metadata per raster; pixels are not read."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with _open(p) as f:
                    h = read_header(f)
                rows.append((p, *h.bounds, h.res_x, h.res_y, h.width, h.height, h.bands, h.dtype, h.crs, h.nodata))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in META.split(", ")])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, META)


def to_chunks(pixels: DataFrame, size: int = 256) -> DataFrame:
    """(chunk_row, chunk_col, data): pixels (row, col, cls) packed in squares, 255 where there is none."""
    at = F.struct((F.col("row") % size * size + F.col("col") % size).cast("int").alias("i"), F.col("cls").cast("int").alias("v"))
    packed = pixels.groupBy(F.floor(F.col("row") / size).alias("chunk_row"), F.floor(F.col("col") / size).alias("chunk_col")).agg(F.map_from_entries(F.collect_list(at)).alias("m"))  # size * size entries at most
    return packed.select("chunk_row", "chunk_col", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(255)).cast("short")).alias("data"))
