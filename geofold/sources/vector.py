"""Vector files: CSV and GeoJSON through Spark, shapefiles and GeoPackages by small readers."""

from __future__ import annotations

import json
import sqlite3
import struct
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LON, LAT = ("lon", "longitude", "x", "lng"), ("lat", "latitude", "y")
GEOJSON = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def _pick(columns: list[str], names: tuple[str, ...]) -> str:
    for n in names:
        for c in columns:
            if c.lower() == n:
                return c
    raise ValueError(f"no coordinate column among {columns}; one of {', '.join(names)} is needed")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of a CSV: all columns as text, and x and y as numbers."""
    df = spark.read.option("header", True).csv(path)
    x, y = F.expr(f"try_cast(`{_pick(df.columns, LON)}` AS DOUBLE)"), F.expr(f"try_cast(`{_pick(df.columns, LAT)}` AS DOUBLE)")
    rest = [F.col(c) for c in df.columns if c not in ("x", "y")]
    return df.select(*rest, x.alias("x"), y.alias("y"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features: properties as columns, point coordinates as x and y, polygons as parts (part, xs, ys of outer rings)."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    feats = raw.select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    keys = sorted(r[0] for r in feats.select(F.explode(F.map_keys("properties"))).distinct().collect())  # a column each
    props = [F.try_element_at("properties", F.lit(k)).alias(k) for k in keys if k not in ("x", "y")]
    point = F.from_json("coordinates", "array<double>")
    rings = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    outer = F.transform(rings, lambda p: F.struct(F.transform(p[0], lambda c: c[0]).alias("xs"), F.transform(p[0], lambda c: c[1]).alias("ys")))
    is_point = F.col("type") == "Point"
    return feats.select(*props, F.when(is_point, F.get(point, 0)).alias("x"), F.when(is_point, F.get(point, 1)).alias("y"), outer.alias("parts"))


def zones(features: DataFrame, id_field: str) -> DataFrame:
    """(zone_id, part, xs, ys) of polygon features; an error if the id is missing."""
    if id_field not in features.columns:
        raise ValueError(f"no column {id_field!r} in {features.columns}")
    return features.where("parts IS NOT NULL").select(F.col(id_field).alias("zone_id"), F.posexplode("parts").alias("part", "p")).select("zone_id", "part", "p.xs", "p.ys")


def write_geojson(points: DataFrame, folder: str) -> None:
    """Points (x, y, properties) as files of GeoJSON features, one a line, written by the executors."""
    props = [c for c in points.columns if c not in ("x", "y")]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    points.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(folder)


def read_features(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What ``write_geojson`` wrote; ``schema`` names the properties."""
    full = f"properties struct<{schema}>, geometry struct<coordinates:array<double>>"
    return spark.read.schema(full).json(folder).select("properties.*", F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"))


def parse_shp(data: bytes) -> list[tuple]:
    """Points (x, y) or polygons [(xs, ys)] of a shapefile, in record order; null shapes are None."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        rec = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", rec[:4])[0]
        if kind in (1, 11, 21):
            out.append(struct.unpack("<2d", rec[4:20]))
        elif kind in (5, 15, 25):
            n_parts, n = struct.unpack("<2i", rec[36:44])
            first = [*struct.unpack(f"<{n_parts}i", rec[44 : 44 + 4 * n_parts]), n]
            xy = struct.unpack(f"<{2 * n}d", rec[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
            out.append([(list(xy[2 * a : 2 * b : 2]), list(xy[2 * a + 1 : 2 * b : 2])) for a, b in zip(first[:-1], first[1:])])
        else:
            out.append(None)
        at += 8 + size
    return out


def parse_dbf(data: bytes) -> list[dict[str, str]]:
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        pos, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = data[pos : pos + width].decode("utf-8", "replace").strip()
            pos += width
        rows.append(row)
    return rows


def parse_wkb(b: bytes):
    """A point (x, y) or polygons [(xs, ys)] of a GeoPackage geometry blob; its outer rings."""
    skip = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[b[3] >> 1 & 7] + 8 if b[:2] == b"GP" else 0
    pos = skip

    def take(code):
        nonlocal pos
        size = struct.calcsize(order + code)
        pos += size
        return struct.unpack(order + code, b[pos - size : pos])

    def shape():
        nonlocal pos, order
        order = "<" if b[pos] else ">"
        pos += 1
        kind = take("I")[0] % 1000
        if kind == 1:
            return take("2d")
        if kind == 3:
            rings = []
            for _ in range(take("I")[0]):
                n = take("I")[0]
                xy = take(f"{2 * n}d")
                rings.append((list(xy[::2]), list(xy[1::2])))
            return rings[:1]
        return [p for _ in range(take("I")[0]) for p in shape()]

    order = "<"
    return shape()


def parse_gpkg(path: str) -> list[tuple[dict, object]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        db.row_factory = sqlite3.Row
        table, column = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchone()
        rows = db.execute(f'SELECT * FROM "{table}"').fetchall()
    return [({k: str(r[k]) for k in r.keys() if k != column and r[k] is not None}, parse_wkb(r[column])) for r in rows]


def _feature(props: dict, shape):
    if isinstance(shape, tuple):
        return {"properties": props, "x": shape[0], "y": shape[1], "parts": None}
    return {"properties": props, "x": None, "y": None, "parts": None if shape is None else [{"xs": xs, "ys": ys} for xs, ys in shape]}


FEATURES = "properties map<string,string>, x double, y double, parts array<struct<xs:array<double>,ys:array<double>>>"


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Features of shapefiles (.shp with the .dbf beside it) or GeoPackages: one file is read by one task."""
    suffix = Path(path).suffix.lower()
    main = spark.read.format("binaryFile").load(path).select("content")
    side = spark.read.format("binaryFile").load(path[: -len(suffix)] + ".dbf").select(F.col("content").alias("side")) if suffix == ".shp" else spark.createDataFrame([(None,)], "side binary")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content, attrs in zip(pdf["content"], pdf["side"]):
                if suffix == ".shp":
                    rows = [_feature(p, s) for p, s in zip(parse_dbf(attrs), parse_shp(content))]
                else:
                    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
                        f.write(content)
                        f.flush()
                        rows = [_feature(p, s) for p, s in parse_gpkg(f.name)]
                yield pd.DataFrame(rows, columns=["properties", "x", "y", "parts"])

    feats = main.crossJoin(side).mapInPandas(run, FEATURES)  # one row by one row
    keys = sorted(r[0] for r in feats.select(F.explode(F.map_keys("properties"))).distinct().collect())
    return feats.select(*[F.try_element_at("properties", F.lit(k)).alias(k) for k in keys if k not in ("x", "y")], "x", "y", "parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: CSV, GeoJSON, shapefile or GeoPackage."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix in (".geojson", ".json"):
        return read_geojson(spark, path)
    if suffix in (".shp", ".gpkg"):
        return read_binary(spark, path)
    raise ValueError(f"{suffix or path}: not a known vector format")


class Layers:
    """Named zone layers; those switched off are left out."""

    def __init__(self, spark: SparkSession, config: list[dict] | None = None):
        self.spark, self.known, self.loaded = spark, {}, {}
        for c in config or []:
            if c.get("enabled", True):
                self.add(c["name"], c["path"], c.get("id_field", "NAME"))

    def add(self, name: str, path: str, id_field: str = "NAME") -> None:
        self.known[name] = (path, id_field)

    def get(self, name: str) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"unknown layer {name!r}; one of {', '.join(sorted(self.known))}")
        if name not in self.loaded:
            path, id_field = self.known[name]
            self.loaded[name] = zones(read(self.spark, path), id_field)
            self.loaded[name].createOrReplaceTempView(f"layer_{name}")
        return self.loaded[name]

    def load_all(self) -> dict[str, DataFrame]:
        return {n: self.get(n) for n in sorted(self.known)}

    def summary(self, first: int = 10) -> list[dict]:
        out = []
        for n in sorted(self.known):
            z = self.get(n).select("zone_id").distinct()
            out.append({"name": n, "path": self.known[n][0], "features": z.count(), "first": [r[0] for r in z.orderBy("zone_id").limit(first).collect()]})
        return out


def dumps(obj) -> str:
    return json.dumps(obj, indent=2, sort_keys=True, default=str)
