import json
import sqlite3
import struct

import numpy as np
import pytest

from geofold import cli, reports
from geofold.operators import embed, metrics
from geofold.sources import config, discovery, geotiff, sinks, vector


def halves(n=32):
    return np.repeat(np.array([[1] * (n // 2) + [3] * (n // 2)], np.uint8), n, axis=0)


@pytest.mark.parametrize("dtype", [np.uint8, np.int16, np.float32])
def test_geotiff_round_trip(tmp_path, dtype):
    data = np.arange(3 * 20 * 30).reshape(3, 20, 30).astype(dtype)
    p = tmp_path / "a.tif"
    p.write_bytes(geotiff.encode(data, 100.0, 500.0, 10.0, 32610, 255, rows_per_strip=7))
    with open(p, "rb") as f:
        got, h = geotiff.read(f, [1, 3])
    assert (got == data[[0, 2]]).all() and h.bounds == (100.0, 300.0, 400.0, 500.0) and h.crs == "EPSG:32610" and h.nodata == 255


def test_lzw_and_packbits():
    assert geotiff._packbits(bytes([2, 1, 2, 3, 254, 9])) == b"\x01\x02\x03\x09\x09\x09"
    # clear, 7, 258 (7 7), 8, end: nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    raw = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert geotiff._lzw(raw) == bytes([7, 7, 7, 8])


def test_spark_source_and_metadata(spark, tmp_path):
    p = tmp_path / "r.tif"
    data = halves()
    data[0, 0] = 255
    p.write_bytes(geotiff.encode(data, 0.0, 320.0, 10.0, 32610, 255, rows_per_strip=8))
    geotiff.register(spark)
    df = spark.read.format("geotiff").option("blocksPerPartition", 1).load(str(p))
    assert df.count() == 1024 and df.where("v IS NULL").count() == 1 and df.rdd.getNumPartitions() == 4
    assert df.where("row = 31 AND col = 31").first()[1:] == (1, 31, 31, 315.0, 5.0, 3.0)
    part = spark.read.format("geotiff").option("blocksPerPartition", 1).load(str(p)).where("y BETWEEN 100 AND 180 AND col >= 3 AND band = 1")
    assert part.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert sorted(part.collect()) == sorted(df.where("band = 1").where("y BETWEEN 100 AND 180 AND col >= 3").collect())
    assert df.where("x < -1").count() == 0
    m = geotiff.metadata(spark, [str(p)]).first()
    assert (m["east"], m["width"], m["crs"]) == (320.0, 32, "EPSG:32610")
    assert geotiff.list_files(spark, str(tmp_path))[0].endswith("r.tif")
    px = df.selectExpr("row", "col", "cast(v as int) cls")
    chunk = geotiff.to_chunks(px, 16).where("chunk_row = 0 AND chunk_col = 0").first()["data"]
    assert len(chunk) == 256 and chunk[0] == 255 and chunk[1] == 1


def features():
    square = lambda x, y, d: [[[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]]
    return {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NAME": "left"}, "geometry": {"type": "Polygon", "coordinates": square(0, 0, 160)}},
        {"type": "Feature", "properties": {"NAME": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(0, 0, 20), square(200, 200, 20)]}},
    ]}


def write_points(path):
    pts = [(i * 10 + 5.0, 5.0 + 10 * (i % 32), "trees" if i < 12 else "Grass") for i in range(32)]
    path.write_text("longitude,Latitude,LC_CLASS\n" + "".join(f"{x},{y},{c}\n" for x, y, c in pts))


def test_vector_files(spark, tmp_path):
    (tmp_path / "z.geojson").write_text(json.dumps(features()))
    z = vector.zones(vector.read(spark, str(tmp_path / "z.geojson")), "NAME").collect()
    assert sorted((r["zone_id"], r["part"], len(r["xs"])) for r in z) == [("left", 0, 5), ("two", 0, 5), ("two", 1, 5)]
    with pytest.raises(ValueError):
        vector.zones(vector.read(spark, str(tmp_path / "z.geojson")), "nope")
    write_points(tmp_path / "p.csv")
    pts = vector.read(spark, str(tmp_path / "p.csv"))
    assert pts.count() == 32 and pts.first()["x"] == 5.0
    vector.write_geojson(pts.selectExpr("LC_CLASS", "x", "y"), f"{tmp_path}/out")
    assert vector.read_features(spark, f"{tmp_path}/out", "LC_CLASS string").count() == 32
    layers = vector.Layers(spark, [{"name": "a", "path": str(tmp_path / "z.geojson")}, {"name": "b", "path": "x", "enabled": False}])
    assert layers.summary()[0]["features"] == 2 and list(layers.load_all()) == ["a"]
    with pytest.raises(KeyError):
        layers.get("b")


def test_shapefile_and_geopackage(spark, tmp_path):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)]
    rec = struct.pack("<i4d2i", 5, 0, 0, 10, 10, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, len(rec) // 2) + rec)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15)
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 1, 32 + 32 + 1, 9) + bytes(20) + field + b"\r" + b" zone    "[:9])
    z = vector.zones(vector.read(spark, str(tmp_path / "a.shp")), "NAME").first()
    assert z["zone_id"] == "zone" and z["xs"] == [0.0, 10.0, 10.0, 0.0]
    with sqlite3.connect(tmp_path / "g.gpkg") as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('pts', 'geom')")
        db.execute("CREATE TABLE pts (fid INTEGER, geom BLOB, kind TEXT)")
        db.execute("INSERT INTO pts VALUES (1, ?, 'trees')", (b"GP\0\1" + struct.pack("<i", 0) + b"\1" + struct.pack("<I2d", 1, 3.0, 4.0),))
    db.close()
    r = vector.read(spark, str(tmp_path / "g.gpkg")).first()
    assert (r["kind"], r["x"], r["y"]) == ("trees", 3.0, 4.0)


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("project: {}\nexisting_models: {}\nprocessing: {device: cpu}\ntiles: {size: 256}\n")
    assert config.check(config.load(p)) == []
    bad = config.load(p, ["processing.device=tpu", "tiles.size=0", "tiles.overlap=-1", "gee_export.strategy=cloud", "class_schema.classes.x=1"])
    assert len(config.check(bad)) == 5 and len(config.check({})) == 3
    assert len(config.broken("weights", ([1.0, -1.0], 3))) == 3 and not config.broken("weights", ([1.0, 0.0], 2)) and config.broken("weights", ([], 0))
    assert not config.broken("model", "prithvi") and config.broken("classifier", "svm") and not config.broken("classifier", "xgboost") and not config.broken("classifier", "linear")
    assert config.broken("fusion", "x") and not config.broken("ensemble", "majority_vote")
    assert config.broken("raster", str(p)) and len(config.broken("vector", "/nope")) == 1 and "folder" in config.broken("vector", str(tmp_path))[0]
    for name in ("a.TIF", "b.geotiff", "c.img"):
        (tmp_path / name).write_bytes(b"")
    assert [bool(config.broken("raster", str(tmp_path / n))) for n in ("a.TIF", "b.geotiff", "c.img")] == [False, False, True]
    assert config.report([]) == "" and config.report(["a"]) == "1 problem: a" and config.report(["a", "b"], "warning") == "2 warnings: a; b"


def test_discovery(spark, tmp_path):
    for name, m in (("d_m_1", "test/iou: 0.48012\nnote: x\n"), ("d_m_2", None)):
        d = tmp_path / "experiments" / name
        (d / "checkpoints").mkdir(parents=True)
        (d / "config.yaml").write_text("model: {name: unet}\ndata: {data_csv: /x/rivers/all.csv}\n")
        if m:
            (d / "final_metrics.yaml").write_text(m)
            for c in ("epoch1.ckpt", "last.ckpt"):
                (d / "checkpoints" / c).write_bytes(b"x")
    (tmp_path / "experiments" / "empty").mkdir()
    (tmp_path / "log.csv").write_text("experiment_id,duration_minutes,num_epochs\nd_m_1,14.9,1.5\n,1,1\n")
    found = discovery.catalogue(discovery.experiments(spark, f"{tmp_path}/experiments"), discovery.log(spark, f"{tmp_path}/log.csv")).orderBy("experiment_id").collect()
    assert [r["experiment_id"] for r in found] == ["d_m_1", "d_m_2"]
    a = found[0]
    assert a["best_checkpoint"].endswith("last.ckpt") and a["dataset"] == "rivers" and a["encoder_name"] == "unknown"
    assert a["log"]["duration_minutes"] == 14.9 and a["log"]["num_epochs"] == 0 and found[1]["log"] is None
    assert discovery.complete(discovery.experiments(spark, f"{tmp_path}/experiments")).first()["metrics"] == {"test/iou": 0.4801}


def test_embedding_plugins(spark):
    for name in embed.available():
        m = embed.create(name)
        with pytest.raises(RuntimeError):
            m.embed(np.zeros((m.bands, m.size, m.size)))
        m.load()
        assert m.embed(np.zeros((2, m.bands, m.size, m.size), np.float32)).shape == (2, m.dim)
    with pytest.raises(KeyError):
        embed.create("nope")
    df = spark.createDataFrame([("a", [1.0] * 64), ("b", [1.0] * 5), ("c", None)], "tile_id string, data array<float>")
    out = {r["tile_id"]: r for r in embed.embed(df, embed.PatchProjection("s", 1, 8, 16, 4, 1), 1, 8, 8).collect()}
    assert len(out["a"]["embedding"]) == 16 and out["a"]["error"] is None and out["b"]["embedding"] is None and out["c"]["error"]


def test_commands(spark, tmp_path, capsys):
    for name, data in (("a", halves()), ("b", np.full((32, 32), 1, np.uint8))):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(data, 0.0, 320.0, 10.0, 32610, 255))
    (tmp_path / "z.geojson").write_text(json.dumps(features()))
    write_points(tmp_path / "p.csv")
    p = lambda n: str(tmp_path / n)

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr()

    code, out = run("assess-accuracy", p("a.tif"), p("p.csv"), p("acc"), "--report", p("r.html"))
    assert code == 0 and "accuracy 0.8750" in out.out and "<svg" in (tmp_path / "r.html").read_text()
    assert "50.0 %" in run("compare-models", p("a.tif"), p("b.tif"), p("cmp"))[1].out
    assert run("compare-accuracy", p("p.csv"), p("b.tif"), p("a.tif"))[1].out.startswith("1. a")
    assert run("zonal-stats", p("a.tif"), p("z.geojson"), p("zs"))[0] == 0
    assert spark.read.option("header", True).csv(p("zs")).where("zone_id = 'left'").first()["trees_pct"] == "100.0"
    assert "success" in run("process-by-focus", p("a.tif"), p("z.geojson"), p("pf"))[1].out
    assert run("ensemble", p("e"), p("a.tif"), p("b.tif"))[0] == 0
    assert sinks.read_raster(spark, p("e"), "classification", "cls").where("cls = 1").count() == 1024
    assert "refinement: 1024" in run("fuse-predictions", p("a.tif"), p("b.tif"), p("f"))[1].out
    assert run("ensemble", p("e"), p("a.tif"), "--weights", "1", "2")[0] == 1
    assert run("import-labels", p("p.csv"), p("lab"), "--field", "LC_CLASS")[0] == 0
    assert run("export-imagery")[0] == 1 and run("init", p("w"))[0] == 0


def test_reports(spark):
    cm = metrics.confusion(spark.createDataFrame([(0, 0), (0, 1), (9, 9)], "t int, p int"))
    html = reports.matrix(metrics.normalised(metrics.dense(cm)))
    assert html.count("<rect") == 9 and "class_9" in html
    assert "more than 1 rows" in reports.table(cm, 1)
