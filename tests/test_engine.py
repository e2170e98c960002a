"""Goldens of the operators on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.functions import classes, geo, votes
from geofold.operators import agreement, errors, grid, labels, metrics, preprocess, tiles, zonal


def one(df):
    return df.first().asDict()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def raster(spark, rows, name="cls"):
    return frame(spark, [(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], f"row long, col long, {name} int")


def test_accuracy_of_known_vectors(spark):
    pairs = frame(spark, list(zip([0, 1, 2, 0, 1, 2, 0, 1], [0, 1, 2, 0, 2, 2, 1, 1])), "t int, p int")
    m = one(metrics.overall(metrics.confusion(pairs)))
    assert m["accuracy"] == 0.75 and m["kappa"] == pytest.approx(0.627907, abs=1e-6)
    iou = {r["k"]: r["iou"] for r in metrics.per_class(metrics.confusion(frame(spark, list(zip([0, 0, 1, 1, 2, 2], [0, 0, 1, 0, 2, 2])), "t int, p int"))).collect()}
    assert iou[0] == pytest.approx(2 / 3) and iou[2] == 1


def test_one_class_has_no_kappa_and_no_points_no_rows(spark):
    m = one(metrics.overall(metrics.confusion(frame(spark, [(1, 1)] * 4, "t int, p int"))))
    assert m["accuracy"] == 1 and m["kappa"] is None
    assert metrics.overall(metrics.confusion(frame(spark, [], "t int, p int"))).where("n IS NOT NULL").count() == 0


def test_dense_matrix_and_warnings(spark):
    cm = metrics.confusion(frame(spark, [(0, 1), (0, 0), (2, 0)], "t int, p int"))
    assert metrics.dense(cm).count() == 9
    assert {r["class"] for r in metrics.small_samples(cm).collect()} == {"water", "shrub"}


def test_reference_labels_by_name_or_index(spark):
    rows = frame(spark, [(" WATER ", None), (None, 3), ("cloud", None), (None, None), ("x", 9)], "s string, i int")
    assert [r[0] for r in rows.select(classes.reference_class("s", "i")).collect()] == [0, 3, None, None, 9]


@pytest.mark.parametrize("votes_in,cls,share", [((1, 1, 2), 1, 2 / 3), ((2, 1, 0), 0, 1 / 3), ((None, 1, 1), None, 0.0), ((9, 9, 9), 0, 0.0)])
def test_majority(spark, votes_in, cls, share):
    c, s = votes.majority(["a", "b", "c"])
    r = frame(spark, [votes_in], "a int, b int, c int").select(c, s).first()
    assert r[0] == cls and r[1] == pytest.approx(share)


def test_weighted_minority_wins(spark):
    c, s = votes.weighted(["a", "b", "c"], {"a": 0.2, "b": 0.2, "c": 0.8})
    assert frame(spark, [(1, 1, 2)], "a int, b int, c int").select(c).first()[0] == 2
    with pytest.raises(ValueError):
        votes.weighted([], None)


def test_probabilities_and_entropy(spark):
    df = frame(spark, [([0.9, 0.1], [0.1, 0.9]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    p = df.select(votes.average(["a", "b"]).alias("p")).select("p", votes.entropy("p").alias("u"), votes.argmax(F.col("p")).alias("c")).collect()
    assert p[0]["p"] == pytest.approx([0.5, 0.5]) and p[0]["u"] == pytest.approx(1) and p[0]["c"] == 0
    assert p[1]["u"] == 0


def test_fusion_rules(spark):
    nan = float("nan")
    df = frame(spark, [(1, 2, 0.9), (1, 2, 0.1), (None, 2, 0.1), (1, None, 0.9), (None, None, 0.9), (1, 2, nan), (1, 2, None)], "b int, r int, c double")
    high = [tuple(x) for x in df.select(*votes.fuse_high_res("b", "r", "c")).collect()]
    conf = [tuple(x) for x in df.select(*votes.fuse_confidence("b", "r", "c")).collect()]
    assert high == [(2, 2), (1, 1), (2, 2), (1, 1), (None, 0), (2, 2), (1, 1)]
    assert conf == [(2, 2), (1, 1), (2, 2), (1, 1), (None, 0), (1, 1), (1, 1)]


def test_agreement(spark):
    pairs = agreement.paired(raster(spark, [[1, 1], [2, 2]]), raster(spark, [[1, 2], [2, 1], [5, 5]]))
    assert one(agreement.agreement(pairs)) == {"valid_pixels": 4, "agreement_pct": 50.0}
    assert [r["agree"] for r in agreement.agreement_map(pairs).orderBy("row", "col").collect()] == [1, 0, 1, 0]
    assert one(agreement.agreement(pairs.limit(0))) == {"valid_pixels": 0, "agreement_pct": 0.0}
    with pytest.raises(ValueError):
        agreement.pairwise(pairs, ["a"])


def georaster(spark, rows, res=10.0):
    h = len(rows)
    return raster(spark, rows).withColumn("x", (F.col("col") + 0.5) * res).withColumn("y", (h - F.col("row") - 0.5) * res)


def test_zones(spark):
    px = georaster(spark, [[1] * 5 + [3] * 5 for _ in range(10)])
    zones = frame(spark, [("all", 0.0, 0.0, 100.0, 100.0), ("away", 500.0, 500.0, 600.0, 600.0)], "zone_id string, west double, south double, east double, north double")
    inside = zonal.in_zones(px, zones)
    stats = {r["class"]: r for r in zonal.zone_stats(inside, zones, 10.0).collect()}
    assert stats["trees"]["percentage"] == 50 and stats["grass"]["n"] == 50 and stats["trees"]["area_sq_m"] == 5000
    totals = {r["zone_id"]: r for r in zonal.zone_totals(inside, zones).collect()}
    assert totals["all"]["dominant_class"] == "trees" and totals["away"]["valid_pixels"] == 0 and totals["away"]["dominant_class"] is None
    assert {r["zone_id"]: r["status"] for r in zonal.coverage(inside, zones, px).collect()} == {"all": "success", "away": "failed"}
    poly = frame(spark, [("t", 0, [0.0, 100.0, 0.0], [0.0, 0.0, 100.0])], "zone_id string, part int, xs array<double>, ys array<double>")
    assert zonal.in_zones(px, poly).count() == 45
    assert zonal.in_zones(px, poly, block=17.0).count() == 45  # whatever the blocks
    wide = one(zonal.pivoted(zonal.zone_stats(inside, zones, 10.0)))
    assert wide["trees_pct"] == 50 and wide["water_pct"] == 0


def test_errors(spark):
    rows = [(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)] * 7
    pairs = frame(spark, [(i, t, p) for i, (t, p) in enumerate(rows)], "point_id long, t int, p int")
    per = {r["class"]: r for r in errors.omission_commission(metrics.per_class(metrics.confusion(pairs))).collect()}
    assert per["water"]["omission"] == 2 and per["trees"]["commission"] == 2
    assert one(errors.summary(pairs)) == {"n_points": 20, "n_errors": 5, "error_rate": 0.25}
    assert [tuple(r) for r in errors.top_confusions(pairs).collect()] == [("trees -> water", 3), ("water -> trees", 2)]
    assert one(errors.asymmetry(metrics.confusion(pairs)))["ratio"] == 1.5
    assert one(errors.summary(pairs.limit(0)))["error_rate"] == 0


def test_density_and_hotspots(spark):
    pts = [(1.0, 1.0, 1)] * 4 + [(95.0, 95.0, 0)] * 4 + [(100.0, 100.0, 0)]
    cells = errors.density(frame(spark, pts, "x double, y double, is_error int"), 0.0, 0.0, 100.0, 100.0)
    assert [tuple(r) for r in cells.orderBy("row").collect()] == [(0, 0, 4, 4, 1.0), (9, 9, 5, 0, 0.0)]
    assert one(errors.hotspots(cells))["row"] == 0 and errors.hotspots(cells).count() == 1


def test_edges(spark):
    px = raster(spark, [[0] * 16 + [1] * 16 for _ in range(32)])
    assert errors.edges(px).where("edge").count() == 64
    assert errors.edges(raster(spark, [[2] * 5] * 5)).where("edge").count() == 0
    rng = random.Random(4)
    grid = [[rng.choice([0, 1, 1, 1, None]) for _ in range(23)] for _ in range(19)]
    for size, block in ((3, 128), (3, 4), (5, 4), (5, 3)):  # squares smaller than the raster, and little larger than the window
        got = {(r["row"], r["col"]): r["edge"] for r in errors.edges(raster(spark, grid), size=size, block=block).collect()}
        p = size // 2
        near = lambda i, j: {grid[a][b] for a in range(max(0, i - p), min(19, i + p + 1)) for b in range(max(0, j - p), min(23, j + p + 1))}  # noqa: B023, E731
        assert got == {(i, j): len(near(i, j) - {None}) > 1 for i in range(19) for j in range(23) if grid[i][j] is not None}


def test_grid_and_mosaic(spark):
    g = grid.tile_grid(spark, 500000.0, 5200000.0, 510000.0, 5210000.0, 10.0, 256)
    assert g.count() == 16 and g.orderBy("row", "col").first()["tile_id"] == "tile_0000_0000"
    px = frame(spark, [(0, 0, 0, None), (1, 0, 0, 4), (2, 0, 0, 5), (0, 0, 1, 1)], "rank int, row long, col long, cls int")
    assert {(r["row"], r["col"]): r["cls"] for r in grid.mosaic(px).collect()} == {(0, 0): 4, (0, 1): 1}


def test_extents_and_alignment(spark):
    meta = frame(spark, [("a", 0.0, 0.0, 320.0, 320.0, 10.0, 10.0, "EPSG:32610"), ("b", 160.0, 160.0, 480.0, 480.0, 5.0, 5.0, "EPSG:32610")], "raster string, west double, south double, east double, north double, res_x double, res_y double, crs string")
    e = one(grid.extent(meta))
    assert (e["west"], e["south"], e["east"], e["north"], e["res"]) == (160, 160, 320, 320, 5)
    assert one(grid.extent(meta, "union"))["east"] == 480
    out = grid.align({"a": raster(spark, [[1] * 32] * 32), "b": raster(spark, [[2] * 64] * 64)}, meta)
    assert out.count() == 32 * 32 and out.where("a = 1 AND b = 2").count() == 32 * 32
    assert grid.shape(0, 0, 25, 35, 10) == (4, 2)  # halves go to the even number
    with pytest.raises(ValueError):
        grid.align({}, meta.withColumn("west", F.lit(1000.0)))


def test_resampling_keeps_planes(spark):
    src = frame(spark, [(r, c, float(c)) for r in range(8) for c in range(8)], "row long, col long, v double")
    cells = grid.target(spark, 20.0, 20.0, 60.0, 60.0, 4.0)
    for method in ("bilinear", "cubic"):
        bad = grid.resample(src, cells, 0.0, 80.0, 10.0, "v", method).join(cells, ["row", "col"]).where(F.abs(F.col("v") - (F.col("x") / 10 - 0.5)) > 1e-9)
        assert bad.count() == 0


def test_label_rules(spark):
    rows = frame(spark, [(1, "Forest"), (2, "forest"), (3, " wAtEr "), (4, "urban"), (5, "built_up"), (6, None)], "point_id long, land_cover string")
    assert {r["point_id"]: r["lc_name"] for r in labels.imported(rows, "land_cover", "f").collect()} == {1: "trees", 3: "water", 5: "built"}
    assert labels.imported(rows, "land_cover", "f", {"urban": "built"}).count() == 4
    with pytest.raises(ValueError):
        labels.imported(rows, "nope", "f")


def test_thinning_keeps_the_first(spark):
    pts = frame(spark, [(i, float(x), 0.0) for i, x in enumerate([0, 4, 8, 12, 100, 103])], "point_id long, x double, y double")
    assert sorted(r["point_id"] for r in labels.thin(pts, 5.0).collect()) == [0, 2, 4]
    rows = sorted((r["a"], r["b"]) for r in labels.duplicate_pairs(pts, 5.0).collect())
    assert rows == [(0, 1), (1, 2), (2, 3), (4, 5)]


def test_thinning_of_crowds_lists_no_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all pairs of a crowd")

    monkeypatch.setattr(labels, "duplicate_pairs", refuse)
    draw = random.Random(5)
    pts = [(i, draw.choice([float(draw.randrange(-9, 9)), draw.uniform(-30, 30)]), draw.uniform(-8, 8)) for i in draw.sample(range(4, 9000), 3000)]
    pts += [(9000 + i, 100.0 + 2 * i, 0.0) for i in range(12)]  # a chain: each is decided by the one before
    want = []
    for i, x, y in sorted(pts):
        if all((x - u) * (x - u) + (y - v) * (y - v) >= 9.0 for _, u, v in want):
            want.append((i, x, y))
    odd = [(1, None, 0.0), (2, float("nan"), 0.0), (None, 0.0, 0.0), (3, float("inf"), 0.0)]
    df = frame(spark, pts + odd, "point_id long, x double, y double")
    got = [tuple(r) for r in labels.thin(df, 3.0).collect()]
    assert sorted(r for r in got if r[0] not in (1, 2, 3, None)) == want
    assert len(got) == len(want) + len(odd)
    assert labels.thin(df, 0.0).count() == len(pts) + len(odd)


def test_mean_confidence_is_the_same_in_any_order(spark):
    values = [0.93, 0.51, 0.2, 0.16]  # 0.45 on average; summed as doubles in this order less, in the other not
    for rows in (values, values[::-1]):
        obs = frame(spark, [(1, 0.0, 0.0, 1, p) for p in rows], "px long, x double, y double, label int, p double").withColumn("q", F.lit(0.1)).coalesce(1)
        assert [r["confidence"] for r in labels.dynamic_world(obs, ["p", "q"], 9, 0.45).collect()] == [0.45]
    odd = frame(spark, [(1, 0.0, 0.0, 1, float("nan")), (1, 0.0, 0.0, 1, 0.5), (2, 0.0, 0.0, 1, None), (3, 0.0, 0.0, 1, 0.75), (3, 0.0, 0.0, 1, None)], "px long, x double, y double, label int, p double")
    got = {r["px"]: r["confidence"] for r in labels.dynamic_world(odd.withColumn("q", F.lit(0.1)), ["p", "q"], 9, 0.45).collect()}
    assert got.pop(1) != 0.5 and got == {3: 0.75}


def test_validation_issues(spark):
    pts = frame(spark, [(1, 0.0, 0.0, "water", 0), (2, 1.0, 1.0, "water", 0)], "point_id long, x double, y double, lc_name string, lc_class int")
    issues = [r["issue"] for r in labels.validate(pts, (0.0, 0.0, 9.0, 9.0)).orderBy("pos").collect()]
    assert issues == ["1 points are outside the AOI", "1 potential duplicates (within 5.0m)", "Class 'water' has only 2 points (min: 20)"]
    assert labels.validate(pts.limit(0)).first()["issue"].startswith("No valid")


def test_split_and_folds(spark):
    pts = frame(spark, [(i, i % 7) for i in range(175)], "point_id long, lc_class int")
    s = labels.split(pts, 0.2).groupBy("lc_class", "part").count().collect()
    assert {(r["part"], r["count"]) for r in s} == {("train", 20), ("val", 5)}
    assert labels.split(pts.where("point_id < 7"), 0.9).where("part = 'train'").count() == 7
    f = labels.folds(pts, 5, "lc_class", id_col="point_id").groupBy("fold").count().collect()
    assert {r["count"] for r in f} == {35}


def test_preprocessing(spark):
    nan = float("nan")
    rows = [("t", b, r, c, float(10 * r + c)) for b in ("B2", "B3") for r in range(2) for c in range(2)]
    rows[3] = ("t", "B2", 1, 1, nan)
    px = preprocess.masked(frame(spark, rows, "tile_id string, band string, row long, col long, v double"), -1.0)
    assert px.where("NOT valid").count() == 2
    big = preprocess.resized(px, 2, 2, 5)
    assert big.count() == 50 and big.where("band = 'B3' AND row = 2 AND col = 4").first()["v"] == 1.0
    f = preprocess.filled(preprocess.normalised(px, ["B2", "B3"], [1.0, 0.0], [2.0, 0.0]))
    got = {(r["band"], r["row"], r["col"]): r["v"] for r in f.collect()}
    assert got[("B2", 1, 0)] == 4.5 and got[("B3", 1, 0)] == 10 and got[("B2", 1, 1)] == pytest.approx((-0.5 + 0 + 4.5) / 3)
    assert preprocess.band_indices(["B4", "B2", "Z"], ["red B4", None, "x"]) == [1, 1, 3]


def test_tiles(spark, tmp_path):
    log = frame(spark, [(1, "a", "pending", "2024-01-01"), (2, "a", "failed", "2024-01-02"), (3, "b", "odd", "2024-01-01")], "event_id long, tile_id string, status string, ts string")
    assert {r["tile_id"]: r["status"] for r in tiles.latest(log).collect()} == {"a": "failed", "b": "odd"}
    assert tiles.checked(log).count() == 1
    p = {r["status"]: r["n"] for r in tiles.progress(tiles.latest(log)).collect()}
    assert p["failed"] == 1 and p["pending"] == 0 and p["total"] == 2
    todo = frame(spark, [(str(i),) for i in range(5)], "tile_id string")
    seen = []

    def work(t):
        seen.append(sorted(r[0] for r in t.collect()))
        bad = len(seen) == 1
        return t.select("tile_id", F.lit(1.0).alias("embedding"), F.when(F.lit(bad) & (F.col("tile_id") == "3"), "broken").alias("error"))

    for _ in range(3):
        tiles.run_batches(spark, todo, f"{tmp_path}/p", work, f"{tmp_path}/o")
    assert seen == [["0", "1", "2", "3", "4"], ["3"], []]
    assert spark.read.parquet(f"{tmp_path}/o").count() == 5


def test_coordinates(spark):
    df = frame(spark, [(-122.4194, 37.7749), (-123.0, 0.0)], "lon double, lat double")
    x, y = geo.to_utm("lon", "lat", 10)
    a, b = df.select(x.alias("x"), y.alias("y")).collect()
    assert (a["x"], a["y"]) == (pytest.approx(551130.8, abs=1), pytest.approx(4180998.9, abs=1))
    assert (b["x"], b["y"]) == (pytest.approx(500000, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert df.select(geo.utm_zone("lon", "lat")).first()[0] == "EPSG:32610"
    assert df.select(geo.parent_name(F.lit("/a/b/c.csv")), geo.parent_name(F.lit("c.csv"))).first()[:] == ("b", "unknown")


def test_package_is_sent_once_and_only_where_needed(monkeypatch):
    import types
    import zipfile
    from pathlib import Path

    from geofold import session

    sent = []
    fake = types.SimpleNamespace(sparkContext=types.SimpleNamespace(applicationId="test-app", addPyFile=sent.append))
    monkeypatch.setenv("PYTHONPATH", str(Path(session.__file__).resolve().parents[1]))
    session.ship(fake)
    assert sent == []
    monkeypatch.setenv("PYTHONPATH", "/nowhere")
    session.ship(fake)
    session.ship(fake)
    assert len(sent) == 1 and "geofold/session.py" in zipfile.ZipFile(sent[0]).namelist()


def test_products_squares_and_zone_unions(spark, tmp_path):
    from geofold.functions import classes
    from geofold.operators import grid, tiles, zonal
    from geofold.sources import geotiff, sinks

    tiles_at = spark.createDataFrame([("a", 1, 0, 0), ("b", 2, 0, 200)], "tile_id string, rank int, row0 long, col0 long")
    probs = spark.createDataFrame([("a", [0.1, 0.9]), ("b", [0.6, 0.4])], "tile_id string, probs array<double>")
    made = grid.products(grid.paint(probs, tiles_at, 300), 3).persist()
    sinks.products(made, str(tmp_path / "m"), 1000.0, 2000.0, 10.0, {"kind": "test"})
    got = {(r["row"], r["col"]): (r["cls"], r["confidence"], r["probs"]) for r in made.where("row = 0").collect()}
    assert got[(0, 299)] == (1, 0.9, [0.1, 0.9, 0.0]) and got[(0, 300)] == (0, 0.6, [0.6, 0.4, 0.0])
    files = sorted((tmp_path / "m/geotiff/classification").glob("*.tif"))
    assert [f.name for f in files] == [f"{i:06d}_{j:06d}.tif" for i in (0, 1) for j in (0, 1)]
    with open(files[1], "rb") as f:
        data, head = geotiff.read(f)
    assert head.bounds[0] == 1000 + 2560 and data[0][0][0] == 1 and data[0][0][60] == 0 and data[0][0][250] == 255
    with open(tmp_path / "m/geotiff/confidence/000000_000001.tif", "rb") as f:
        data, _ = geotiff.read(f)
    assert data[0][0][0] == np.float32(0.9) and data[0][0][250] == -1
    assert tiles.clear(spark, str(tmp_path / "m/geotiff")) and not tiles.clear(spark, str(tmp_path / "m/geotiff"))
    zones = spark.createDataFrame([("z", 1, [5.0, 6.0, 6.0], [0.0, 0.0, 1.0]), ("z", 0, [0.0, 1.0, 1.0], [0.0, 0.0, 9.0])], "zone_id string, part int, xs array<double>, ys array<double>")
    one = zonal.zone_union(zones).first()
    assert (one["west"], one["south"], one["east"], one["north"]) == (0, 0, 6, 9) and [r[0]["x"] for r in one["rings"]] == [0.0, 5.0]
    assert spark.range(3).select(classes.class_name("id", {"sea": 2}).alias("n")).collect()[2]["n"] == "sea"


def test_ranks_are_those_of_one_sort(spark):
    from geofold.operators import labels

    rows = spark.range(500).selectExpr("id AS point_id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS c")
    got = labels.ranked(rows, "c", "point_id", 7).selectExpr("c", "point_id", "nth", "size", "xxhash64(7, point_id) AS h").collect()
    for c in (None, 1, 2):
        mine = sorted((r for r in got if r["c"] == c), key=lambda r: (r["h"], r["point_id"]))
        assert [r["nth"] for r in mine] == list(range(1, len(mine) + 1)) and {r["size"] for r in mine} == {len(mine)}
