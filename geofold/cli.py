"""Commands. Rasters are folders written by ``sources.sinks`` or GeoTIFF files; results are folders."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold import reports
from geofold.functions import classes, votes
from geofold.operators import agreement, embed, errors, grid, labels, metrics, ml, preprocess, tiles, zonal
from geofold.session import session, ship
from geofold.sources import config as cfg
from geofold.sources import discovery, geotiff, sinks, vector

REMOTE = "needs a network service that this engine does not call; bring the files and go on with the next command"


def load_raster(spark, path: str) -> tuple[DataFrame, dict]:
    """(row, col, x, y, cls) and metadata of a GeoTIFF."""
    geotiff.register(spark)
    meta = geotiff.metadata(spark, [path]).first().asDict()
    px = spark.read.format("geotiff").option("bands", "1").load(path)
    px = px.select("row", "col", "x", "y", F.col("v").cast("int").alias("cls"))
    return (px if meta["nodata"] is not None else px.withColumn("cls", classes.from_nodata("cls"))), meta


def reference(spark, path: str, field: str, meta: dict) -> DataFrame:
    """(point_id, row, col, x, y, truth) of reference points on a raster's grid."""
    pts = vector.read(spark, path)
    if field not in pts.columns:
        raise ValueError(f"no column {field!r} in {pts.columns}")
    text = F.col(field).cast("string")
    truth = F.coalesce(F.expr(f"try_cast(`{field}` AS INT)"), classes.class_index(text))
    row, col = F.floor((meta["north"] - F.col("y")) / meta["res_y"]).cast("long"), F.floor((F.col("x") - meta["west"]) / meta["res_x"]).cast("long")
    return pts.select(F.monotonically_increasing_id().alias("point_id"), row.alias("row"), col.alias("col"), "x", "y", truth.alias("truth"))


def aligned(spark, paths: list[str]) -> DataFrame:
    rasters = {f"m{i}": load_raster(spark, p)[0] for i, p in enumerate(paths)}
    meta = geotiff.metadata(spark, paths)
    names = spark.createDataFrame([(p, f"m{i}") for i, p in enumerate(paths)], "raster string, name string")
    meta = meta.join(names, "raster").drop("raster").withColumnRenamed("name", "raster")
    return grid.align(rasters, meta)


def init(a):
    issues = cfg.check(cfg.load(a.config)) if Path(a.config).exists() else []
    for d in ("imagery", "labels", "tiles", "embeddings", "predictions", "reports"):
        Path(a.out, d).mkdir(parents=True, exist_ok=True)
    return cfg.report(issues, "warning") or f"ready: {a.out}"


def validate_config(a):
    issues = cfg.check(cfg.load(a.config, a.set))
    return cfg.report(issues) or "valid"


def discover_existing(a, spark):
    found = discovery.experiments(spark, a.folder)
    if a.log:
        found = discovery.catalogue(found, discovery.log(spark, a.log))
    if a.out.endswith((".yaml", ".yml")):
        discovery.to_yaml(found, a.out)
    else:
        discovery.complete(found).coalesce(1).write.mode("overwrite").json(a.out)
    return f"{found.count()} experiments, {found.where('has_metrics').count()} complete"


def import_labels(a, spark):
    points = labels.imported(vector.read(spark, a.points), a.field, Path(a.points).name)
    points = points.withColumn("point_id", F.monotonically_increasing_id())
    points.write.mode("overwrite").parquet(a.out)
    kept = spark.read.parquet(a.out)
    issues = [r["issue"] for r in labels.validate(kept).orderBy("pos").collect()]
    return cfg.report(issues, "warning") or f"{kept.count()} labels"


def generate_labels(a, spark):
    px, _ = load_raster(spark, a.raster)
    made = labels.worldcover(px.select((F.col("row") * 10**7 + F.col("col")).alias("px"), "x", "y", F.col("cls").alias("label")), a.per_class)
    if a.observations:  # (px, x, y, label, probabilities), dated
        seen = spark.read.parquet(a.observations)
        probs = [c for c in seen.columns if c.startswith("p_")]
        made = labels.combine(made, labels.dynamic_world(seen, probs, a.per_class, a.confidence))
        made = made.withColumn("px", F.xxhash64("source", "px"))  # ids of two sources
    thinned = labels.thin(made.withColumnRenamed("px", "point_id"), a.distance) if a.distance else made.withColumnRenamed("px", "point_id")
    sinks.splits(labels.split(thinned, a.val), a.out)
    return f"labels in {a.out}"


def preprocess_tiles(a, spark):
    px = spark.read.parquet(a.tiles)
    preprocess.preprocess(px, a.model, a.height, a.width, a.nodata).write.mode("overwrite").parquet(a.out)
    return f"inputs for {a.model} in {a.out}"


def status(a, spark):
    return "\n".join(f"{r['status']}: {r['n']}" for r in tiles.progress(spark.read.parquet(a.index)).collect())


def generate_embeddings(a, spark):
    m = embed.create(a.model)
    out = tiles.run_batches(spark, spark.read.parquet(a.tiles), a.progress, lambda t: embed.embed(t, m, m.bands, m.size, m.size), a.out)
    return ", ".join(f"{r['status']}: {r['n']}" for r in out.collect())


def train_classifier(a, spark):
    rows = ml.matched(spark.read.parquet(a.embeddings), spark.read.parquet(a.labels))
    parts = labels.split(rows, 0.2, by="cls", id_col="tile_id").persist()
    model = ml.train(parts.where("part = 'train'"), a.classifier)
    model.write().overwrite().save(a.out)
    test = parts.where("part = 'val'")
    r = ml.evaluate(ml.predict(model, test), test).first()
    text = f"accuracy {r['accuracy']:.4f} on {r['n']} tiles"
    if a.folds:
        text += "\n" + "\n".join(f"{x['metric']}: {x['mean']:.4f} +- {x['std']:.4f}" for x in metrics.fold_summary(ml.cross_validate(rows, a.classifier, a.folds), "accuracy", "kappa").collect())
    return text


def _load_model(path: str):
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, session().sparkContext)


def predict(a, spark):
    out = ml.predict(_load_model(a.model), spark.read.parquet(a.embeddings))
    out.write.mode("overwrite").parquet(a.out)
    return "\n".join(f"{classes.NAMES.get(r['cls'], r['cls'])}: {r['n']}" for r in ml.distribution(spark.read.parquet(a.out)).orderBy("cls").collect())


def mosaic_tiles(a, spark):
    made, places = spark.read.parquet(a.predictions), spark.read.parquet(a.tiles)
    if "probs" in made.columns:
        every = grid.products(grid.paint(made.select("tile_id", "probs"), places, a.size)).persist()
        sinks.products(every, a.out, a.west, a.north, a.res, {"tiles": a.tiles, "predictions": a.predictions})
    else:
        sinks.raster(grid.mosaic(grid.paint(made.select("tile_id", "cls"), places, a.size)), a.out, "classification", "cls")
    return f"mosaic in {a.out}"


def zonal_stats(a, spark):
    px, meta = load_raster(spark, a.raster)
    zones = vector.zones(vector.read(spark, a.zones), a.id_field)
    stats = zonal.zone_stats(zonal.in_zones(px, zones), zones, meta["res_x"])
    sinks.table_csv(zonal.pivoted(stats), a.out)
    return f"statistics in {a.out}"


def process_by_focus(a, spark):
    px, _ = load_raster(spark, a.raster)
    zones = vector.zones(vector.read(spark, a.zones), a.id_field)
    inside = zonal.in_zones(px, zones)
    zonal.clip(inside).write.mode("overwrite").partitionBy("zone_id").parquet(f"{a.out}/clips")
    return "\n".join(f"{r['zone_id']}: {r['status']}, {r['coverage_pct']} %" for r in zonal.coverage(inside, zones, px).collect())


def _assessed(spark, path: str, points: str, field: str):
    px, meta = load_raster(spark, path)
    p = reference(spark, points, field, meta).persist()
    pairs = metrics.sample(p, px.withColumnRenamed("cls", "model"), ["model"]).drop("model").persist()
    return p, pairs


def assess_accuracy(a, spark):
    p, pairs = _assessed(spark, a.raster, a.points, a.field)
    cm = metrics.confusion(pairs)
    per = metrics.per_class(cm).withColumn("class", classes.class_name("k"))
    sinks.accuracy(metrics.overall(cm), per, metrics.dense(cm), p.join(pairs.select("point_id", F.col("p").alias("predicted")), "point_id", "left"), a.out)
    if a.report:
        marked = errors.error_points(p, pairs)
        b = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        html = reports.accuracy_report(metrics.overall(cm), per, metrics.normalised(metrics.dense(cm)), metrics.small_samples(cm), errors.density(marked, *b))
        Path(a.report).write_text(html, encoding="utf-8")
    r = metrics.overall(cm).first()
    return f"accuracy {r['accuracy']:.4f}, kappa {r['kappa']}" if r else "no points on the raster"


def compare_accuracy(a, spark):
    out = None
    for path in a.rasters:
        one = metrics.overall(metrics.confusion(_assessed(spark, path, a.points, a.field)[1])).withColumn("model", F.lit(Path(path).stem))
        out = one if out is None else out.unionAll(one)
    return "\n".join(f"{r['rank']}. {r['model']}: {r['accuracy']:.4f}" for r in metrics.ranked(out, {Path(p).stem: i for i, p in enumerate(a.rasters)}).orderBy("rank").collect())


def compare_models(a, spark):
    pair = agreement.paired(load_raster(spark, a.a)[0], load_raster(spark, a.b)[0]).persist()
    sinks.raster(agreement.agreement_map(pair), a.out, "agreement")
    sinks.table_csv(agreement.class_iou(pair), f"{a.out}/classes")
    r = agreement.agreement(pair).first()
    return f"{r['agreement_pct']} % of {r['valid_pixels']} pixels agree"


def ensemble(a, spark):
    issues = cfg.broken("ensemble", a.strategy) + (cfg.broken("weights", (a.weights, len(a.rasters))) if a.weights else [])
    if issues:
        raise ValueError(cfg.report(issues))
    if a.strategy == "probability_average":  # tables (row, col, probs)
        joined = None
        for i, path in enumerate(a.rasters):
            one = spark.read.parquet(path).select("row", "col", F.col("probs").alias(f"p{i}"))
            joined = one if joined is None else joined.join(one, ["row", "col"])
        mean = joined.select("row", "col", votes.average([f"p{i}" for i in range(len(a.rasters))], a.weights).alias("probs"))
        out = mean.select("row", "col", votes.argmax(F.col("probs")).alias("cls"), F.array_max("probs").alias("confidence"), "probs").persist()
        sinks.ensemble({"classification": out.select("row", "col", "cls"), "confidence": out.select("row", "col", "confidence"), "probability": out.select("row", "col", "probs")}, a.out, {"strategy": a.strategy, "models": a.rasters})
        return f"ensemble in {a.out}"
    wide = aligned(spark, a.rasters)
    names = [f"m{i}" for i in range(len(a.rasters))]
    cls, share = votes.weighted(names, dict(zip(names, a.weights)) if a.weights else None)
    out = wide.select("row", "col", cls.alias("cls"), share.alias("agreement")).persist()
    sinks.ensemble({"classification": out.select("row", "col", "cls"), "agreement": out.select("row", "col", "agreement")}, a.out, {"strategy": a.strategy, "models": a.rasters})
    return f"ensemble in {a.out}"


def fuse_predictions(a, spark):
    wide = aligned(spark, [a.base, a.refinement])
    conf = None
    if a.confidence:
        geotiff.register(spark)
        c = spark.read.format("geotiff").load(a.confidence).select("row", "col", F.col("v").alias("conf"))
        wide, conf = wide.join(c, ["row", "col"], "left"), "conf"
    if a.strategy == "confidence_weighted" and conf is None:
        raise ValueError("confidence_weighted needs a confidence raster")
    cls, source = votes.fuse_confidence("m0", "m1", conf, a.threshold) if a.strategy == "confidence_weighted" else votes.fuse_high_res("m0", "m1", conf, a.threshold)
    out = wide.select("row", "col", cls.alias("cls"), source.alias("source")).persist()
    sinks.ensemble({"classification": out.select("row", "col", "cls"), "source": out.select("row", "col", "source")}, a.out, {"strategy": a.strategy})
    return "\n".join(f"{r['source']}: {r['n']} ({r['pct']} %)" for r in agreement.fusion_stats(out).collect())


def remote(a):
    raise ValueError(f"{a.command} {REMOTE}")


# name: (function, whether it needs Spark, arguments)
COMMANDS = {
    "init": (init, False, ["out", "--config=config.yaml"]),
    "validate-config": (validate_config, False, ["config", "--set*"]),
    "discover-existing": (discover_existing, True, ["folder", "out", "--log"]),
    "export-imagery": (remote, False, []),
    "check-exports": (remote, False, []),
    "download-models": (remote, False, []),
    "generate-labels": (generate_labels, True, ["raster", "out", "--observations", "--confidence:float=0.6", "--per-class:int=500", "--distance:float=0", "--val:float=0.2"]),
    "import-labels": (import_labels, True, ["points", "out", "--field=land_cover"]),
    "preprocess": (preprocess_tiles, True, ["tiles", "out", "--model=prithvi", "--height:int=256", "--width:int=256", "--nodata:float"]),
    "status": (status, True, ["index"]),
    "generate-embeddings": (generate_embeddings, True, ["tiles", "progress", "out", "--model=prithvi"]),
    "train-classifier": (train_classifier, True, ["embeddings", "labels", "out", "--classifier=random_forest", "--folds:int=0"]),
    "predict": (predict, True, ["model", "embeddings", "out"]),
    "mosaic-tiles": (mosaic_tiles, True, ["predictions", "tiles", "out", "--size:int=256", "--west:float=0", "--north:float=0", "--res:float=10"]),
    "process-by-focus": (process_by_focus, True, ["raster", "zones", "out", "--id-field=NAME"]),
    "zonal-stats": (zonal_stats, True, ["raster", "zones", "out", "--id-field=NAME"]),
    "assess-accuracy": (assess_accuracy, True, ["raster", "points", "out", "--field=LC_CLASS", "--report"]),
    "compare-models": (compare_models, True, ["a", "b", "out"]),
    "compare-accuracy": (compare_accuracy, True, ["points", "rasters*", "--field=LC_CLASS"]),
    "ensemble": (ensemble, True, ["out", "rasters*", "--strategy=majority_vote", "--weights*:float"]),
    "fuse-predictions": (fuse_predictions, True, ["base", "refinement", "out", "--confidence", "--strategy=high_res_priority", "--threshold:float=0.5"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="geofold", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, _, args) in COMMANDS.items():
        p = subs.add_parser(name)
        for spec in args:
            spec, _, default = spec.partition("=")
            spec, _, kind = spec.partition(":")
            many = spec.endswith("*")
            kind = {"int": int, "float": float}.get(kind, str)
            extra = {"nargs": "+"} if many else {}
            if spec.startswith("--"):
                extra["default"] = kind(default) if default else None
            p.add_argument(spec.rstrip("*"), type=kind, **extra)
    return top


def started():
    spark = session()
    ship(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    run, needs_spark, _ = COMMANDS[a.command]
    try:
        print(run(a, started()) if needs_spark else run(a))
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
