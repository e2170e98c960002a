"""Imagery tiles (tile_id, band, row, col, v) to model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bands, input size, and the means and deviations of each model's training data.
MODELS = {
    "prithvi": {"bands": ["B2", "B3", "B4", "B8", "B11", "B12"], "size": 224, "mean": [494.905, 815.239, 924.944, 2968.881, 2634.621, 1739.579], "std": [284.925, 357.299, 575.512, 896.601, 951.455, 808.649]},
    "satlas": {"bands": ["B4", "B3", "B2"], "size": 256, "mean": [0.485, 0.456, 0.406], "std": [0.229, 0.224, 0.225]},
    "ssl4eo": {"bands": ["B2", "B3", "B4", "B8", "B11", "B12"], "size": 224, "mean": [0.0] * 6, "std": [1.0] * 6},
}
# The usual order of the exported bands.
POSITIONS = {"B2": 1, "B3": 2, "B4": 3, "B8": 4, "B11": 5, "B12": 6}


def settings(model: str, **overrides) -> dict:
    """A model's inputs; an unknown model has the first one's."""
    return {**MODELS.get(model, MODELS["prithvi"]), **{k: v for k, v in overrides.items() if v is not None}}


def band_indices(bands: list[str], descriptions: list[str | None]) -> list[int]:
    """1-based places of bands in a raster, by one lookup of its descriptions over the usual order.

    A band of neither stands at its own place in the list; places beyond the raster's last band are the last.
    """
    places = dict(POSITIONS)
    for at in range(len(descriptions), 0, -1):  # the first description that names a band wins
        places.update({b: -at for b in bands if b.lower() in str(descriptions[at - 1] or "").lower()})
    most = len(descriptions)
    return [-p if p < 0 else min(p, most) if b in places else p for p, b in ((places.get(b, i), b) for i, b in enumerate(bands, 1))]


def masked(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Pixels with ``valid``; where any band has nodata, NaN, infinity or NULL all bands become 0 and invalid."""
    v = F.col("v").cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (F.lit(False) if nodata is None else v == nodata)
    any_bad = F.max(bad.cast("int")).over(Window.partitionBy("tile_id", "row", "col"))
    return pixels.withColumn("valid", any_bad == 0).withColumn("v", F.when(F.col("valid"), v).otherwise(0.0))


def resized(pixels: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """Pixels on a size x size grid: the source cell min(i*h/size, h-1), rounded down.

    A source row feeds a run of target rows, so targets are generated from sources and nothing is joined.
    """

    def targets(i: str, n: int):
        # t with floor(t*n/size) = i, for t < size
        at = F.col(i).cast("long")
        return F.filter(F.sequence(F.greatest(F.lit(0), F.ceil(at * size / n).cast("long") - 1), F.least(F.lit(size - 1), F.ceil((at + 1) * size / n).cast("long"))), lambda t: F.least(F.floor(t * n / size), F.lit(n - 1)) == at)

    keep = [c for c in pixels.columns if c not in ("row", "col")]
    tall = pixels.withColumn("r", F.explode(targets("row", height))).withColumn("c", F.explode(targets("col", width)))
    return tall.select(*keep, F.col("r").cast("long").alias("row"), F.col("c").cast("long").alias("col"))


def normalised(pixels: DataFrame, bands: list[str], mean: list[float], std: list[float]) -> DataFrame:
    """(v - mean) / std for bands that have both and a positive deviation."""
    v = F.col("v")
    for b, m, s in zip(bands, mean, std):
        if s > 0:
            v = F.when(F.col("band") == b, (F.col("v") - m) / s).otherwise(v)
    return pixels.withColumn("v", v)


def filled(pixels: DataFrame) -> DataFrame:
    """Invalid pixels take their band's mean of valid ones; a band without any stays as it is."""
    mean = F.avg(F.when(F.col("valid"), F.col("v"))).over(Window.partitionBy("tile_id", "band"))
    return pixels.withColumn("v", F.when(F.col("valid"), F.col("v")).otherwise(F.coalesce(mean, F.col("v"))))


def preprocess(pixels: DataFrame, model: str, height: int, width: int, nodata: float | None = None, **overrides) -> DataFrame:
    """Mask, resize, normalise, fill: in this order."""
    s = settings(model, **overrides)
    chosen = pixels.where(F.col("band").isin(s["bands"]))
    return filled(normalised(resized(masked(chosen, nodata), height, width, s["size"]), s["bands"], s["mean"], s["std"]))
