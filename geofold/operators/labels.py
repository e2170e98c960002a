"""Label points: import, checks, thinning, splits and labels from global products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geofold.functions.classes import CLASSES, DYNAMIC_WORLD, WORLDCOVER, alias_class, class_index, class_name, lookup


def imported(rows: DataFrame, class_field: str, source: str, custom: dict[str, str] | None = None) -> DataFrame:
    """Rows with lc_name, lc_class, confidence (1.0 by default) and source; unmapped labels go."""
    if class_field not in rows.columns:
        raise ValueError(f"no column {class_field!r} in {rows.columns}")
    conf = F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)) if "confidence" in rows.columns else F.lit(1.0)
    named = rows.withColumn("lc_name", alias_class(F.col(class_field).cast("string"), custom)).where("lc_name IS NOT NULL")
    return named.withColumn("lc_class", class_index("lc_name")).withColumn("confidence", conf).withColumn("source", F.lit(f"custom:{source}"))


def duplicate_pairs(points: DataFrame, tolerance: float, x: str = "x", y: str = "y") -> DataFrame:
    """(a, b), a < b: points of (point_id, x, y) closer than ``tolerance``. Exact: cells of that size and their neighbours are joined."""
    p = points.select("point_id", F.col(x).alias("x"), F.col(y).alias("y"), F.floor(F.col(x) / tolerance).cast("long").alias("cx"), F.floor(F.col(y) / tolerance).cast("long").alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = p.select("*", F.explode(around).alias("s")).select(F.col("point_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return p.join(spread, ["cx", "cy"]).where((F.col("point_id") < F.col("b")) & (dx * dx + dy * dy < tolerance * tolerance)).select(F.col("point_id").alias("a"), "b")


def validate(points: DataFrame, aoi: tuple[float, float, float, float] | None = None, tolerance: float = 5.0, least: int = 20) -> DataFrame:
    """(pos, issue): what is wrong with label points, in a fixed order; no rows if nothing is."""
    w, s, e, n = aoi or (float("-inf"),) * 2 + (float("inf"),) * 2
    inside = (F.col("x") > w) & (F.col("x") < e) & (F.col("y") > s) & (F.col("y") < n)
    facts = points.agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"), F.count_if(F.coalesce(F.col("lc_class") < 0, F.lit(True))).alias("bad"), *[F.count_if(F.col("lc_name") == c).alias(f"n_{c}") for c in CLASSES])
    twins = duplicate_pairs(points, tolerance).agg(F.count("*").alias("twins"))
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    # fixed values: the issue texts, as tools that read them expect
    rules = [
        (F.col("n") == 0, F.lit("No valid label points after class mapping")),
        ((F.col("outside") > 0) if aoi else F.lit(False), text(F.col("outside"), " points are outside the AOI")),
        (F.col("bad") > 0, text(F.col("bad"), " points have invalid class assignments")),
        (F.col("twins") > 0, text(F.col("twins"), f" potential duplicates (within {tolerance}m)")),
        *[((F.col(f"n_{c}") > 0) & (F.col(f"n_{c}") < least), text(f"Class '{c}' has only ", F.col(f"n_{c}"), f" points (min: {least})")) for c in CLASSES],
    ]
    found = F.array(*[F.when(rule, F.struct(F.lit(i).alias("pos"), issue.alias("issue"))) for i, (rule, issue) in enumerate(rules)])
    return facts.crossJoin(F.broadcast(twins)).select(F.explode(F.array_compact(found)).alias("s")).select("s.*")  # one row by one row


def thin(points: DataFrame, distance: float) -> DataFrame:
    """Points of (point_id, x, y, ...) such that no two kept ones are closer than ``distance``; the smaller id stays.

    The result is that of the one-by-one scan in id order, found in rounds over all cells of 0.7 times the distance,
    which hold one kept point at most: a cell's undecided point of smallest id is kept once no undecided point near it
    has a smaller id, and all points near it go. So a round compares each point with 25 others at most, however many
    are near it. Rounds end when every point is decided. Points of one id are taken in order of x and y; those equal in
    all three are one point. Points without an id or with coordinates that are not finite are near none and stay.
    """
    if not distance * distance > 0:
        return points
    cell = [F.floor(F.col(c) / (0.7 * distance)).cast("long").alias(f"c{c}") for c in ("x", "y")]
    placed = F.col("point_id").isNotNull() & (F.abs(F.col("x").cast("double")) < float("inf")) & (F.abs(F.col("y").cast("double")) < float("inf"))
    # of points in one place the first decides: what is near it is near the others
    live = points.where(placed).groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("point_id").alias("id"))
    live = _held(live.select(F.struct("id", "x", "y").alias("p"), *cell))
    dx, dy = F.col("p.x") - F.col("m.x"), F.col("p.y") - F.col("m.y")
    close = (F.col("cx") == F.col("mx")) & (F.col("cy") == F.col("my")) & (dx * dx + dy * dy < distance * distance)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    spread = lambda t: t.select("m", "cx", "cy", around.alias("s")).select("m", (F.col("cx") + F.col("s.i")).alias("mx"), (F.col("cy") + F.col("s.j")).alias("my"))
    kept, rounds = live.select(F.col("p").alias("m")).limit(0), 0
    while not live.isEmpty():
        first = live.groupBy("cx", "cy").agg(F.min("p").alias("m"))
        blocked = live.join(spread(first), close & (F.col("p") < F.col("m"))).select("m").distinct()
        new = _held(first.join(blocked, "m", "left_anti"))
        live = _held(live.join(spread(new), close, "left_anti"))
        kept, rounds = kept.union(new.select("m")), rounds + 1
        if rounds % 8 == 0:
            kept = _held(kept)
    stay = kept.select(F.col("m.id").alias("id_"), F.col("m.x").alias("x_"), F.col("m.y").alias("y_"))
    out = points.join(stay, (F.col("point_id") == F.col("id_")) & (F.col("x").cast("double") == F.col("x_")) & (F.col("y").cast("double") == F.col("y_")), "left")
    return out.where(F.col("id_").isNotNull() | ~F.coalesce(placed, F.lit(False))).select(*points.columns)


def _held(df: DataFrame) -> DataFrame:
    """``df`` computed once, its plan cut off: in the checkpoint folder, or in the executors where none is set."""
    return df.checkpoint() if _has_checkpoints(df) else df.localCheckpoint()


def _has_checkpoints(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def ranked(rows: DataFrame, by: str | None, id_col: str, seed: int) -> DataFrame:
    """Rows with ``nth`` (from 1) in hash order of the id within a class, and the class's ``size``.

    Each class is numbered in 4,096 runs of its hashes, so no class is sorted in one task; only the runs' counts are.
    """
    at = rows.withColumn("hash_", F.xxhash64(F.lit(seed), id_col)).withColumn("run_", F.shiftright("hash_", 52)).withColumn("by_", F.col(by) if by else F.lit(0))
    whole = Window.partitionBy("by_")
    counts = at.groupBy("by_", "run_").agg(F.count("*").alias("n_"))
    counts = counts.select(F.col("by_").alias("by2_"), F.col("run_").alias("run2_"), (F.sum("n_").over(whole.orderBy("run_")) - F.col("n_")).alias("before_"), F.sum("n_").over(whole).alias("size"))
    here = Window.partitionBy("by_", "run_").orderBy("hash_", id_col)
    out = at.withColumn("nth_", F.row_number().over(here)).join(counts, F.col("by_").eqNullSafe(F.col("by2_")) & (F.col("run_") == F.col("run2_")))
    return out.select(*rows.columns, (F.col("before_") + F.col("nth_")).alias("nth"), "size")


def split(labels: DataFrame, share: float, seed: int = 42, by: str | None = "lc_class", id_col: str = "point_id") -> DataFrame:
    """Labels with ``part``, train or val. Per class the first max(1, n(1 - share)) of a hash order train; without a class n(1 - share)."""
    size = F.floor(F.col("size") * F.lit(1 - share)).cast("long")
    size = F.greatest(F.lit(1), size) if by else size
    return ranked(labels, by, id_col, seed).withColumn("part", F.when(F.col("nth") <= size, "train").otherwise("val")).drop("nth", "size")


def folds(rows: DataFrame, k: int, by: str | None = None, seed: int = 42, id_col: str = "tile_id") -> DataFrame:
    """Rows with a fold 0..k-1, spread evenly in each class."""
    return ranked(rows, by, id_col, seed).withColumn("fold", F.pmod(F.col("nth") - 1, F.lit(k)).cast("int")).drop("nth", "size")


def combine(*sources: DataFrame) -> DataFrame:
    """All label sources below each other; columns that one lacks are NULL."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def summary(labels: DataFrame) -> DataFrame:
    """(kind, key, n): total, per class, per source, and the number of sources."""
    part = lambda kind, key: labels.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    one = labels.agg(F.count("*").alias("total"), F.countDistinct("source").alias("sources"))
    whole = one.select(F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("key"), F.col("total").alias("n")), F.struct(F.lit("sources").alias("kind"), F.lit("").alias("key"), F.col("sources").alias("n")))).alias("s")).select("s.*")
    return whole.unionByName(part("class", F.col("lc_name"))).unionByName(part("source", F.col("source")))


def bounds(labels: DataFrame) -> DataFrame:
    return labels.agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


def _mean(p: str):
    """Mean of the decimals that doubles are written as, summed exactly: the same in any order of the rows. Values that 18 places can't hold (NaN, infinite, huge) leave it to ``avg``."""
    d = F.col(p).try_cast("decimal(38,18)")
    exact = F.when((F.count(d) == F.count(p)) & (F.count(d) > 0), F.try_sum(d) / F.count(d)).cast("double")
    return F.coalesce(exact, F.avg(p))


def dynamic_world(observations: DataFrame, probs: list[str], per_class: int, confidence: float, seed: int = 42) -> DataFrame:
    """Label points from dated observations (px, x, y, label, probabilities): the most frequent label, the largest mean probability, n a class by hash, then the confidence filter."""
    pixel = observations.groupBy("px").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.mode("label", True).alias("label"), *[_mean(p).alias(p) for p in probs])
    named = pixel.select("px", "x", "y", lookup(DYNAMIC_WORLD, "label").alias("lc_class"), F.greatest(*probs).alias("confidence"), F.col("label").alias("source_class"))
    return per_class_sample(named, per_class, seed).where(F.col("confidence") >= confidence).withColumn("source", F.lit("dynamic_world"))


def worldcover(pixels: DataFrame, per_class: int, seed: int = 43) -> DataFrame:
    """Label points from a class map (px, x, y, label), confidence 1."""
    named = pixels.select("px", "x", "y", lookup(WORLDCOVER, "label").alias("lc_class"), F.lit(1.0).alias("confidence"), F.col("label").alias("source_class"))
    return per_class_sample(named, per_class, seed).withColumn("source", F.lit("esa_worldcover"))


def per_class_sample(points: DataFrame, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy("lc_class").orderBy(F.xxhash64(F.lit(seed), "px"), "px")
    return points.where("lc_class IS NOT NULL").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth").withColumn("lc_name", class_name("lc_class"))


def buffered(points: DataFrame, radius: float, corners: int = 32) -> DataFrame:
    """Points with the ring (xs, ys) of a regular polygon around them."""
    import math

    at = [2 * math.pi * i / corners for i in range(corners)]
    return points.withColumn("xs", F.array(*[F.col("x") + radius * math.cos(a) for a in at])).withColumn("ys", F.array(*[F.col("y") + radius * math.sin(a) for a in at]))


def near_any(points: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    """Points (point_id, x, y) closer than ``distance`` to any of the others: by cells, exact."""
    p = points.withColumn("cx", F.floor(F.col("x") / distance).cast("long")).withColumn("cy", F.floor(F.col("y") / distance).cast("long"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    o = others.select(F.col("x").alias("ox"), F.col("y").alias("oy")).distinct().withColumn("s", F.explode(around))
    o = o.select("ox", "oy", (F.floor(F.col("ox") / distance) + F.col("s.i")).cast("long").alias("cx2"), (F.floor(F.col("oy") / distance) + F.col("s.j")).cast("long").alias("cy2"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return p.join(o, (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2")) & (dx * dx + dy * dy < distance * distance), "left_semi").drop("cx", "cy")
