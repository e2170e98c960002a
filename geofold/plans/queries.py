"""One query per operator over the derived fixtures, with the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions import classes, geo, votes
from geofold.operators import agreement, embed, errors, grid, labels, metrics, ml, preprocess, tiles, zonal
from geofold.plans import fixtures as fx
from geofold.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL of the fixtures

_NAME = "CASE {0} " + " ".join(f"WHEN {k} THEN '{n}'" for n, k in classes.CLASSES.items()) + " ELSE 'class_' || CAST({0} AS VARCHAR) END"
_INDEX = "CASE lower(trim({0})) " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in classes.CLASSES.items()) + " END"


def name_of(col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN {_NAME.format(col)} END"


PX = f"""
WITH e AS (SELECT event_id, user_id, value, event_id // 100 AS "row", event_id % 100 AS col, ((event_id // 100) // 5 + (event_id % 100) // 10) % 7 AS truth,
                  (SELECT max(event_id) FROM events) // 100 + 1 AS h FROM events),
px AS (SELECT event_id, "row", col, CAST(col * 10 + 5 AS DOUBLE) AS x, CAST((h - "row") * 10 - 5 AS DOUBLE) AS y, CAST(truth AS INT) AS truth,
         CAST(CASE WHEN user_id % 13 <> 0 THEN CASE WHEN (event_id * 7919) % 100 < 15 THEN (truth + 1) % 7 ELSE truth END END AS INT) AS model_a,
         CAST(CASE WHEN (event_id * 104729) % 100 < 25 THEN (truth + 3) % 7 ELSE truth END AS INT) AS model_b,
         CAST(CASE WHEN user_id % 11 <> 0 THEN CASE WHEN (event_id * 1299709) % 100 < 35 THEN (truth + 1 + event_id % 3) % 7 ELSE truth END END AS INT) AS model_c,
         value / (value + 20.0) AS conf FROM e),
pts AS (SELECT event_id AS point_id, "row", col, x, y,
          CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 35 = 0 THEN 'cloud' WHEN event_id % 4 = 0 THEN ' ' || upper({_NAME.format("truth")}) || ' ' ELSE {_NAME.format("truth")} END END AS label_str,
          CASE WHEN event_id % 2 = 1 THEN truth END AS label_int FROM px WHERE event_id % 7 = 0),
ref AS (SELECT point_id, "row", col, x, y, coalesce(label_int, {_INDEX.format("label_str")}) AS truth FROM pts),
smp AS (SELECT r.point_id, r.x, r.y, CAST(r.truth AS INT) AS t, px.model_a, px.model_b, px.model_c FROM ref r JOIN px ON r."row" = px."row" AND r.col = px.col WHERE r.truth IS NOT NULL),
pairs AS (SELECT 'model_a' AS model, point_id, x, y, t, model_a AS p FROM smp WHERE model_a IS NOT NULL
          UNION ALL SELECT 'model_b', point_id, x, y, t, model_b FROM smp WHERE model_b IS NOT NULL
          UNION ALL SELECT 'model_c', point_id, x, y, t, model_c FROM smp WHERE model_c IS NOT NULL),
cf AS (SELECT model, t, p, count(*) AS n FROM pairs GROUP BY model, t, p),
ks AS (SELECT model, k, CAST(sum(s) AS BIGINT) AS support, CAST(sum(q) AS BIGINT) AS predicted, CAST(sum(c) AS BIGINT) AS correct FROM (
         SELECT model, t AS k, n AS s, 0 AS q, CASE WHEN t = p THEN n ELSE 0 END AS c FROM cf UNION ALL SELECT model, p, 0, n, 0 FROM cf) GROUP BY model, k),
rects(zone_id, west, south, east, north) AS (VALUES {", ".join(f"('{z}', CAST({w} AS DOUBLE), CAST({s} AS DOUBLE), CAST({e} AS DOUBLE), CAST({n} AS DOUBLE))" for z, w, s, e, n in fx.RECTS)}),
inr AS (SELECT zone_id, px.*, model_a AS cls FROM px JOIN rects ON x > west AND x < east AND y > south AND y < north),
edges AS (SELECT zone_id, part, x1, y1, x2, y2 FROM (VALUES {", ".join(f"('{z}', {p}, {float(xs[i])}::DOUBLE, {float(ys[i])}::DOUBLE, {float(xs[(i + 1) % len(xs)])}::DOUBLE, {float(ys[(i + 1) % len(xs)])}::DOUBLE)" for z, p, xs, ys in fx.POLYGONS for i in range(len(xs)))}) v(zone_id, part, x1, y1, x2, y2)),
inp AS (SELECT DISTINCT zone_id, "row", col, model_a AS cls FROM (SELECT zone_id, part, "row", col, model_a, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (CASE WHEN y2 <> y1 THEN y2 - y1 ELSE 1.0 END) + x1) AS hits
          FROM px CROSS JOIN edges GROUP BY zone_id, part, "row", col, model_a) WHERE hits % 2 = 1)
"""


def filed(df: DataFrame, col: str = "cls") -> DataFrame:
    """Classes as files hold them: 255 for no data."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(classes.NODATA)))


def points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    px = fx.pixels(spark, sf_dir)
    p = fx.points(px)
    return px, p.select("point_id", "row", "col", "x", "y", classes.reference_class("label_str", "label_int").alias("truth"))


def pairs(spark, sf_dir) -> DataFrame:
    px, p = points(spark, sf_dir)
    return metrics.sample(p, px, fx.MODELS)


def placed(spark, sf_dir, model: str = "model_a") -> DataFrame:
    """(point_id, x, y, t, p) of one model."""
    px, p = points(spark, sf_dir)
    one = metrics.sample(p, px, [model])
    return one.join(p.select("point_id", "x", "y"), "point_id")


def classed(spark, sf_dir) -> DataFrame:
    return fx.pixels(spark, sf_dir).withColumn("cls", F.col("model_a"))


# ---------------------------------------------------------------- accuracy


@query(PX + 'SELECT m.model, m.k AS t, q.k AS p, CAST(coalesce(cf.n, 0) AS BIGINT) AS n FROM ks m JOIN ks q ON m.model = q.model LEFT JOIN cf ON cf.model = m.model AND cf.t = m.k AND cf.p = q.k')
def confusion_matrix(spark, sf_dir):
    return metrics.dense(metrics.confusion(pairs(spark, sf_dir), "model"), "model").select("model", "t", "p", "n")


_OVERALL = """SELECT model, CAST(sum(support) AS BIGINT) AS n, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(correct) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
  CAST(sum(support) * sum(correct) - sum(support * predicted) AS DOUBLE) / nullif(CAST(sum(support) * sum(support) - sum(support * predicted) AS DOUBLE), 0) AS kappa,
  round(avg(CASE WHEN support + predicted > 0 THEN CAST(2 * correct AS DOUBLE) / (support + predicted) ELSE 0 END), 9) AS f1_macro,
  round(sum(CASE WHEN support + predicted > 0 THEN CAST(2 * correct AS DOUBLE) / (support + predicted) ELSE 0 END * support) / CAST(sum(support) AS DOUBLE), 9) AS f1_weighted,
  round(avg(CASE WHEN support + predicted - correct > 0 THEN CAST(correct AS DOUBLE) / (support + predicted - correct) ELSE 0 END), 9) AS mean_iou FROM ks GROUP BY model"""


@query(PX + _OVERALL)
def accuracy_overall(spark, sf_dir):
    m = metrics.overall(metrics.confusion(pairs(spark, sf_dir), "model"), "model")
    return m.select("model", "n", "correct", "accuracy", "kappa", *[F.round(c, 9).alias(c) for c in ("f1_macro", "f1_weighted", "mean_iou")])


_DIV = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} ELSE 0 END"


@query(PX + f'SELECT model, {_NAME.format("k")} AS class, support, correct, {_DIV.format("correct", "support")} AS producer, {_DIV.format("correct", "predicted")} AS "user", {_DIV.format("2 * correct", "(support + predicted)")} AS f1 FROM ks')
def accuracy_per_class(spark, sf_dir):
    k = metrics.per_class(metrics.confusion(pairs(spark, sf_dir), "model"), "model")
    return k.select("model", classes.class_name("k").alias("class"), "support", "correct", "producer", "user", "f1")


@query(PX + f'SELECT model, {_NAME.format("k")} AS class, {_DIV.format("correct", "(support + predicted - correct)")} AS iou FROM ks')
def iou_per_class(spark, sf_dir):
    k = metrics.per_class(metrics.confusion(pairs(spark, sf_dir), "model"), "model")
    return k.select("model", classes.class_name("k").alias("class"), "iou")


@query(PX + f'SELECT model, {_NAME.format("t")} AS class, CAST(sum(n) AS BIGINT) AS n FROM cf GROUP BY model, t HAVING sum(n) < 200')
def sample_size_warnings(spark, sf_dir):
    return metrics.small_samples(metrics.confusion(pairs(spark, sf_dir), "model"), "model", least=200)


@query(PX + ", o AS (" + _OVERALL + ") SELECT model, n, accuracy, CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS INT) AS rank FROM o")
def model_ranking(spark, sf_dir):
    return metrics.ranked(metrics.overall(metrics.confusion(pairs(spark, sf_dir), "model"), "model"))


@query(PX + ', s AS (SELECT model, t, sum(n) AS w FROM cf GROUP BY model, t) SELECT cf.model, cf.t, cf.p, cf.n, CAST(cf.n AS DOUBLE) / CAST(s.w AS DOUBLE) AS share FROM cf JOIN s ON cf.model = s.model AND cf.t = s.t')
def confusion_normalised(spark, sf_dir):
    return metrics.normalised(metrics.confusion(pairs(spark, sf_dir), "model"), "model").select("model", "t", "p", "n", "share")


@query("""WITH c AS (SELECT quality AS t, 1 - toxic AS p, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
k AS (SELECT k, sum(s) AS s, sum(q) AS q, sum(c) AS c FROM (SELECT t AS k, n AS s, 0 AS q, CASE WHEN t = p THEN n ELSE 0 END AS c FROM c UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY k)
SELECT CAST(sum(s) AS BIGINT) AS n, CAST(sum(c) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS accuracy, CAST(sum(s) * sum(c) - sum(s * q) AS DOUBLE) / CAST(sum(s) * sum(s) - sum(s * q) AS DOUBLE) AS kappa FROM k""")
def binary_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p")).dropna()
    return metrics.overall(metrics.confusion(rows)).select("n", "accuracy", "kappa")


# ---------------------------------------------------------------- agreement


def _ab(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    return agreement.paired(px, px, "model_a", "model_b")


@query(PX + "SELECT count(*) AS valid_pixels, round(coalesce(count(*) FILTER (WHERE model_a = model_b) * 100.0 / nullif(count(*), 0), 0), 2)::DOUBLE AS agreement_pct FROM px WHERE model_a IS NOT NULL AND model_b IS NOT NULL")
def spatial_agreement(spark, sf_dir):
    return agreement.agreement(_ab(spark, sf_dir))


@query(PX + f""", v AS (SELECT model_a AS a, model_b AS b FROM px WHERE model_a IS NOT NULL AND model_b IS NOT NULL), k AS (SELECT a AS k FROM v UNION SELECT b FROM v)
SELECT {_NAME.format("k")} AS class, count(*) FILTER (WHERE a = k AND b = k) AS both, count(*) FILTER (WHERE a = k OR b = k) AS "either", count(*) FILTER (WHERE a = k) AS count_a, count(*) FILTER (WHERE b = k) AS count_b,
       round(CAST(count(*) FILTER (WHERE a = k AND b = k) AS DOUBLE) / count(*) FILTER (WHERE a = k OR b = k), 4) AS iou FROM v CROSS JOIN k GROUP BY k""")
def agreement_iou(spark, sf_dir):
    return agreement.class_iou(_ab(spark, sf_dir))


@query(PX + 'SELECT "row", col, CASE WHEN model_a IS NOT NULL AND model_b IS NOT NULL THEN CASE WHEN model_a = model_b THEN 1 ELSE 0 END ELSE 255 END AS agree FROM px')
def agreement_map(spark, sf_dir):
    return filed(agreement.agreement_map(_ab(spark, sf_dir)), "agree")


_VALID = "model_a IS NOT NULL AND model_b IS NOT NULL AND model_c IS NOT NULL"


@query(PX + ", v AS (SELECT * FROM px WHERE " + _VALID + ") " + " UNION ALL ".join(f"SELECT '{a}_vs_{b}' AS pair, round(count(*) FILTER (WHERE {a} = {b}) * CAST(100.0 AS DOUBLE) / count(*), 2) AS agreement_pct FROM v" for a, b in (("model_a", "model_b"), ("model_a", "model_c"), ("model_b", "model_c"))))
def pairwise_agreement(spark, sf_dir):
    return agreement.pairwise(fx.pixels(spark, sf_dir), fx.MODELS)


_COUNTS = ", ".join(f"(CASE WHEN model_a = {k} THEN 1 ELSE 0 END + CASE WHEN model_b = {k} THEN 1 ELSE 0 END + CASE WHEN model_c = {k} THEN 1 ELSE 0 END)" for k in range(7))


@query(PX + f", v AS (SELECT greatest({_COUNTS}) AS top FROM px WHERE {_VALID}) SELECT count(*) AS valid_pixels, round(count(*) FILTER (WHERE top = 3) * CAST(100.0 AS DOUBLE) / count(*), 2) AS full_pct, round(CAST(sum(top) AS DOUBLE) / (count(*) * 3), 4) AS mean_agreement FROM v")
def full_agreement(spark, sf_dir):
    return agreement.full_agreement(fx.pixels(spark, sf_dir), fx.MODELS)


@query(PX + f", v AS (SELECT k, CASE WHEN model_a = k THEN 1 ELSE 0 END + CASE WHEN model_b = k THEN 1 ELSE 0 END + CASE WHEN model_c = k THEN 1 ELSE 0 END AS votes FROM px CROSS JOIN range(0, 7) r(k) WHERE {_VALID}) SELECT {_NAME.format('k')} AS class, count(*) AS pixels_any, count(*) FILTER (WHERE votes = 3) AS pixels_all, round(CAST(sum(votes) AS DOUBLE) / (count(*) * CAST(3.0 AS DOUBLE)), 4) AS mean_agreement FROM v WHERE votes > 0 GROUP BY k")
def class_agreement(spark, sf_dir):
    return agreement.class_agreement(fx.pixels(spark, sf_dir), fx.MODELS)


# ---------------------------------------------------------------- ensembles and fusion


def _vote_sql(w) -> str:
    v = [f"(CASE WHEN model_a = {k} THEN {w[0]}::DOUBLE ELSE 0 END + CASE WHEN model_b = {k} THEN {w[1]}::DOUBLE ELSE 0 END + CASE WHEN model_c = {k} THEN {w[2]}::DOUBLE ELSE 0 END)" for k in range(7)]
    return f""", v AS (SELECT "row", col, {_VALID} AS ok, [{', '.join(v)}] AS votes FROM px)
SELECT "row", col, CASE WHEN ok THEN CAST(list_position(votes, list_max(votes)) - 1 AS INT) ELSE 255 END AS cls, CASE WHEN ok THEN round(list_max(votes) / {sum(w)}::DOUBLE, 9) ELSE 0 END AS share FROM v"""


@query(PX + _vote_sql((1.0, 1.0, 1.0)))
def majority_vote(spark, sf_dir):
    cls, share = votes.majority(fx.MODELS)
    return filed(fx.pixels(spark, sf_dir).select("row", "col", cls.alias("cls"), F.round(share, 9).alias("share")))


@query(PX + _vote_sql((0.5, 1.0, 0.75)))
def weighted_vote(spark, sf_dir):
    cls, share = votes.weighted(fx.MODELS, {"model_a": 0.5, "model_c": 0.75})
    return filed(fx.pixels(spark, sf_dir).select("row", "col", cls.alias("cls"), F.round(share, 9).alias("share")))


def _slice_sql(first: int) -> str:
    raw = [f"(embedding[{first + i}]::DOUBLE * embedding[{first + i}]::DOUBLE + 0.001::DOUBLE)" for i in range(7)]
    return "[" + ", ".join(f"{r} / ({' + '.join(raw)})" for r in raw) + "]"


_PROBS = f"WITH s AS (SELECT vec_id AS tile_id, {_slice_sql(1)} AS a, {_slice_sql(8)} AS b, {_slice_sql(15)} AS c FROM embeddings), m AS (SELECT tile_id, a, b, c, [" + ", ".join(f"a[{i}] * 0.5::DOUBLE + b[{i}] * 0.25::DOUBLE + c[{i}] * 0.25::DOUBLE" for i in range(1, 8)) + "] AS p FROM s) "


@query(_PROBS + "SELECT tile_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS cls, round(list_max(p), 9) AS confidence FROM m")
def probability_average(spark, sf_dir):
    p = fx.slices(spark, sf_dir).select("tile_id", votes.average(["a", "b", "c"], [2.0, 1.0, 1.0]).alias("p"))
    return p.select("tile_id", votes.argmax(F.col("p")).alias("cls"), F.round(F.array_max("p"), 9).alias("confidence"))


@query(_PROBS + "SELECT tile_id, round((" + " + ".join(f"(CASE WHEN a[{i}] > 0 THEN -a[{i}] * log2(a[{i}]) ELSE 0 END)" for i in range(1, 8)) + ") / log2(7.0::DOUBLE), 9) AS uncertainty FROM m")
def entropy_uncertainty(spark, sf_dir):
    return fx.slices(spark, sf_dir).select("tile_id", F.round(votes.entropy("a"), 9).alias("uncertainty"))


_HIGH = "CASE WHEN model_c IS NOT NULL AND NOT (conf < 0.5 AND model_a IS NOT NULL) THEN 2 WHEN model_a IS NOT NULL THEN 1 ELSE 0 END"
_CONF = "CASE WHEN model_c IS NOT NULL AND (model_a IS NULL OR conf >= 0.5) THEN 2 WHEN model_a IS NOT NULL THEN 1 ELSE 0 END"


def _fuse_sql(source: str) -> str:
    return PX + f', f AS (SELECT "row", col, model_a, model_c, {source} AS source FROM px) SELECT "row", col, CASE source WHEN 2 THEN model_c WHEN 1 THEN model_a ELSE 255 END AS cls, source FROM f'


@query(_fuse_sql(_HIGH))
def fuse_high_res(spark, sf_dir):
    cls, source = votes.fuse_high_res("model_a", "model_c", "conf")
    return filed(fx.pixels(spark, sf_dir).select("row", "col", cls.alias("cls"), source.alias("source")))


@query(_fuse_sql(_CONF))
def fuse_confidence(spark, sf_dir):
    cls, source = votes.fuse_confidence("model_a", "model_c", "conf")
    return filed(fx.pixels(spark, sf_dir).select("row", "col", cls.alias("cls"), source.alias("source")))


@query(PX + f", f AS (SELECT {_CONF} AS s FROM px), t AS (SELECT greatest(count(*) FILTER (WHERE s > 0), 1) AS v FROM f) SELECT n.source, count(*) FILTER (WHERE s = n.k) AS n, round(count(*) FILTER (WHERE s = n.k) * CAST(100.0 AS DOUBLE) / any_value(v), 1) AS pct FROM f CROSS JOIN t CROSS JOIN (VALUES ('base', 1), ('refinement', 2)) n(source, k) GROUP BY n.source")
def fusion_stats(spark, sf_dir):
    return agreement.fusion_stats(fuse_confidence(spark, sf_dir))


# ---------------------------------------------------------------- zones


@query(PX + f"SELECT CAST(model_a AS INT) AS cls, {_NAME.format('model_a')} AS class, count(*) AS n, round(count(*) * CAST(100.0 AS DOUBLE) / 10000.0, 2) AS hectares, round(count(*) * CAST(100.0 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS percentage FROM px WHERE model_a IS NOT NULL GROUP BY model_a")
def raster_stats(spark, sf_dir):
    return zonal.raster_stats(classed(spark, sf_dir), fx.RES)


def _zone_sql(inside: str) -> str:
    return PX + f"""SELECT zone_id, cls, {_NAME.format('cls')} AS class, count(*) AS n, round(count(*) * CAST(100.0 AS DOUBLE), 1) AS area_sq_m, round(count(*) * CAST(100.0 AS DOUBLE) / 10000.0, 2) AS hectares,
round(count(*) * CAST(100.0 AS DOUBLE) / 4046.86, 2) AS acres, round(count(*) * CAST(100.0 AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY zone_id) AS DOUBLE), 2) AS percentage FROM {inside} WHERE cls IS NOT NULL GROUP BY zone_id, cls"""


@query(_zone_sql("inr"))
def zonal_stats_rect(spark, sf_dir):
    zones = fx.rects(spark)
    return zonal.zone_stats(zonal.in_zones(classed(spark, sf_dir), zones), zones, fx.RES)


@query(_zone_sql("inp"))
def zonal_stats_polygon(spark, sf_dir):
    zones = fx.polygons(spark)
    return zonal.zone_stats(zonal.in_zones(classed(spark, sf_dir), zones), zones, fx.RES)


@query(PX + ", s AS (SELECT zone_id, cls, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY zone_id) AS DOUBLE) AS w FROM inr WHERE cls IS NOT NULL GROUP BY zone_id, cls) SELECT zone_id, " + ", ".join(f"coalesce(max(CASE WHEN cls = {classes.CLASSES[c]} THEN round(n * CAST(100.0 AS DOUBLE) / w, 2) END), 0) AS {c}_pct, coalesce(max(CASE WHEN cls = {classes.CLASSES[c]} THEN round(n * CAST(100.0 AS DOUBLE) / 10000.0, 2) END), 0) AS {c}_hectares" for c in sorted(classes.CLASSES)) + " FROM s GROUP BY zone_id")
def zonal_pivot(spark, sf_dir):
    return zonal.pivoted(zonal_stats_rect(spark, sf_dir))


@query(PX + f""", c AS (SELECT zone_id, cls, count(*) AS n FROM inr WHERE cls IS NOT NULL GROUP BY zone_id, cls), d AS (SELECT zone_id, cls, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, cls) AS r FROM c)
SELECT z.zone_id, count(i."row") AS total_pixels, count(i.cls) AS valid_pixels, count(i."row") - count(i.cls) AS nodata_pixels, any_value({name_of('d.cls')}) AS dominant_class
FROM rects z LEFT JOIN inr i USING (zone_id) LEFT JOIN d ON d.zone_id = z.zone_id AND d.r = 1 GROUP BY z.zone_id""")
def zonal_dominant(spark, sf_dir):
    zones = fx.rects(spark)
    return zonal.zone_totals(zonal.in_zones(classed(spark, sf_dir), zones), zones)


@query(PX + 'SELECT "row", col, coalesce(model_a, 255) AS cls FROM px WHERE x BETWEEN 100 AND 300 AND y BETWEEN 55 AND 205')
def clip_bbox(spark, sf_dir):
    return filed(zonal.clip_box(classed(spark, sf_dir), 100.0, 55.0, 300.0, 205.0).select("row", "col", "cls"))


@query(PX + 'SELECT zone_id, "row" - min("row") OVER (PARTITION BY zone_id) AS "row", col - min(col) OVER (PARTITION BY zone_id) AS col, coalesce(cls, 255) AS cls FROM inp')
def clip_polygon(spark, sf_dir):
    return filed(zonal.clip(zonal.in_zones(classed(spark, sf_dir), fx.polygons(spark))))


@query(PX + """, b AS (SELECT zone_id, min(x1) AS west, min(y1) AS south, max(x1) AS east, max(y1) AS north FROM edges GROUP BY zone_id), t AS (SELECT zone_id, count(*) AS total FROM px JOIN b ON x > west AND x < east AND y > south AND y < north GROUP BY zone_id),
v AS (SELECT zone_id, count(*) AS valid FROM inp WHERE cls IS NOT NULL GROUP BY zone_id)
SELECT b.zone_id, coalesce(valid, 0) AS valid, coalesce(total, 0) AS total, round(coalesce(valid, 0) * CAST(100.0 AS DOUBLE) / total, 2) AS coverage_pct, CASE WHEN coalesce(total, 0) > 0 THEN 'success' ELSE 'failed' END AS status FROM b LEFT JOIN t USING (zone_id) LEFT JOIN v USING (zone_id)""")
def clip_coverage(spark, sf_dir):
    px, zones = classed(spark, sf_dir), fx.polygons(spark)
    return zonal.coverage(zonal.in_zones(px, zones), zones, px)


@query("SELECT r.r_name AS zone_id, n.n_name AS part, count(*) AS n, round(sum(c.c_acctbal), 2) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name")
def zone_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy(F.col("r_name").alias("zone_id"), F.col("n_name").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# ---------------------------------------------------------------- errors

_ONE = PX + ", a AS (SELECT * FROM pairs WHERE model = 'model_a') "


@query(_ONE + "SELECT count(*) AS n_points, count(*) FILTER (WHERE t <> p) AS n_errors, round(CAST(count(*) FILTER (WHERE t <> p) AS DOUBLE) / count(*), 4) AS error_rate FROM a")
def error_summary(spark, sf_dir):
    return errors.summary(placed(spark, sf_dir))


@query(_ONE + f"SELECT {_NAME.format('t')} AS class, count(*) AS n, count(*) FILTER (WHERE t <> p) AS errors, round(CAST(count(*) FILTER (WHERE t <> p) AS DOUBLE) / count(*), 4) AS rate FROM a GROUP BY t HAVING count(*) FILTER (WHERE t <> p) > 0")
def class_error_rates(spark, sf_dir):
    return errors.class_error_rates(placed(spark, sf_dir))


@query(_ONE + f"SELECT {_NAME.format('t')} || ' -> ' || {_NAME.format('p')} AS confusion, count(*) AS n FROM a WHERE t <> p GROUP BY t, p ORDER BY count(*) DESC, min(point_id) LIMIT 10")
def top_confusions(spark, sf_dir):
    return errors.top_confusions(placed(spark, sf_dir))


_PXC = PX + ", c AS (SELECT truth AS t, model_c AS p, count(*) AS n FROM px WHERE model_c IS NOT NULL GROUP BY 1, 2) "


def _pixel_confusion(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    return metrics.confusion(px.select(F.col("truth").alias("t"), F.col("model_c").alias("p")).dropna())


@query(_PXC + ", w AS (SELECT t, p, n, round(n * CAST(100.0 AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE), 1) AS pct_of_true FROM c) SELECT * FROM w WHERE t <> p ORDER BY n DESC, t, p LIMIT 10")
def confusion_pairs(spark, sf_dir):
    return errors.pairs_of_true(_pixel_confusion(spark, sf_dir))


@query(_PXC + ", b AS (SELECT least(t, p) AS i, greatest(t, p) AS j, CAST(sum(CASE WHEN t < p THEN n ELSE 0 END) AS BIGINT) AS n_ij, CAST(sum(CASE WHEN t > p THEN n ELSE 0 END) AS BIGINT) AS n_ji FROM c WHERE t <> p GROUP BY 1, 2) SELECT i, j, n_ij, n_ji, round(greatest(n_ij, n_ji) / (least(n_ij, n_ji) + 0.000001::DOUBLE), 2) AS ratio FROM b ORDER BY ratio DESC, i, j LIMIT 5")
def confusion_asymmetry(spark, sf_dir):
    return errors.asymmetry(_pixel_confusion(spark, sf_dir))


@query(PX + f"SELECT {_NAME.format('k')} AS class, support - correct AS omission, predicted - correct AS commission, round({_DIV.format('(support - correct)', 'support')}, 4) AS omission_rate, round({_DIV.format('(predicted - correct)', 'predicted')}, 4) AS commission_rate FROM ks WHERE model = 'model_a'")
def omission_commission(spark, sf_dir):
    return errors.omission_commission(metrics.per_class(metrics.confusion(placed(spark, sf_dir))))


_CELLS = _ONE + ", c AS (SELECT least(CAST(trunc((y - 0) / 100.0::DOUBLE) AS INT), 9) AS \"row\", least(CAST(trunc((x - 0) / 100.0::DOUBLE) AS INT), 9) AS col, count(*) AS n, count(*) FILTER (WHERE t <> p) AS errors, round(CAST(count(*) FILTER (WHERE t <> p) AS DOUBLE) / count(*), 4) AS rate FROM a GROUP BY 1, 2) "


def _cells(spark, sf_dir):
    p = placed(spark, sf_dir)
    return errors.density(p.select("x", "y", (F.col("t") != F.col("p")).alias("is_error")), 0.0, 0.0, 1000.0, 1000.0)


@query(_CELLS + "SELECT * FROM c")
def error_density(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(_CELLS + ', m AS (SELECT round(avg(rate), 10) AS mean FROM c WHERE n >= 2) SELECT "row", col, n, errors, rate FROM c CROSS JOIN m WHERE n >= 2 AND rate > mean ORDER BY rate DESC, "row", col LIMIT 10')
def error_hotspots(spark, sf_dir):
    return errors.hotspots(_cells(spark, sf_dir))


_EDGE = PX + ', g AS (SELECT a."row", a.col, a.model_a AS cls, bool_or(b.model_a <> a.model_a) AS edge FROM px a JOIN px b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 WHERE a.model_a IS NOT NULL AND b.model_a IS NOT NULL GROUP BY 1, 2, 3) '


@query(_EDGE + "SELECT * FROM g")
def edge_mask(spark, sf_dir):
    return errors.edges(fx.pixels(spark, sf_dir), "model_a")


@query(_EDGE + """, m AS (SELECT g.edge, s.t, s.model_a AS p FROM ref r JOIN smp s USING (point_id) JOIN g ON g."row" = r."row" AND g.col = r.col WHERE s.model_a IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE edge) AS edge_points, count(*) FILTER (WHERE edge AND t <> p) AS edge_errors, count(*) FILTER (WHERE NOT edge) AS interior_points, count(*) FILTER (WHERE NOT edge AND t <> p) AS interior_errors FROM m),
r2 AS (SELECT *, coalesce(CAST(edge_errors AS DOUBLE) / nullif(edge_points, 0), 0) AS er, coalesce(CAST(interior_errors AS DOUBLE) / nullif(interior_points, 0), 0) AS ir FROM c)
SELECT edge_points, edge_errors, interior_points, interior_errors, round(er, 4) AS edge_rate, round(ir, 4) AS interior_rate, CASE WHEN edge_points > 0 AND interior_points > 0 THEN round(er / (ir + 1e-9), 2) ELSE 0 END AS ratio FROM r2""")
def edge_error_rate(spark, sf_dir):
    px, p = points(spark, sf_dir)
    at = metrics.sample(p, px, ["model_a"]).join(p.select("point_id", "row", "col"), "point_id")
    return errors.edge_errors(at.join(errors.edges(px, "model_a").select("row", "col", "edge"), ["row", "col"]))


@query(_ONE + "SELECT point_id, CASE WHEN point_id IN (SELECT point_id FROM a WHERE t <> p) THEN 1 ELSE 0 END AS is_error FROM pts")
def error_points(spark, sf_dir):
    px, p = points(spark, sf_dir)
    return errors.error_points(p, metrics.sample(p, px, ["model_a"])).select("point_id", "is_error")


# ---------------------------------------------------------------- grids


@query("""SELECT printf('s2_%04d_%04d', r, c) AS tile_id, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS col, 500000.0::DOUBLE + c * 2240.0::DOUBLE AS west, 5210000.0::DOUBLE - r * 2240.0::DOUBLE - 2560.0::DOUBLE AS south FROM range(0, 5) a(r) CROSS JOIN range(0, 5) b(c)""")
def tile_grid(spark, sf_dir):
    g = grid.tile_grid(spark, 500000.0, 5200000.0, 510000.0, 5210000.0, 10.0, 256, overlap=32, source="s2")
    return g.select("tile_id", "row", "col", "bbox.west", "bbox.south")


def _tiles(spark, sf_dir):
    """Overlapping 16-pixel tiles on a step of 12, ranked by id; each predicts one class. Tiles of label 7 have no class, of 8 no prediction, of 9 no place."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), "label")
    at = e.where("label <> 9").select(F.col("i").cast("string").alias("tile_id"), F.col("i").alias("rank"), (F.floor(F.col("i") / 10) * 12).cast("long").alias("row0"), (F.col("i") % 10 * 12).alias("col0"))
    predictions = e.where("label <> 8").select(F.col("i").cast("string").alias("tile_id"), F.when(F.col("label") < 7, F.col("label")).alias("cls"))
    return predictions, at


@query("""WITH t AS (SELECT vec_id AS rank, vec_id // 10 * 12 AS r0, vec_id % 10 * 12 AS c0, CASE WHEN label < 7 THEN label END AS cls FROM embeddings WHERE label NOT IN (8, 9)),
p AS (SELECT r0 + a.r AS "row", c0 + b.c AS col, rank, cls FROM t CROSS JOIN range(0, 16) a(r) CROSS JOIN range(0, 16) b(c) WHERE cls IS NOT NULL)
SELECT "row", col, arg_min(cls, rank) AS cls FROM p GROUP BY "row", col""")
def mosaic_first(spark, sf_dir):
    return grid.mosaic(grid.paint(*_tiles(spark, sf_dir), 16))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:7], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE) + 0.001::DOUBLE) AS s FROM embeddings WHERE label <> 9),
t AS (SELECT vec_id AS rank, vec_id // 10 * 12 AS r0, vec_id % 10 * 12 AS c0, list_max(s) / list_sum(s) AS conf, list_position(s, list_max(s)) - 1 AS cls FROM e),
p AS (SELECT r0 + a.r AS "row", c0 + b.c AS col, rank, conf, cls FROM t CROSS JOIN range(0, 16) a(r) CROSS JOIN range(0, 16) b(c))
SELECT "row", col, CAST(arg_min(cls, rank) AS INT) AS cls, round(arg_min(conf, rank), 8) AS confidence FROM p GROUP BY "row", col""")
def confidence_tiles(spark, sf_dir):
    probs = fx.slices(spark, sf_dir).select(F.col("tile_id").cast("string").alias("tile_id"), F.col("a").alias("probs"))
    made = grid.products(grid.paint(probs, _tiles(spark, sf_dir)[1], 16))
    return made.select("row", "col", "cls", F.round("confidence", 8).alias("confidence"))


@query("SELECT CAST(vec_id AS VARCHAR) AS tile_id FROM embeddings WHERE label = 9")
def mosaic_unmatched(spark, sf_dir):
    return grid.unmatched(*_tiles(spark, sf_dir))


_META = "(VALUES ('a', 0, 0, 320, 320, 10.0, 10.0), ('b', 160, 160, 480, 480, 10.0, 5.0), ('c', 100, 0, 400, 330, 20.0, 20.0)) m(raster, west, south, east, north, res_x, res_y)"


def _meta(spark):
    rows = [("a", 0.0, 0.0, 320.0, 320.0, 10.0, 10.0), ("b", 160.0, 160.0, 480.0, 480.0, 10.0, 5.0), ("c", 100.0, 0.0, 400.0, 330.0, 20.0, 20.0)]
    return spark.createDataFrame(rows, "raster string, west double, south double, east double, north double, res_x double, res_y double")


@query(f"SELECT 'intersection' AS how, max(west)::DOUBLE AS west, max(south)::DOUBLE AS south, min(east)::DOUBLE AS east, min(north)::DOUBLE AS north, min(least(res_x, res_y))::DOUBLE AS res FROM {_META} UNION ALL SELECT 'union', min(west)::DOUBLE, min(south)::DOUBLE, max(east)::DOUBLE, max(north)::DOUBLE, min(least(res_x, res_y))::DOUBLE FROM {_META}")
def common_extent(spark, sf_dir):
    both = [grid.extent(_meta(spark), how).select(F.lit(how).alias("how"), "west", "south", "east", "north", "res") for how in ("intersection", "union")]
    return both[0].unionAll(both[1])


def _target(px, spark):
    """The raster's height, and cells of 4 m over all of it."""
    h = px.agg(F.max("y")).first()[0] + 5.0
    return h, grid.target(spark, 0.0, h - 4.0 * math.ceil(h / 4.0), 1000.0, h, 4.0)


_T4 = """, hh AS (SELECT max(y) + 5 AS h FROM px), tg AS (SELECT r AS "row", c AS col, (c + 0.5::DOUBLE) * 4.0::DOUBLE AS x, h - (r + 0.5::DOUBLE) * 4.0::DOUBLE AS y, h FROM (SELECT h, unnest(range(0, CAST(ceil(h / 4) AS BIGINT))) AS r FROM hh) CROSS JOIN range(0, 250) b(c)),
f AS (SELECT "row", col, (h - y) / 10.0 - 0.5::DOUBLE AS fr, x / 10.0 - 0.5::DOUBLE AS fc FROM tg), near AS (SELECT f.*, CAST(floor(fr) AS BIGINT) + a.dr AS sr, CAST(floor(fc) AS BIGINT) + b.dc AS sc FROM f CROSS JOIN range(-1, 3) a(dr) CROSS JOIN range(-1, 3) b(dc)) """


@query(PX + _T4 + 'SELECT tg."row", tg.col, coalesce(px.model_a, 255) AS cls FROM tg JOIN px ON px."row" = CAST(floor((tg.h - tg.y) / 10.0) AS BIGINT) AND px.col = CAST(floor(tg.x / 10.0) AS BIGINT)')
def resample_nearest(spark, sf_dir):
    px = classed(spark, sf_dir)
    h, cells = _target(px, spark)
    return filed(grid.resample(px, cells, 0.0, h, 10.0, "cls"))


@query(PX + _T4 + """, n AS (SELECT near."row", near.col, px.conf AS v, greatest(0, 1 - abs(fr - sr)) * greatest(0, 1 - abs(fc - sc)) AS w FROM near JOIN px ON px."row" = sr AND px.col = sc WHERE model_a IS NOT NULL)
SELECT "row", col, round(sum(v * w) / sum(w), 8) AS conf FROM n GROUP BY "row", col HAVING sum(w) <> 0""")
def resample_bilinear(spark, sf_dir):
    px = fx.pixels(spark, sf_dir).where("model_a IS NOT NULL")
    h, cells = _target(fx.pixels(spark, sf_dir), spark)
    return grid.resample(px, cells, 0.0, h, 10.0, "conf", "bilinear").select("row", "col", F.round("conf", 8).alias("conf"))


def _cubic(d: str) -> str:
    return f"(CASE WHEN abs({d}) <= 1 THEN 1.5 * abs({d}) ** 3 - 2.5 * abs({d}) ** 2 + 1 WHEN abs({d}) < 2 THEN -0.5 * abs({d}) ** 3 + 2.5 * abs({d}) ** 2 - 4 * abs({d}) + 2 ELSE 0 END)"


@query(PX + _T4 + f""", n AS (SELECT near."row", near.col, px.conf AS v, {_cubic("(fr - sr)")} * {_cubic("(fc - sc)")} AS w FROM near JOIN px ON px."row" = sr AND px.col = sc WHERE px.conf IS NOT NULL)
SELECT "row", col, round(sum(v * w) / sum(w), 8) AS conf FROM n GROUP BY "row", col HAVING sum(w) <> 0""")
def resample_cubic(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    h, cells = _target(px, spark)
    return grid.resample(px, cells, 0.0, h, 10.0, "conf", "cubic").select("row", "col", F.round("conf", 8).alias("conf"))


@query("SELECT CAST(user_id AS BIGINT) AS px, median(value) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id")
def median_composite(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("px"), F.col("value").alias("v"))
    return grid.composite(e, "px")


@query("SELECT CAST(user_id AS BIGINT) AS px, arg_max(value, ts) AS v FROM events GROUP BY user_id")
def latest_mosaic(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("px"), F.col("value").alias("v"), F.col("ts").alias("acquired"))
    return grid.latest(e, "px")


@query(_PROBS + "SELECT tile_id, CAST(i - 1 AS INT) AS band, CASE WHEN i <= 7 THEN round(p[i], 9) ELSE 0 END AS p FROM m CROSS JOIN range(1, 10) r(i)")
def probability_tiles(spark, sf_dir):
    p = fx.slices(spark, sf_dir).select("tile_id", grid.padded(votes.average(["a", "b", "c"], [2.0, 1.0, 1.0]), 9).alias("p"))
    return p.select("tile_id", F.posexplode("p").alias("band", "v")).select("tile_id", "band", F.round("v", 9).alias("p"))


@query("SELECT user_id AS px, median(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21' AND event_id % 10 < 3 AND event_id % 12 BETWEEN 4 AND 7 GROUP BY user_id")
def clear_composite(spark, sf_dir):
    i = F.col("event_id")
    scene = table(spark, sf_dir, "events").select(F.col("user_id").alias("px"), F.col("value").alias("v"), F.col("ts").cast("date").alias("acquired"), (i % 10).alias("cloud"), (i % 12).alias("scl"))
    return grid.composite(grid.clear_pixels(scene, "2024-01-03", "2024-01-20", 3), "px")


@query(PX + """, hh AS (SELECT max(y) + 5 AS h FROM px), tg AS (SELECT r AS "row", c AS col, 33.0::DOUBLE + (c + 0.5::DOUBLE) * 7.0::DOUBLE AS x, h - 21.0::DOUBLE - (r + 0.5::DOUBLE) * 3.0::DOUBLE AS y, h FROM range(0, 16) a(r) CROSS JOIN range(0, 16) b(c) CROSS JOIN hh),
f AS (SELECT "row", col, (h - y) / 10.0 - 0.5::DOUBLE AS fr, x / 10.0 - 0.5::DOUBLE AS fc FROM tg),
n AS (SELECT f."row", f.col, px.conf AS v, greatest(0, 1 - abs(fr - px."row")) * greatest(0, 1 - abs(fc - px.col)) AS w FROM f JOIN px ON px."row" IN (CAST(floor(fr) AS BIGINT), CAST(floor(fr) AS BIGINT) + 1) AND px.col IN (CAST(floor(fc) AS BIGINT), CAST(floor(fc) AS BIGINT) + 1))
SELECT "row", col, round(sum(v * w) / sum(w), 8) AS conf FROM n GROUP BY "row", col HAVING sum(w) <> 0""")
def extract_tile(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    h = px.agg(F.max("y")).first()[0] + 5.0
    return grid.extract_tile(px, 33.0, h - 69.0, 145.0, h - 21.0, 16, 0.0, h, 10.0, "conf").select("row", "col", F.round("conf", 8).alias("conf"))


# ---------------------------------------------------------------- classes and labels


def _case(mapping: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v}" for k, v in mapping.items()) + " END"


@query(f"SELECT event_id, CAST(coalesce({_case(classes.DYNAMIC_WORLD, 'event_id % 10')}, 255) AS INT) AS cls FROM events")
def class_map_dw(spark, sf_dir):
    return filed(table(spark, sf_dir, "events").select("event_id", classes.lookup(classes.DYNAMIC_WORLD, (F.col("event_id") % 10).cast("int")).alias("cls")))


@query(f"SELECT event_id, CAST(coalesce({_case(classes.WORLDCOVER, 'event_id % 22 * 5')}, 255) AS INT) AS cls FROM events")
def class_map_esa(spark, sf_dir):
    return filed(table(spark, sf_dir, "events").select("event_id", classes.lookup(classes.WORLDCOVER, (F.col("event_id") % 22 * 5).cast("int")).alias("cls")))


@query(f"SELECT event_id, CAST(coalesce({_case(classes.LEGACY, 'event_id % 9')}, 255) AS INT) AS cls FROM events")
def class_map_legacy(spark, sf_dir):
    return filed(table(spark, sf_dir, "events").select("event_id", classes.lookup(classes.LEGACY, (F.col("event_id") % 9).cast("int")).alias("cls")))


_SPELT = ["Forest", "forest", " wAtEr ", "Urban", "urban", "barren", "Grassland", "grassland", "CROPS", "x1", "shrubs", "Built", "bare", "tree_cover", "Developed"]


def _labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), "o_custkey", "o_orderpriority")
    spelt = F.get(F.array(*[F.lit(s) for s in _SPELT]), (F.col("point_id") % len(_SPELT)).cast("int"))
    return o.select("point_id", (F.col("o_custkey") % 1000).cast("double").alias("x"), (F.col("point_id") % 997).cast("double").alias("y"), spelt.alias("land_cover"))


def _alias_sql() -> str:
    table_ = {a: n for n, many in classes.ALIASES.items() for a in many}
    case = lambda v: f"CASE {v} " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in table_.items()) + " END"
    own = ", ".join(f"'{c}'" for c in classes.CLASSES)
    spelt = "[" + ", ".join(f"'{s}'" for s in _SPELT) + "]"
    return f"""WITH o AS (SELECT o_orderkey AS point_id, CAST(o_custkey % 1000 AS DOUBLE) AS x, CAST(o_orderkey % 997 AS DOUBLE) AS y, trim({spelt}[CAST(o_orderkey % {len(_SPELT)} AS INT) + 1]) AS v FROM orders),
l AS (SELECT *, coalesce({case('v')}, {case('lower(v)')}, CASE WHEN lower(v) IN ({own}) THEN lower(v) END) AS lc_name FROM o),
lab AS (SELECT point_id, x, y, lc_name, {_INDEX.format('lc_name')} AS lc_class FROM l WHERE lc_name IS NOT NULL) """


@query(_alias_sql() + "SELECT point_id, lc_name, CAST(lc_class AS INT) AS lc_class, 1.0::DOUBLE AS confidence, 'custom:orders' AS source FROM lab")
def label_alias_import(spark, sf_dir):
    return labels.imported(_labels(spark, sf_dir), "land_cover", "orders").select("point_id", "lc_name", "lc_class", "confidence", "source")


@query(_alias_sql() + """, tw AS (SELECT count(*) AS n FROM lab a JOIN lab b ON a.point_id < b.point_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 25.0)
SELECT CAST(1 AS INT) AS pos, CAST(count(*) FILTER (WHERE NOT (x > 10 AND x < 990 AND y > 10 AND y < 990)) AS VARCHAR) || ' points are outside the AOI' AS issue FROM lab HAVING count(*) FILTER (WHERE NOT (x > 10 AND x < 990 AND y > 10 AND y < 990)) > 0
UNION ALL SELECT 3, CAST(n AS VARCHAR) || ' potential duplicates (within 5.0m)' FROM tw WHERE n > 0
UNION ALL SELECT 4 + lc_class, 'Class ''' || lc_name || ''' has only ' || CAST(count(*) AS VARCHAR) || ' points (min: 1500)' FROM lab GROUP BY lc_class, lc_name HAVING count(*) < 1500""")
def label_validation(spark, sf_dir):
    points = labels.imported(_labels(spark, sf_dir), "land_cover", "orders")
    return labels.validate(points, (10.0, 10.0, 990.0, 990.0), least=1500)


@query(_alias_sql() + "SELECT a.point_id AS a, b.point_id AS b FROM lab a JOIN lab b ON a.point_id < b.point_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 4.0")
def duplicate_pairs(spark, sf_dir):
    return labels.duplicate_pairs(labels.imported(_labels(spark, sf_dir), "land_cover", "orders"), 2.0)


@query(_alias_sql() + "SELECT lc_class, 'train' AS part, greatest(1, CAST(floor(count(*) * (1 - 0.2::DOUBLE)) AS BIGINT)) AS n FROM lab GROUP BY lc_class UNION ALL SELECT lc_class, 'val', count(*) - greatest(1, CAST(floor(count(*) * (1 - 0.2::DOUBLE)) AS BIGINT)) FROM lab GROUP BY lc_class")
def stratified_split_sizes(spark, sf_dir):
    points = labels.imported(_labels(spark, sf_dir), "land_cover", "orders")
    return labels.split(points, 0.2).groupBy("lc_class", "part").agg(F.count("*").alias("n"))


@query()
def min_distance_thinning(spark, sf_dir):
    points = labels.imported(_labels(spark, sf_dir), "land_cover", "orders")
    return labels.thin(points, 15.0).select("point_id", "lc_name")


@query(_alias_sql() + "SELECT 'total' AS kind, '' AS key, count(*) AS n FROM lab UNION ALL SELECT 'sources', '', 1 UNION ALL SELECT 'class', lc_name, count(*) FROM lab GROUP BY lc_name UNION ALL SELECT 'source', 'custom:orders', count(*) FROM lab")
def label_summary(spark, sf_dir):
    return labels.summary(labels.imported(_labels(spark, sf_dir), "land_cover", "orders"))


@query(_alias_sql() + "SELECT min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM lab")
def label_bounds(spark, sf_dir):
    return labels.bounds(labels.imported(_labels(spark, sf_dir), "land_cover", "orders"))


_OBS = "WITH o AS (SELECT user_id AS px, event_id % 9 AS label, value, (event_id % 97) / 100.0::DOUBLE AS p1, (event_id % 89) / 100.0::DOUBLE AS p2 FROM events), m AS (SELECT px, label, count(*) AS n FROM o GROUP BY px, label), w AS (SELECT px, label, row_number() OVER (PARTITION BY px ORDER BY n DESC, label) AS r FROM m) "


@query(_OBS + f"SELECT CAST(o.px AS BIGINT) AS px, CAST({_case(classes.DYNAMIC_WORLD, 'any_value(w.label)')} AS INT) AS lc_class, round(greatest(avg(p1), avg(p2)), 9) AS confidence FROM o JOIN w ON o.px = w.px AND w.r = 1 GROUP BY o.px HAVING greatest(avg(p1), avg(p2)) >= 0.45")
def dynamic_world_labels(spark, sf_dir):
    i = F.col("event_id")
    o = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("px"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (i % 9).cast("int").alias("label"), ((i % 97) / 100.0).alias("p1"), ((i % 89) / 100.0).alias("p2"))
    return labels.dynamic_world(o, ["p1", "p2"], 1 << 30, 0.45).select("px", "lc_class", F.round("confidence", 9).alias("confidence"))


@query(f"SELECT c AS lc_class, least(count(*), 40) AS n FROM (SELECT CAST({_case(classes.WORLDCOVER, 'event_id % 22 * 5')} AS INT) AS c FROM events) WHERE c IS NOT NULL GROUP BY c")
def worldcover_label_counts(spark, sf_dir):
    px = table(spark, sf_dir, "events").select(F.col("event_id").alias("px"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("event_id") % 22 * 5).cast("int").alias("label"))
    return labels.worldcover(px, 40).groupBy("lc_class").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- coordinates


_LL = "(event_id % 3600) / 10.0::DOUBLE - 180 AS lon, (event_id % 1600) / 10.0::DOUBLE - 80 AS lat"


def _lonlat(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", ((i % 3600) / 10.0 - 180).alias("lon"), ((i % 1600) / 10.0 - 80).alias("lat"))


@query(f"WITH p AS (SELECT event_id, {_LL} FROM events) SELECT event_id, CASE WHEN lat >= 0 THEN 'EPSG:326' ELSE 'EPSG:327' END || lpad(CAST(CAST(floor((lon + 180) / 6) AS INT) + 1 AS VARCHAR), 2, '0') AS crs FROM p")
def utm_zone(spark, sf_dir):
    return _lonlat(spark, sf_dir).select("event_id", geo.utm_zone("lon", "lat").alias("crs"))


def _utm_sql() -> str:
    a = geo._ALPHA
    e = " + ".join(["eta", *[f"{v!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1)]])
    n = " + ".join(["xi", *[f"{v!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1)]])
    scale = geo._K0 * geo._RECT
    return f"""WITH p AS (SELECT event_id, radians(40 + (event_id % 100) / 10.0::DOUBLE) AS phi, radians((event_id % 60) / 10.0::DOUBLE - 3) AS lam FROM events),
t AS (SELECT *, sinh(atanh(sin(phi)) - {geo._EPS!r}::DOUBLE * atanh({geo._EPS!r}::DOUBLE * sin(phi))) AS t FROM p),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT event_id, round(500000.0::DOUBLE + {scale!r}::DOUBLE * ({e}), 3) AS x, round({scale!r}::DOUBLE * ({n}), 3) AS y FROM x"""


@query(_utm_sql())
def utm_project(spark, sf_dir):
    i = F.col("event_id")
    p = table(spark, sf_dir, "events").select("event_id", (-123 + (i % 60) / 10.0 - 3).alias("lon"), (40 + (i % 100) / 10.0).alias("lat"))
    x, y = geo.to_utm("lon", "lat", 10)
    return p.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT event_id, true AS lon_ok, true AS lat_ok FROM events")  # what a round trip must be: where it began
def utm_round_trip(spark, sf_dir):
    i = F.col("event_id")
    p = table(spark, sf_dir, "events").select("event_id", (-123 + (i % 60) / 10.0 - 3).alias("lon"), (40 + (i % 100) / 10.0).alias("lat"))
    x, y = geo.to_utm("lon", "lat", 10)
    q = p.select("event_id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_utm("x", "y", 10)
    return q.select("event_id", (F.abs(lon - F.col("lon")) < 1e-8).alias("lon_ok"), (F.abs(lat - F.col("lat")) < 1e-8).alias("lat_ok"))


@query(f"WITH p AS (SELECT event_id, {_LL} FROM events) SELECT event_id, round(0.5::DOUBLE * 111320.0::DOUBLE * cos(radians((lat + lat + 0.25::DOUBLE) / 2)) * 0.25::DOUBLE * 111320.0::DOUBLE / 4046.86::DOUBLE, 3) AS acres FROM p")
def bbox_acres(spark, sf_dir):
    p = _lonlat(spark, sf_dir)
    acres = geo.bbox_acres(F.lit(0.0), F.col("lat"), F.lit(0.5), F.col("lat") + 0.25)
    return p.select("event_id", F.round(acres, 3).alias("acres"))


# ---------------------------------------------------------------- preprocessing

_IMG = """WITH b AS (SELECT event_id // 64 AS t, (event_id % 64) // 8 AS "row", event_id % 8 AS col, unnest(['B2', 'B3']) AS band, value, event_id FROM events WHERE event_id < (SELECT (max(event_id) + 1) // 64 * 64 FROM events)),
i AS (SELECT CAST(t AS VARCHAR) AS tile_id, band, "row", col, CASE WHEN (event_id * 31) % 17 = 0 THEN -9999.0::DOUBLE ELSE CASE band WHEN 'B2' THEN value ELSE value * 2 END END AS v FROM b),
m AS (SELECT tile_id, band, "row", col, max(CASE WHEN v = -9999 OR v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY tile_id, "row", col) = 0 AS valid, v FROM i),
k AS (SELECT tile_id, band, "row", col, valid, CASE WHEN valid THEN v ELSE 0 END AS v FROM m) """


def _image(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    n = (e.agg(F.max("event_id")).first()[0] + 1) // 64 * 64
    i = F.col("event_id")
    v = F.when((i * 31) % 17 == 0, F.lit(-9999.0)).otherwise(F.when(F.col("band") == "B2", F.col("value")).otherwise(F.col("value") * 2))
    return e.where(i < n).withColumn("band", F.explode(F.array(F.lit("B2"), F.lit("B3")))).select(F.floor(i / 64).cast("string").alias("tile_id"), "band", F.floor(i % 64 / 8).cast("long").alias("row"), (i % 8).alias("col"), v.alias("v"))


@query(_IMG + """, z AS (SELECT tile_id, band, "row", col, valid, CASE band WHEN 'B2' THEN (v - 10.0) / 2.5::DOUBLE ELSE (v - 20.0) / 5.0::DOUBLE END AS v FROM k)
SELECT tile_id, band, "row", col, valid, round(v, 9) AS v FROM z""")
def preprocess_normalize(spark, sf_dir):
    out = preprocess.normalised(preprocess.masked(_image(spark, sf_dir), -9999.0), ["B2", "B3"], [10.0, 20.0], [2.5, 5.0])
    return out.select("tile_id", "band", "row", "col", "valid", F.round("v", 9).alias("v"))


@query(_IMG + 'SELECT k.tile_id, k.band, a.r AS "row", b.c AS col, k.v FROM k JOIN range(0, 5) a(r) ON k."row" = least(CAST(floor(a.r * 8 / 5.0) AS BIGINT), 7) JOIN range(0, 5) b(c) ON k.col = least(CAST(floor(b.c * 8 / 5.0) AS BIGINT), 7)')
def resize_nearest(spark, sf_dir):
    return preprocess.resized(preprocess.masked(_image(spark, sf_dir), -9999.0), 8, 8, 5).select("tile_id", "band", "row", "col", "v")


@query(_IMG + 'SELECT tile_id, band, "row", col, round(CASE WHEN valid THEN v ELSE coalesce(avg(CASE WHEN valid THEN v END) OVER (PARTITION BY tile_id, band), v) END, 6) AS v FROM k')
def fill_invalid(spark, sf_dir):
    out = preprocess.filled(preprocess.masked(_image(spark, sf_dir), -9999.0))
    return out.select("tile_id", "band", "row", "col", F.round("v", 6).alias("v"))


# ---------------------------------------------------------------- tiles

_LOG = "WITH g AS (SELECT event_id, CAST(user_id AS VARCHAR) AS tile_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.STATES.items()) + " ELSE 'failed' END AS status, ts FROM events), last AS (SELECT tile_id, status, ts, count(*) OVER (PARTITION BY tile_id) AS n_updates, row_number() OVER (PARTITION BY tile_id ORDER BY ts DESC, event_id DESC) AS r FROM g) "


@query(_LOG + "SELECT tile_id, status, ts, n_updates FROM last WHERE r = 1")
def tile_latest_status(spark, sf_dir):
    return tiles.latest(fx.status_log(spark, sf_dir))


@query(_LOG + f"SELECT s.status, count(last.tile_id) AS n FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in tiles.STATUSES)}) s(status) LEFT JOIN last ON last.status = s.status AND r = 1 GROUP BY s.status UNION ALL SELECT 'total', count(*) FROM last WHERE r = 1")
def tile_progress(spark, sf_dir):
    return tiles.progress(tiles.latest(fx.status_log(spark, sf_dir)))


@query(_LOG + "SELECT DISTINCT tile_id FROM g WHERE tile_id NOT IN (SELECT tile_id FROM last WHERE r = 1 AND status = 'embedded')")
def resume_pending(spark, sf_dir):
    log = fx.status_log(spark, sf_dir)
    done = tiles.latest(log).where("status = 'embedded'").select("tile_id", F.lit("completed").alias("status"))
    return tiles.pending(log.select("tile_id").distinct(), done)


# ---------------------------------------------------------------- models


@query("SELECT CAST(vec_id AS VARCHAR) AS tile_id, CAST(label % 7 AS INT) AS cls, len(embedding) AS dim FROM embeddings WHERE vec_id % 3 <> 0")
def embedding_label_join(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    out = ml.matched(e, e.where(F.col("tile_id").cast("long") % 3 != 0).select("tile_id", "cls"))
    return out.select("tile_id", "cls", F.size("embedding").cast("long").alias("dim"))


@query(_PROBS + "SELECT CAST(list_position(p, list_max(p)) - 1 AS INT) AS cls, count(*) AS n, round(avg(list_max(p)), 6) AS mean_confidence FROM m GROUP BY 1")
def class_distribution(spark, sf_dir):
    p = fx.slices(spark, sf_dir).select(votes.average(["a", "b", "c"], [2.0, 1.0, 1.0]).alias("p"))
    return ml.distribution(p.select(votes.argmax(F.col("p")).alias("cls"), F.array_max("p").alias("confidence")))


def _fitted(kind: str, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = labels.split(fx.embeddings(spark, sf_dir), 0.2, by="cls", id_col="tile_id").persist()
        model = ml.train(rows.where("part = 'train'"), kind, **params)
        test = rows.where("part = 'val'")
        return ml.evaluate(ml.predict(model, test), test).select(F.lit(kind).alias("model"), "n", "accuracy", "kappa")

    return run


QUERIES |= {"train_rf": _fitted("random_forest", trees=20, depth=8), "train_linear": _fitted("logistic", iterations=50), "train_mlp": _fitted("mlp", hidden=(32,), iterations=30), "train_gbt": _fitted("boosted", rounds=3, depth=3)}


@query()
def cv_stratified(spark, sf_dir):
    folds = ml.cross_validate(fx.embeddings(spark, sf_dir), "logistic", k=3, iterations=20)
    return metrics.fold_summary(folds, "accuracy", "kappa", "f1_macro")


def _located(spark, sf_dir):
    """Embeddings placed on a 50 x n grid of 100 m."""
    e = fx.embeddings(spark, sf_dir)
    i = F.col("tile_id").cast("long")
    return e.withColumn("x", (i % 50 * 100).cast("double")).withColumn("y", (F.floor(i / 50) * 100).cast("double"))


@query()
def cv_spatial(spark, sf_dir):
    rows = ml.spatial_folds(_located(spark, sf_dir), k=3, buffer=150.0)
    return ml.cross_validate(rows, "logistic", k=3, fold_col="fold", iterations=20).select("fold", "n", "accuracy")


@query("WITH p AS (SELECT vec_id, CAST(vec_id % 50 * 100 AS DOUBLE) AS x, CAST(vec_id // 50 * 100 AS DOUBLE) AS y FROM embeddings) SELECT vec_id AS point_id FROM p WHERE vec_id % 5 <> 0 AND EXISTS (SELECT 1 FROM p t WHERE t.vec_id % 5 = 0 AND (t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) < 150.0 * 150.0)")
def spatial_buffer_exclusion(spark, sf_dir):
    p = _located(spark, sf_dir).select(F.col("tile_id").cast("long").alias("point_id"), "x", "y")
    return labels.near_any(p.where("point_id % 5 <> 0"), p.where("point_id % 5 = 0").select("x", "y"), 150.0).select("point_id")


@query()
def tile_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 64).alias("k"), F.floor(F.col("event_id") / 64).cast("string").alias("tile_id"), "value")
    whole = e.groupBy("tile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda s: s["value"].cast("float")).alias("data"))  # 64 values a tile
    model = embed.PatchProjection("small", 1, 8, 16, 4, 1)
    out = embed.embed(whole, model, 1, 8, 8)
    return out.select("tile_id", F.size("embedding").alias("dim"), "error")


@query("SELECT o_orderpriority AS raw, regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '_', 'g') AS safe, count(*) AS n FROM orders GROUP BY 1, 2")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("raw"), geo.safe_name("o_orderpriority").alias("safe")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), 0) AS DOUBLE) AS d, CAST(coalesce(TRY_CAST(substr(o_orderpriority, 2, 2) AS INT), 0) AS INT) AS i FROM orders")
def safe_casts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", geo.safe_double("substr(o_orderpriority, 1, 1)").alias("d"), geo.safe_int("substr(o_orderpriority, 2, 2)").alias("i"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def bulk_group_by(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
