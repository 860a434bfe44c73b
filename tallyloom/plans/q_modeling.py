"""Queries of modelling and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import dot, unit
from ..operators import comparisons as cmp
from ..operators import features as fe
from ..operators import modeling as ml
from ..operators.quantiles import table_quantiles
from ..operators.stats import spearman
from . import bindings
from .common import duck, floats, measured, settled, table, tidy
from .q_retrieval import vectors, with_vector_keys

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


MODELLED = ["video_id", "author_id", "brand", "wer", "author_follower_count", "video_duration_sec", "post_hour", "is_official_brand", "content_type", "brand_styles", "source_type"]


def frame(spark, sf):
    """Posts with a value and their vectors."""
    p = fe.with_time_parts(vectors(spark, sf))
    return settled(p.where("wer is not null").select(*MODELLED, "text_vec", "visual_vec"))


def bare_frame(spark, sf):
    """Posts with a value, for learners that read no vectors: ``author_folds`` writes them."""
    p = fe.with_time_parts(fe.with_engagement(bindings.posts(spark, sf, once=True)))
    return p.where("wer is not null").select(*MODELLED)


def plain():
    return ml.FoldFeatures(numbers=["author_follower_count", "video_duration_sec"], angles={"post_hour": 24}, flags=["is_official_brand"], lists=["content_type"], categories=["source_type", "brand"])


def full():
    return ml.FoldFeatures(numbers=["author_follower_count", "video_duration_sec"], angles={"post_hour": 24}, flags=["is_official_brand"], lists=["content_type", "brand_styles"], categories=["source_type", "brand"], vectors={"text_vec": 4, "visual_vec": 4})


@query("ml01_model_frame", duck("SELECT count(*) AS rows, count(*) FILTER (wer IS NULL) AS no_target, count(*) FILTER (wer IS NOT NULL AND CAST(video_id AS BIGINT) % 7 = 0) AS bad_vector, count(*) FILTER (wer IS NOT NULL AND CAST(video_id AS BIGINT) % 7 <> 0) AS kept FROM m"))
def _(spark, sf):
    return ml.model_frame(vectors(spark, sf), "wer", ["text_vec"])[1]


@query("ml02_leakage_guard", duck("SELECT count(*) AS n, true AS refused FROM posts"))
def _(spark, sf):
    try:
        ml.check_leakage(["post_hour", "view_count"])
        refused = False
    except ValueError:
        refused = True
    return measured(spark, sf).agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query("ml03_fold_features", None)
def _(spark, sf):
    rows = ml.author_folds(frame(spark, sf))
    built = full().fit(rows.where("fold <> 0"))
    out = built.transform(rows.where("fold = 0"))
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return out.select("video_id", F.size(v).alias("size"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("ml04_targets", duck("SELECT video_id, ln(1 + wer) AS log1p, ln(wer + 1e-6) AS log, exp(ln(1 + wer)) - 1 AS back FROM m WHERE wer IS NOT NULL", "log1p", '"log"', "back").replace('round("log", 6) + 0.0 AS "log"', 'round("log", 6) + 0.0 AS log'))
def _(spark, sf):
    w = F.col("wer")
    return measured(spark, sf).where("wer is not null").select("video_id", ml.to_target(w, "log1p").alias("log1p"), ml.to_target(w, "log").alias("log"), ml.from_target(ml.to_target(w, "log1p"), "log1p").alias("back"))


TRAIN = "SELECT * FROM m WHERE wer IS NOT NULL AND CAST(video_id AS BIGINT) % 5 <> 0"
TEST = "SELECT * FROM m WHERE wer IS NOT NULL AND CAST(video_id AS BIGINT) % 5 = 0"


def split(spark, sf):
    rows = measured(spark, sf).where("wer is not null")
    fold = F.col("video_id").cast("long") % 5
    return rows.where(fold != 0), rows.where(fold == 0)


@query("ml05_train_baseline", duck(f"SELECT video_id, wer / nullif(b, 0) AS bri FROM ({TEST}) t JOIN (SELECT brand, median(wer) AS b FROM ({TRAIN}) GROUP BY brand) x ON t.brand IS NOT DISTINCT FROM x.brand", "bri"))
def _(spark, sf):
    from ..functions.numbers import ratio

    train, test = split(spark, sf)
    return ml.train_baseline(train, test, "wer").select("video_id", ratio(F.col("wer"), F.col("baseline")).alias("bri"))


@query("ml06_target_prior", duck(f"SELECT video_id, COALESCE((sum(wer) OVER w - wer) / nullif(count(*) OVER w - 1, 0), avg(wer) OVER ()) AS prior FROM ({TRAIN}) WINDOW w AS (PARTITION BY author_id) UNION ALL SELECT video_id, COALESCE(g, (SELECT avg(wer) FROM ({TRAIN}))) FROM ({TEST}) LEFT JOIN (SELECT author_id, avg(wer) AS g FROM ({TRAIN}) GROUP BY 1) USING (author_id)", "prior"))
def _(spark, sf):
    a, b = ml.target_prior(*split(spark, sf), "author_id", "wer", "prior")
    return a.select("video_id", "prior").unionByName(b.select("video_id", "prior"))


@query("ml07_shrunken_prior", duck(f"SELECT video_id, (COALESCE(s, 0) + 10 * ps / pn) / (COALESCE(n, 0) + 10) AS prior FROM ({TEST}) t JOIN (SELECT source_type AS p, sum(wer) AS ps, count(*) AS pn FROM ({TRAIN}) GROUP BY 1) ON source_type = p LEFT JOIN (SELECT source_type AS q, author_id AS c, sum(wer) AS s, count(*) AS n FROM ({TRAIN}) GROUP BY ALL) ON source_type = q AND author_id = c UNION ALL SELECT video_id, (sum(wer) OVER o - wer + 10 * (sum(wer) OVER p - wer) / (count(*) OVER p - 1)) / (count(*) OVER o - 1 + 10) FROM ({TRAIN}) WINDOW o AS (PARTITION BY source_type, author_id), p AS (PARTITION BY source_type)", "prior"))
def _(spark, sf):
    a, b = ml.shrunken_prior(*split(spark, sf), "source_type", "author_id", "wer", 10.0, "prior")
    return a.select("video_id", "prior").unionByName(b.select("video_id", "prior"))


@query("ml08_author_folds", duck("SELECT count(*) AS n, count(DISTINCT author_id) AS authors, 5 AS folds, 0 AS in_two_folds, true AS balanced FROM m WHERE wer IS NOT NULL"))
def _(spark, sf):
    rows = settled(ml.author_folds(frame(spark, sf)))
    sizes = ml.fold_balance(rows, "wer")
    spread = sizes.agg(F.count("*").alias("folds"), (F.max("n") <= 1.05 * F.min("n")).alias("balanced"))
    twice = rows.groupBy("author_id").agg(F.count_distinct("fold").alias("k")).agg(F.count("*").alias("authors"), F.count_if(F.col("k") > 1).alias("in_two_folds"))
    return rows.agg(F.count("*").alias("n")).crossJoin(twice).crossJoin(spread)  # one row each


@query("ml09_regression_cv", None)
def _(spark, sf):
    rows = ml.author_folds(bare_frame(spark, sf), 3)
    return ml.regression_metrics(ml.regression_cv(rows, "wer", 3, plain, keep=["video_id"]), by=["fold"])


@query("ml10_holdout", None)
def _(spark, sf):
    rows = ml.author_folds(bare_frame(spark, sf), 5)
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    built = plain().fit(train)
    fitted = ml.REGRESSORS["forest"]().fit(built.transform(train).withColumn("label", F.log1p("wer")))
    return ml.regression_metrics(fitted.transform(built.transform(test)).select(F.col("wer").alias("y"), F.expm1("prediction").alias("pred")))


@query("ml11_regression_metrics", floats("SELECT count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))) AS rmsle, avg(abs(ln(1 + y) - ln(1 + p))) AS mae_log, avg(COALESCE(2 * abs(y - p) / nullif(abs(y) + abs(p), 0), 0)) AS smape, corr(ry, rp) AS spearman FROM (SELECT *, avg(r0) OVER (PARTITION BY y) AS ry, avg(r1) OVER (PARTITION BY p) AS rp FROM (SELECT *, row_number() OVER (ORDER BY y) AS r0, row_number() OVER (ORDER BY p) AS r1 FROM (SELECT l_quantity AS y, l_linenumber * 7 AS p FROM lineitem)))", "mae", "rmse", "rmsle", "mae_log", "smape", "spearman"))
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_linenumber") * 7).alias("pred"))
    return ml.regression_metrics(rows).crossJoin(spearman(rows, "pred", "y").select(F.col("rho").alias("spearman")))  # one row each


@query("ml12_two_stage", None)
def _(spark, sf):
    return ml.regression_metrics(ml.two_stage_cv(ml.author_folds(bare_frame(spark, sf), 2), "wer", 2, plain, keep=["video_id"]))


@query("ml13_quantile_classes", floats("SELECT o_orderkey, (CAST(o_totalprice > e[1] AS INT) + CAST(o_totalprice > e[2] AS INT) + CAST(o_totalprice > e[3] AS INT))::BIGINT AS class FROM orders CROSS JOIN (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders WHERE o_orderkey % 5 <> 0)"))
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", ml.digitize(F.col("o_totalprice"), ml.quantile_edges(o.where("o_orderkey % 5 <> 0"), "o_totalprice", 4)).alias("class"))


@query("ml14_ml18_quantile_class_cv", None)
def _(spark, sf):
    scored = ml.quantile_class_cv(ml.author_folds(bare_frame(spark, sf), 2), "wer", 2, plain, keep=["video_id"])
    c = ml.calibrate(scored, 4)
    return c.select("video_id", "y", "pred", "expected", "mapped", "chosen", F.aggregate("calibrated", F.lit(0.0), lambda a, x: a + x).alias("total"))


GRADED = "SELECT o_orderkey, o_custkey % 3 AS fold, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS y, (o_orderkey % 90 + 5) / 100.0 AS p0 FROM orders"


def graded_orders(spark, sf):
    price, p0 = F.col("o_totalprice"), (F.col("o_orderkey") % 90 + 5) / F.lit(100.0)
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("fold"), F.when(price > 200000, 2).when(price > 100000, 1).otherwise(0).alias("y"), F.array(p0, (1 - p0) / 4, (1 - p0) * 3 / 4).alias("p"))


@query("ml18_calibration_map", f"SELECT CAST(fold AS BIGINT) AS fold, c AS class, 1024 AS bins, true AS monotone, true AS in_range FROM (SELECT DISTINCT fold FROM ({GRADED})) CROSS JOIN (VALUES (0), (1), (2)) AS k(c)")
def _(spark, sf):
    found = ml.calibration_map(graded_orders(spark, sf), 3)
    before = F.lag("value").over(Window.partitionBy("fold", "class").orderBy("bin"))  # 1,024 bins
    found = found.withColumn("falls", F.col("value") < before - 1e-12)
    return found.groupBy("fold", "class").agg(F.count("*").alias("bins"), (F.count_if("falls") == 0).alias("monotone"), (F.count_if(F.col("value").between(0, 1)) == F.count("*")).alias("in_range"))


@query("ml15_auc_of_classes", floats(f"SELECT avg(a) AS auc_ovr FROM (SELECT c, (sum(CASE WHEN hit = 1 THEN rk END) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) - sum(hit))) AS a FROM (SELECT c, hit, avg(r0) OVER (PARTITION BY c, s) AS rk FROM (SELECT c, hit, s, row_number() OVER (PARTITION BY c ORDER BY s) AS r0 FROM (SELECT c, CAST(y = c AS INT) AS hit, round(CASE c WHEN 0 THEN p0 WHEN 1 THEN (1 - p0) / 4 ELSE (1 - p0) * 3 / 4 END, 9) AS s FROM ({GRADED}) CROSS JOIN (VALUES (0), (1), (2)) AS k(c)))) GROUP BY c)", "auc_ovr"))
def _(spark, sf):
    rows = graded_orders(spark, sf)
    return ml.auc_of_classes(rows.withColumn("p", F.transform("p", lambda x: F.round(x, 9))))


PRED = "SELECT o_orderkey % 3 AS y, (o_custkey % 4 + o_orderkey) % 3 AS p FROM orders"


@query("ml15_class_metrics", floats(f"SELECT sum(tp) / sum(yes) AS accuracy, avg(2 * tp / (yes + said)) AS macro_f1, max(CASE WHEN c = 2 THEN tp / yes END) AS top_recall, max(CASE WHEN c = 2 THEN tp / said END) AS top_precision FROM (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y = c) AS yes, count(*) FILTER (p = c) AS said FROM ({PRED}) CROSS JOIN (VALUES (0), (1), (2)) AS k(c) GROUP BY c)", "accuracy", "macro_f1", "top_recall", "top_precision"))
def _(spark, sf):
    o = table(spark, sf, "orders")
    return ml.class_metrics(o.select((F.col("o_orderkey") % 3).alias("y"), ((F.col("o_custkey") % 4 + F.col("o_orderkey")) % 3).alias("pred")))


SCORED = "SELECT event_id, CAST(event_type = 'purchase' OR value > 40 AS INT) AS y, round(value) AS score FROM events"


def scored_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", ((F.col("event_type") == "purchase") | (F.col("value") > 40)).cast("int").alias("y"), F.round("value").alias("score"))


@query("ml15_auc", floats(f"SELECT (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT y, avg(r0) OVER (PARTITION BY score) AS rk FROM (SELECT *, row_number() OVER (ORDER BY score) AS r0 FROM ({SCORED})))", "auc"))
def _(spark, sf):
    return ml.auc(scored_events(spark, sf))


@query("ml16_lift", floats(f"SELECT '' AS \"group\", fraction, n, m, base_rate, avg(y) AS precision, avg(y) / base_rate AS lift FROM (SELECT *, greatest(1, CAST(round_even(n * fraction, 0) AS BIGINT)) AS m FROM (SELECT y, row_number() OVER (ORDER BY score DESC, event_id) AS r, count(*) OVER () AS n, avg(y) OVER () AS base_rate FROM ({SCORED})) CROSS JOIN (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.2)) AS f(fraction)) WHERE r <= m GROUP BY fraction, n, m, base_rate", "base_rate", "precision", "lift", "fraction").replace('round(precision, 6) + 0.0 AS precision', 'round("precision", 6) + 0.0 AS precision').replace("avg(y) AS precision", 'avg(y) AS "precision"'))
def _(spark, sf):
    return ml.lift_at(scored_events(spark, sf), [0.05, 0.1, 0.2], key="event_id")


CURVE = f"SELECT score AS threshold, sum(sum(y)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) - sum(sum(y)) OVER (ORDER BY score DESC) AS fp FROM ({SCORED}) GROUP BY score"


@query("ml17_best_threshold", floats(f"SELECT threshold, tp / (tp + fp) AS prec, tp / (SELECT sum(y) FROM ({SCORED})) AS recall FROM ({CURVE}) WHERE tp / (tp + fp) >= 0.5 ORDER BY recall DESC, prec DESC, threshold DESC LIMIT 1", "threshold", "prec", "recall"))
def _(spark, sf):
    return ml.best_threshold(scored_events(spark, sf), 0.5).select("threshold", F.col("precision").alias("prec"), "recall")


@query("ml19_ml20_screening", None)
def _(spark, sf):
    rows = ml.author_folds(bare_frame(spark, sf), 3)
    return ml.rank_models(ml.compare(rows, "wer", 3, {"plain logistic": (plain, "logistic"), "plain trees": (plain, "gbt"), "plain forest": (plain, "forest")}))


# --- comparison tables ------------------------------------------------------------------------

FOLDS = 2
METADATA = ["author_follower_count", "video_duration_sec", "post_hour", "post_weekday", "is_official_brand", "source_type", "brand"]
LABELS = ["content_type", "brand_styles", "product_lines"]
CROSSES = ["brand_x_content", "brand_x_style", "content_x_duration", "content_x_hour", "brand_x_hour", "style_x_duration"]
RUNGS = {"M0 metadata": METADATA, "M1 labels": LABELS, "M2 text vectors": ["text_vec"], "M3a visual axes": ["visual_format"], "M3b visual vectors": ["visual_vec"], "M4 alignment": ["alignment"]}
LEARNERS = ["gbt", "forest", "logistic"]


def everything(shared=None):
    return ml.FoldFeatures(shared=shared, numbers=["author_follower_count", "video_duration_sec", "alignment"], angles={"post_hour": 24, "post_weekday": 7}, flags=["is_official_brand", "is_weekend"], lists=LABELS, categories=["source_type", "brand", "visual_format", *CROSSES], vectors={"text_vec": 4, "visual_vec": 4})


#: The fold of an author is one that SQL can tell as well.
FOLD = f"CAST(floor(CAST(author_id AS BIGINT) / 7) % {FOLDS} AS INT)"


def fold_cache(spark, sf):
    """Features of all posts with a value.  Posts share the vectors of a table, so they carry the vectors' keys; an
    alignment is found once for each pair of keys."""
    p = fe.with_engagement(with_vector_keys(spark, sf, bindings.posts(spark, sf))).where("wer is not null")
    # written before the crosses, as the code of both at once is too long for the JVM to compile
    p = settled(p.select("video_id", "author_id", "wer", "create_time_ts", "author_follower_count", "video_duration_sec", "is_official_brand", "source_type", "brand", *LABELS, "visual_format", "t_id", "v_id"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    one, other = (e.select(F.col("key").alias(f"_{n}"), unit(F.col("vector")).alias(f"{n}_unit")) for n in ("t_id", "v_id"))
    pairs = p.select(F.col("t_id").alias("_t_id"), F.col("v_id").alias("_v_id")).distinct().join(one, "_t_id").join(other, "_v_id")
    pairs = settled(pairs.select("_t_id", "_v_id", dot(F.col("t_id_unit"), F.col("v_id_unit")).alias("alignment")))
    rows = fe.with_crosses(p).join(pairs, (F.col("t_id") == F.col("_t_id")) & (F.col("v_id") == F.col("_v_id")), "left").withColumn("fold", F.expr(FOLD))
    rows = settled(rows.select("video_id", "author_id", "wer", "fold", "alignment", "is_weekend", "week_start", *METADATA, *LABELS, "visual_format", *CROSSES, "t_id", "v_id"))
    features = lambda: everything({"text_vec": ("t_id", e), "visual_vec": ("v_id", e)})
    return cmp.FoldCache(rows, FOLDS, features, ["video_id", "author_id", "brand", "week_start", "wer"])


TABLES = {
    "decision_layer": lambda c: cmp.decision_layer(c, "wer", "video_id", "brand", "author_id"),
    "feature_ablation": lambda c: cmp.screened(c, "wer", "video_id", {"base": ([*METADATA, *LABELS, "text_vec"], "logistic"), "+crosses": ([*METADATA, *LABELS, "text_vec", *CROSSES], "logistic"), "+visual": ([*METADATA, *LABELS, "text_vec", "visual_vec"], "logistic"), "+crosses+visual": ([*METADATA, *LABELS, "text_vec", *CROSSES, "visual_vec"], "logistic")}, 0.75),
    "modality_ladder": lambda c: cmp.ladder(c, "wer", "video_id", RUNGS),
    "champion": lambda c: cmp.champion_and_challengers(c, "wer", "video_id", LEARNERS),
    "class_and_rank": lambda c: cmp.classes_and_ranks(c, "wer", "video_id", ["week_start", "brand"]),
    "recipes": lambda c: cmp.recipes(c, "wer", "video_id", "brand", "author_id", "brand"),
}
_CACHES, _PREDICTED = {}, {}


def cached(spark, sf):
    """The session's fold cache of these tables."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _CACHES:
        _CACHES.clear()
        _PREDICTED.clear()
        _CACHES[at] = fold_cache(spark, sf)
    return _CACHES[at]


def predicted(spark, sf, table):
    """Out-of-fold predictions of a comparison; within a session its two queries read the same written table."""
    cache = cached(spark, sf)
    if table not in _PREDICTED:
        _PREDICTED[table] = TABLES[table](cache)
    return _PREDICTED[table]


R = f"r AS (SELECT video_id, brand, wer, (CAST(author_id AS BIGINT) // 7) % {FOLDS} AS fold FROM m WHERE wer IS NOT NULL)"


def _checks(labels, hit=None, q=0.75):
    """SQL: every variant predicts every row once, in the fold of its author, within range; and how many are hits of the
    event that the other fold's quantile sets."""
    names = ", ".join(f"('{n}')" for n in labels)
    share = f", avg(rate) AS base_rate" if hit else ""
    cuts = f", e AS (SELECT f AS fold, (SELECT quantile_cont(wer, {q}) FROM r WHERE fold <> f) AS cut FROM (SELECT unnest(range({FOLDS})) AS f))"
    rate = f", avg(CASE WHEN wer {hit} cut THEN 1.0 ELSE 0.0 END) AS rate" if hit else ""
    text = f"SELECT label, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS keys, count(*) AS folds, true AS in_range{share} FROM (SELECT fold, count(*) AS n{rate} FROM r JOIN e USING (fold) GROUP BY fold) CROSS JOIN (VALUES {names}) AS l(label) GROUP BY label"
    sql = duck("@@", *(["base_rate"] if hit else []))
    return sql.replace("@@", text).replace("comments AS (", f"{R}{cuts}, comments AS (", 1)


def checked(rows, in_range, hit=None):
    rate = [F.avg(hit.cast("double")).alias("rate")] if hit is not None else []
    by = rows.groupBy("label", "fold").agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("keys"), F.min(in_range).alias("in_range"), *rate)
    return by.groupBy("label").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.count("*").alias("folds"), F.min("in_range").alias("in_range"), *([F.avg("rate").alias("base_rate")] if rate else []))


DECISIONS = ["classes", "classes+shrinkage", "classes+isotonic", "classes+shrinkage+isotonic"]


@query("ml21_decision_layer", None)
def _(spark, sf):
    return cmp.decision_metrics(predicted(spark, sf, "decision_layer"), "video_id")


@query("ml21_decision_layer_checks", _checks(DECISIONS, ">"))
def _(spark, sf):
    rows = predicted(spark, sf, "decision_layer")
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return checked(rows, F.abs(total - 1) < 1e-6, F.col("y") == F.col("classes") - 1)


for _name, _labels, _q in (("feature_ablation", ["base", "+crosses", "+visual", "+crosses+visual"], 0.75), ("modality_ladder", list(RUNGS), 0.9), ("champion", ["champion: classes", *[f"challenger: {m}" for m in LEARNERS]], 0.75)):

    @query(f"ml21_{_name}", None)
    def _(spark, sf, name=_name):
        rows = predicted(spark, sf, name)
        return cmp.ladder_metrics(rows, "video_id", list(RUNGS)) if name == "modality_ladder" else cmp.by_protocol(cmp.screening_metrics(rows, "video_id"))

    @query(f"ml21_{_name}_checks", _checks(_labels, ">=", _q))
    def _(spark, sf, name=_name):
        return checked(predicted(spark, sf, name), F.col("score").between(0, 1), F.col("y") == 1)


@query("ml21_class_and_rank", None)
def _(spark, sf):
    return cmp.class_and_rank_metrics(predicted(spark, sf, "class_and_rank"))


@query("ml21_class_and_rank_checks", _checks(["regression", "classes 4", "classes 5", "ranks by week_start", "ranks by brand"]))
def _(spark, sf):
    return checked(predicted(spark, sf, "class_and_rank"), F.col("pred") >= 0)


@query("ml21_recipes", None)
def _(spark, sf):
    return cmp.value_metrics(predicted(spark, sf, "recipes"), "baseline").orderBy("mae")


NAIVE = "b AS (SELECT f AS fold, COALESCE(brand, '') AS bb, median(wer) AS med FROM r JOIN (SELECT unnest(range(2)) AS f) ON r.fold <> f GROUP BY f, COALESCE(brand, '')), p AS (SELECT r.fold, wer AS y, med AS p, med AS base FROM r JOIN b ON r.fold = b.fold AND COALESCE(r.brand, '') = bb)"


@query("ml21_naive_baseline", duck("SELECT avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape, avg(mae_bri) AS mae_bri, CAST(sum(n) AS BIGINT) AS n FROM (SELECT fold, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(COALESCE(2 * abs(y - p) / nullif(abs(y) + abs(p), 0), 0)) AS smape, avg(abs(y / base - p / base)) AS mae_bri FROM p GROUP BY fold)", "mae", "rmse", "smape", "mae_bri").replace("comments AS (", f"{R}, {NAIVE}, comments AS (", 1))
def _(spark, sf):
    rows = fe.with_engagement(bindings.posts(spark, sf)).where("wer is not null").withColumn("fold", F.expr(FOLD))
    rows = settled(rows.select("video_id", "brand", "wer", "fold"))
    folds = [cmp.Fold(i, rows.where(F.col("fold") != i), rows.where(F.col("fold") == i), []) for i in range(FOLDS)]
    rows = settled(cmp.naive_baseline(folds, "wer", "video_id", "brand").withColumn("label", F.lit("naive brand median")))
    return cmp.value_metrics(rows, "baseline").select("mae", "rmse", "smape", "mae_bri").crossJoin(rows.agg(F.count("*").alias("n")))  # one row each


@query("ml21_recipes_checks", _checks(["raw target", "log1p target", "log target", "raw target, priors", "log target, priors", "forest, raw target, priors", "two stages", "ranks by brand", "naive brand median"]))
def _(spark, sf):
    return checked(predicted(spark, sf, "recipes"), F.col("pred") >= 0)


@query("ml09_gain_importances", "SELECT true AS sums_to_one, 0 AS negative")
def _(spark, sf):
    found = cmp.gain_importances(cached(spark, sf), "wer", columns=[*METADATA, *LABELS])
    return found.agg((F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"), F.count_if(F.col("importance") < 0).alias("negative"))


@query("ml09_ml24_importance_families", None)
def _(spark, sf):
    found = cmp.gain_importances(cached(spark, sf), "wer")
    families = [(c, f) for f, cs in {"metadata": METADATA, "labels": LABELS, "crosses": CROSSES, "vectors": ["text_vec", "visual_vec", "alignment"], "visual axes": ["visual_format"]}.items() for c in cs]
    return ml.driver_families(found.select("feature", "importance"), spark.createDataFrame(families, "prefix string, family string"))


@query("ml26_permutation_importances", None)
def _(spark, sf):
    return cmp.permutation_importances(cached(spark, sf), "wer", "video_id", "forest")


@query("ml22_random_search", "SELECT 20 AS trials, 1 AS winners, true AS halved, true AS in_range")
def _(spark, sf):
    found = settled(cmp.search(cached(spark, sf), "wer", "video_id", 20, [*METADATA, *LABELS]))
    rungs = found.groupBy("rung").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    halved = rungs.agg(F.min((F.col("k") == F.greatest(F.lit(1), F.floor(F.col("n") / 2)))).alias("halved"))
    best = found.agg(F.count_distinct("trial").alias("trials"), F.max("rung").alias("last"), F.min(F.col("lift_10").between(0, 10.5)).alias("in_range"))
    winners = found.orderBy(F.desc("lift_10"), "trial").limit(1).agg(F.count("*").alias("winners"))
    return best.crossJoin(halved).crossJoin(winners).select("trials", "winners", "halved", "in_range")  # one row each


@query("ml22_search_rungs", None)
def _(spark, sf):
    return cmp.search(cached(spark, sf), "wer", "video_id", 6, [*METADATA, *LABELS])


@query("ml23_ranking", None)
def _(spark, sf):
    return ml.ranking_cv(ml.author_folds(bare_frame(spark, sf), 2), "wer", "author_id", 2, plain, ["video_id"])


@query("ml24_driver_families", floats("SELECT family, sum(importance) AS importance, count(*) AS features, sum(importance) / sum(sum(importance)) OVER () AS share FROM (SELECT CASE WHEN p_name LIKE 'red w%' THEN 'red widget' WHEN p_name LIKE 'red%' THEN 'red' WHEN p_name LIKE 'blue%' THEN 'blue' ELSE 'other' END AS family, importance FROM (SELECT p_name, sum(p_retailprice) AS importance FROM part GROUP BY 1)) GROUP BY family", "importance", "share"))
def _(spark, sf):
    imp = table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return ml.driver_families(imp, spark.createDataFrame([("red", "red"), ("red w", "red widget"), ("blue", "blue")], "prefix string, family string"))


@query("ml25_directional_effects", floats("SELECT feature, kind, avg(c) FILTER (CASE kind WHEN 'flag' THEN x > 0 ELSE x >= e[2] END) AS high, avg(c) FILTER (CASE kind WHEN 'flag' THEN x <= 0 ELSE x <= e[1] END) AS low, avg(abs(c)) AS importance FROM (SELECT event_type AS feature, CASE WHEN event_type = 'click' THEN 'flag' ELSE 'number' END AS kind, CAST(user_id % 5 - CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS DOUBLE) AS x, value - 20 AS c FROM events) JOIN (SELECT event_type AS feature, quantile_cont(user_id % 5, [CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3]) AS e FROM events GROUP BY 1) USING (feature) GROUP BY feature, kind", "high", "low", "importance"))
def _(spark, sf):
    click = F.col("event_type") == "click"
    long = table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.when(click, "flag").otherwise("number").alias("kind"), (F.col("user_id") % 5 - F.when(click, 2).otherwise(0)).cast("double").alias("x"), (F.col("value") - 20).alias("contribution"))
    return ml.directional_effects(long).drop("effect", "direction")


@query("ml26_explain", None)
def _(spark, sf):
    rows = ml.author_folds(bare_frame(spark, sf), 4)
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    built = plain().fit(train)
    cut = table_quantiles(train, "wer", [0.9])[0]
    t = built.transform(train).withColumn("label", (F.col("wer") >= cut).cast("double"))
    return ml.explain_linear(t, built.transform(test), ["followers", "duration", "official", "hour_sin", "hour_cos"], "label", "brand")


@query("ml27_roc", floats(f"SELECT threshold, tp / (SELECT sum(y) FROM ({SCORED})) AS tpr, fp / (SELECT count(*) - sum(y) FROM ({SCORED})) AS fpr FROM ({CURVE})", "threshold", "tpr", "fpr"))
def _(spark, sf):
    return ml.roc(scored_events(spark, sf))
