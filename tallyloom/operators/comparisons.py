"""Model comparisons over one cache of fold features, and what features a model leans on.

The features of every fold are fitted and written once; a variant takes the places of its feature
groups out of the cached vectors, so no variant fits a pipeline again.  Out-of-fold predictions
of all variants form one long table, and the metrics of all of them come from a few grouped jobs.
Variants are fitted side by side, a few at a time.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass
from functools import reduce
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..sources.landing import removed, settled, shuffles_dropped
from . import modeling as ml
from .quantiles import exact_quantiles
from .stats import before_counts, spearman

Prior = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Fold:
    """Training and test rows of one fold with features, and (source column, name) of each place of the vector."""

    number: int
    train: DataFrame
    test: DataFrame
    names: list[tuple[str, str]]


class FoldCache:
    """The features of every fold, fitted on its training rows and written once, beside the ``keep`` columns."""

    def __init__(self, df: DataFrame, k: int, features: Callable[[], ml.FoldFeatures], keep: Sequence[str], parallel: int = 4):
        self.parallel, self.spark, self._cuts = parallel, df.sparkSession, {}
        self._with_priors, self._lock = {}, Lock()

        def build(i: int) -> Fold:
            built = features().fit(df.where(F.col("fold") != i))
            rows = built.transform(df, [*keep, "fold"])
            return Fold(i, rows.where(F.col("fold") != i), rows.where(F.col("fold") == i), built.names())

        # one after the other: the decomposition inside Spark ML's PCA doesn't stand being called by several threads
        self.folds = [build(i) for i in range(k)]

    def narrowed(self, columns: Sequence[str] | None) -> FoldCache:
        """This cache with the features of some source columns only, written once for all learners that read just these."""
        if columns is None:
            return self
        other = copy(self)
        other._with_priors, other._lock = {}, Lock()
        other.folds = [Fold(f.number, *map(settled, self.rows(f, columns)), [x for x in f.names if x[0] in columns]) for f in self.folds]
        return other

    def side_by_side(self, jobs: list[Callable]) -> list:
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(lambda job: job(), jobs))

    def cut(self, fold: Fold, target: str, q: float) -> float:
        """The training rows' quantile of the target, found once for all variants."""
        at = (fold.number, target, q)
        if at not in self._cuts:
            self._cuts[at] = ml.table_quantiles(fold.train, target, [q])[0]
        return self._cuts[at]

    def screened(self, target: str, q: float, model: str | Callable, keep: list[str], columns: Sequence[str] | None = None) -> DataFrame:
        """Out-of-fold predictions of being in the top share; the folds' thresholds are shared by all variants."""
        return reduce(DataFrame.unionByName, [ml.screening(target, q, model, keep, self.cut(fold, target, q))(*self.rows(fold, columns)) for fold in self.folds])

    def out_of_fold(self, run: ml.FitPredict, columns: Sequence[str] | None = None, priors: Sequence[Prior] = ()) -> DataFrame:
        """Predictions of every row by a model of the other folds, from the features of these source columns (all if None)."""
        return reduce(DataFrame.unionByName, [run(*self.rows(fold, columns, priors)) for fold in self.folds])

    def rows(self, fold: Fold, columns: Sequence[str] | None = None, priors: Sequence[Prior] = ()) -> tuple[DataFrame, DataFrame]:
        """Training and test rows with the features of these columns and the priors.  Rows with priors are joined and written
        once for all learners, as each reads its rows many times."""
        if not priors:
            return self._rows(fold, columns, ())
        at = (fold.number, None if columns is None else tuple(columns), tuple(priors))
        with self._lock:
            if at not in self._with_priors:
                self._with_priors[at] = tuple(settled(d) for d in self._rows(fold, columns, priors))
            return self._with_priors[at]

    def _rows(self, fold: Fold, columns: Sequence[str] | None, priors: Sequence[Prior]) -> tuple[DataFrame, DataFrame]:
        train, test = fold.train, fold.test
        if columns is not None:
            places = [i for i, (source, _) in enumerate(fold.names) if source in columns]
            cut = VectorSlicer(inputCol="features", outputCol="sliced", indices=places)
            train, test = (cut.transform(d).drop("features").withColumnRenamed("sliced", "features") for d in (train, test))
        for i, prior in enumerate(priors):
            train, test = prior(train, test)
            join = VectorAssembler(inputCols=["features", "prior"], outputCol=f"with_{i}")
            train, test = (join.transform(d).drop("features", "prior").withColumnRenamed(f"with_{i}", "features") for d in (train, test))
        return train, test


def long_table(cache: FoldCache, variants: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The variants' predictions under one column ``label``, fitted side by side, written once."""
    parts = cache.side_by_side([lambda n=n, f=f: f().withColumn("label", F.lit(n)) for n, f in variants.items()])
    return settled(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def author_prior(target: str, by: str) -> Prior:
    return lambda train, test: ml.target_prior(train, test, by, target, "prior")


def shrinkage_prior(target: str, parent: str, child: str, m: float = 10.0) -> Prior:
    return lambda train, test: ml.shrunken_prior(train, test, parent, child, target, m, "prior")


# --- metrics of a long table ------------------------------------------------------------------

BY = ["label", "fold"]


def _means(parts: list[DataFrame]) -> DataFrame:
    """Fold metrics joined, and their means over the folds."""
    joined = reduce(lambda a, b: a.join(b, BY, "left"), parts)
    return joined.groupBy("label").agg(*[F.avg(c).alias(c) for c in joined.columns if c not in BY])


def screening_metrics(scored: DataFrame, key: str, value: str = "y_value") -> DataFrame:
    """lift_5 .. lift_20, precision_10, auc, rank correlation: means over the folds, a row a label."""
    lifts = ml.lift_at(scored, [0.05, 0.10, 0.20], key=key, by=BY)
    at = lambda column, f: F.max(F.when(F.abs(F.col("fraction") - f) < 1e-9, F.col(column)))
    cells = [at("lift", f).alias(f"lift_{round(100 * f)}") for f in (0.05, 0.10, 0.20)] + [at("precision", 0.10).alias("precision_10"), F.max("base_rate").alias("base_rate")]
    split = F.split(F.col("group"), r"\|(?=[^|]*$)")  # the fold is the last part
    wide = lifts.withColumns({"label": split[0], "fold": split[1].cast("int")}).groupBy(*BY).agg(*cells)
    return _means([wide, ml.auc(scored, by=BY), spearman(scored, "score", value, BY).withColumnRenamed("rho", "spearman").drop("n")])


def mean_lifts(scored: DataFrame, key: str, fraction: float) -> dict[str, float]:
    """The lift at one fraction by label, mean over the folds (0 without a hit); no other metric is computed."""
    label = F.split(F.col("group"), r"\|(?=[^|]*$)")[0]  # the fold is the last part
    lifts = ml.lift_at(scored, [fraction], key=key, by=BY).groupBy(label.alias("label")).agg(F.avg("lift").alias("lift"))
    return {r.label: r.lift or 0.0 for r in lifts.collect()}  # a row a label


def value_metrics(predicted: DataFrame, baseline: str | None = None) -> DataFrame:
    """mae, rmse, rmsle, mae_log, smape (and mae_bri), rank correlation: means over the folds, a row a label."""
    return _means([ml.regression_metrics(predicted, by=BY, baseline=baseline).drop("n"), spearman(predicted, "pred", "y", BY).withColumnRenamed("rho", "spearman").drop("n")])


def class_table(predicted: DataFrame) -> DataFrame:
    """accuracy, macro_f1, top recall and precision, one-vs-rest area, and those of the chosen threshold."""
    top = F.col("y") == F.col("classes") - 1
    hits, said = F.count_if(F.col("chosen") & top), F.count_if("chosen")
    chosen = predicted.groupBy(*BY).agg(F.coalesce(ratio(hits, said), F.lit(0.0)).alias("threshold_precision"), F.coalesce(ratio(hits, F.count_if(top)), F.lit(0.0)).alias("threshold_recall"))
    return _means([ml.class_metrics(predicted, by=BY), ml.auc_of_classes(predicted, by=BY), chosen])


def by_protocol(table: DataFrame) -> DataFrame:
    return ml.rank_models(table.withColumnRenamed("label", "name")).withColumnRenamed("name", "label")


# --- the comparison tables --------------------------------------------------------------------


def decision_layer(cache: FoldCache, target: str, key: str, brand: str, author: str, classes: int = 4) -> DataFrame:
    """Predictions of quantile classes, with and without a shrinkage prior and isotonic calibration."""
    keep, prior = [key, brand], shrinkage_prior(target, brand, author)
    plain = lambda: cache.out_of_fold(ml.quantile_classes(target, classes, keep))
    shrunk = lambda: cache.out_of_fold(ml.quantile_classes(target, classes, keep), priors=[prior])
    base = long_table(cache, {"classes": plain, "classes+shrinkage": shrunk}).withColumn("classes", F.lit(classes))

    def calibrated(label: str) -> DataFrame:
        rows = ml.calibrate(base.where(F.col("label") == label), classes).withColumn("p", F.col("calibrated")).drop("calibrated")
        best = F.array_position("p", F.array_max("p")).cast("int") - 1
        expected = F.aggregate(F.transform("p", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
        return rows.withColumns({"pred": best, "expected": expected, "chosen": F.col("p")[classes - 1] >= 0.5, "label": F.lit(f"{label}+isotonic")})

    return settled(reduce(DataFrame.unionByName, [base, calibrated("classes"), calibrated("classes+shrinkage")]))


def decision_metrics(predicted: DataFrame, key: str) -> DataFrame:
    """Screening by the top class's probability, and class metrics, ranked by the protocol."""
    top = F.col("classes") - 1
    hits = predicted.select("label", "fold", key, "y_value", (F.col("y") == top).cast("int").alias("y"), F.get("p", top).alias("score"))
    return by_protocol(screening_metrics(hits, key).join(class_table(predicted), "label"))


def screened(cache: FoldCache, target: str, key: str, variants: dict[str, tuple[Sequence[str] | None, str]], q: float) -> DataFrame:
    """Predictions of being in the top share, by label: (source columns, learner)."""
    for fold in cache.folds:
        cache.cut(fold, target, q)  # before the variants run side by side
    return long_table(cache, {n: lambda c=c, m=m: cache.screened(target, q, m, [key], c) for n, (c, m) in variants.items()})


def ladder(cache: FoldCache, target: str, key: str, rungs: dict[str, Sequence[str]], q: float = 0.9, model: str = "logistic") -> DataFrame:
    """Predictions of a ladder: each rung adds its source columns to those below."""
    added, variants = [], {}
    for name, columns in rungs.items():
        added = [*added, *columns]
        variants[name] = (list(added), model)
    return screened(cache, target, key, variants, q)


def ladder_metrics(scored: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A row a rung, in order, with the gain in lift at 10 % over the rung below."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("label"))
    return screening_metrics(scored, key).withColumn("rung", place.cast("int")).withColumn("delta_lift_10", F.col("lift_10") - F.lag("lift_10").over(Window.orderBy("rung")))  # a handful of rows


def champion_and_challengers(cache: FoldCache, target: str, key: str, models: Sequence[str], q: float = 0.75, classes: int = 4) -> DataFrame:
    """The champion, quantile classes, by its top class's probability, and binary challengers, all held against the
    same event: the training rows' q quantile reached."""

    def champion() -> DataFrame:
        rows = cache.out_of_fold(ml.quantile_classes(target, classes, [key])).select(key, "fold", F.get("p", F.lit(classes - 1)).alias("score"))
        events = [(f.number, cache.cut(f, target, q)) for f in cache.folds]
        cuts = F.broadcast(cache.spark.createDataFrame(events, "fold int, cut double"))  # a row a fold
        truth = reduce(DataFrame.unionByName, [f.test.select(key, "fold", F.col(target).alias("y_value")) for f in cache.folds]).join(cuts, "fold")
        return rows.join(truth.withColumn("y", (F.col("y_value") >= F.col("cut")).cast("int")).drop("cut"), [key, "fold"])

    for fold in cache.folds:
        cache.cut(fold, target, q)  # before the variants run side by side
    return long_table(cache, {"champion: classes": champion} | {f"challenger: {m}": lambda m=m: cache.screened(target, q, m, [key]) for m in models})


def classes_and_ranks(cache: FoldCache, target: str, key: str, lists: Sequence[str], numbers: Sequence[int] = (4, 5)) -> DataFrame:
    """Predictions of a regressor, of quantile classes (mapped back to values) and of rankers by list: one value each."""
    variants: dict[str, Callable[[], DataFrame]] = {"regression": lambda: cache.out_of_fold(ml.regression(target, "gbt", "raw", [key]))}
    for n in numbers:
        variants[f"classes {n}"] = lambda n=n: cache.out_of_fold(ml.quantile_classes(target, n, [key])).select(key, "fold", F.col("y_value").alias("y"), F.col("mapped").alias("pred"), F.col("y").alias("y_class"), "p", F.col("pred").alias("class"), F.lit(n).alias("classes"))
    for by in lists:
        variants[f"ranks by {by}"] = lambda by=by: cache.out_of_fold(ml.ranking(target, by, [key])).drop("list", "score")
    return long_table(cache, variants)


def class_and_rank_metrics(predicted: DataFrame) -> DataFrame:
    """Value metrics of all, class metrics of those that have classes; best rank correlation first."""
    graded = predicted.where("class is not null").select("label", "fold", F.col("y_class").alias("y"), F.col("class").alias("pred"), "p", "classes", F.lit(False).alias("chosen"))
    out = value_metrics(predicted).join(class_table(graded).drop("threshold_precision", "threshold_recall"), "label", "left")
    return out.orderBy(F.desc_nulls_last("spearman"), "label")


def brand_medians(folds: Sequence[Fold], target: str, brand: str) -> tuple[DataFrame, DataFrame]:
    """(_fold, _b, _m): the training median of each brand, and (_fold, _all): that of all training rows.  Both are written,
    so that joins know their size."""
    number = lambda f: F.lit(f.number).alias("_fold")
    base = [exact_quantiles(f.train, {"_b": brand}, {"_m": (target, 0.5)}).select(number(f), "_b", "_m") for f in folds]
    overall = [exact_quantiles(f.train, {}, {"_all": (target, 0.5)}).select(number(f), "_all") for f in folds]
    return settled(reduce(DataFrame.unionByName, base)), settled(reduce(DataFrame.unionByName, overall))


def with_baseline(rows: DataFrame, medians: tuple[DataFrame, DataFrame], brand: str) -> DataFrame:
    """Adds baseline: the median of the row's brand in its fold's training rows (that of all for a new brand)."""
    base, overall = medians
    rows = rows.join(base, (F.col("fold") == base["_fold"]) & F.col(brand).eqNullSafe(F.col("_b")), "left").drop("_fold")
    rows = rows.join(F.broadcast(overall), F.col("fold") == overall["_fold"], "left").drop("_fold")  # a row a fold
    return rows.withColumn("baseline", F.coalesce("_m", "_all")).drop("_b", "_m", "_all")


def naive_baseline(folds: Sequence[Fold], target: str, key: str, brand: str) -> DataFrame:
    """The training median of the row's brand as its prediction; it needs no features."""
    test = reduce(DataFrame.unionByName, [f.test.select(key, brand, "fold", F.col(target).alias("y")) for f in folds])
    rows = with_baseline(test, brand_medians(folds, target, brand), brand)
    return rows.select(key, "fold", "y", F.col("baseline").alias("pred"), "baseline")


def recipes(cache: FoldCache, target: str, key: str, brand: str, author: str, by: str) -> DataFrame:
    """Predictions of target transforms, priors, the two-stage model, a ranker and the naive baseline, with the brand
    baseline beside each.  Rows carry their brand, so that the few medians are joined and no row is dealt by its key."""
    priors, keep = [author_prior(target, author), author_prior(target, brand)], [key, brand]
    medians = brand_medians(cache.folds, target, brand)
    run = lambda how, model="gbt": ml.regression(target, model, how, keep)
    naive = lambda: reduce(DataFrame.unionByName, [f.test.select(*keep, "fold", F.col(target).alias("y")) for f in cache.folds])
    variants: dict[str, Callable[[], DataFrame]] = {
        "raw target": lambda: cache.out_of_fold(run("raw")),
        "log1p target": lambda: cache.out_of_fold(run("log1p")),
        "log target": lambda: cache.out_of_fold(run("log")),
        "raw target, priors": lambda: cache.out_of_fold(run("raw"), priors=priors),
        "log target, priors": lambda: cache.out_of_fold(run("log"), priors=priors),
        "forest, raw target, priors": lambda: cache.out_of_fold(run("raw", "forest"), priors=priors),
        "two stages": lambda: cache.out_of_fold(ml.two_stage(target, keep=keep), priors=priors).drop("p"),
        f"ranks by {by}": lambda: cache.out_of_fold(ml.ranking(target, by, keep)).drop("list", "score"),
        "naive brand median": lambda: with_baseline(naive(), medians, brand).withColumnRenamed("baseline", "pred"),
    }
    return with_baseline(long_table(cache, variants), medians, brand).drop(brand)


# --- parameter search -------------------------------------------------------------------------


def halving(trials: int, score: Callable[[list[int], int], dict[int, float]], least: int = 1, factor: int = 2, gain: float = 0.01, patience: int = 2) -> list[tuple[int, int, int, float, bool, bool]]:
    """Successive halving: all trials with ``least`` effort, then the best 1/``factor`` of them with ``factor`` times as
    much, until one is left or ``patience`` rungs in turn bring no relative gain over the best so far.

    Rows (rung, trial, effort, score, kept, improved); ``score`` rates the living trials at an effort.
    """
    alive, effort, best, idle, rows = list(range(trials)), least, 0.0, 0, []
    for rung in range(trials):
        scores = score(alive, effort)
        order = sorted(alive, key=lambda t: (-scores[t], t))
        kept = order[: max(1, len(alive) // factor)]
        improved = scores[order[0]] > best * (1 + gain)
        rows += [(rung, t, effort, float(scores[t]), t in kept, improved and t == order[0]) for t in order]
        best, idle = (scores[order[0]], 0) if improved else (best, idle + 1)
        if len(alive) == 1 or idle >= patience:
            break
        alive, effort = kept, effort * factor
    return rows


def search(cache: FoldCache, target: str, key: str, trials: int = 20, columns: Sequence[str] | None = None, q: float = 0.9, seed: int = 1, **rule) -> DataFrame:
    """Random settings of boosted trees, halved by lift at 10 %: effort is the number of boosting rounds.  The trials of a
    rung are fitted side by side on the cached features of the columns, written once for all trials, and rated by their lift
    alone."""
    rng = random.Random(seed)
    drawn = [(rng.choice([2, 3, 4, 5]), round(math.exp(rng.uniform(math.log(0.03), math.log(0.4))), 4), rng.choice([0.5, 0.75, 1.0])) for _ in range(trials)]

    for fold in cache.folds:
        cache.cut(fold, target, q)  # before the trials run side by side
    narrow = cache.narrowed(columns)

    def score(alive: list[int], rounds: int) -> dict[int, float]:
        make = lambda t: GBTClassifier(maxDepth=drawn[t][0], stepSize=drawn[t][1], subsamplingRate=drawn[t][2], maxIter=rounds, seed=1)
        rows = long_table(cache, {str(t): lambda t=t: narrow.screened(target, q, lambda: make(t), [key]) for t in alive})
        found = mean_lifts(rows, key, 0.10)
        removed(rows)
        return {int(label): lift for label, lift in found.items()}

    rows = [(rung, t, *drawn[t], effort, lift, kept, improved) for rung, t, effort, lift, kept, improved in halving(trials, score, **rule)]
    return cache.spark.createDataFrame(rows, "rung int, trial int, depth int, rate double, share double, rounds int, lift_10 double, kept boolean, improved boolean")


# --- importances ------------------------------------------------------------------------------


def gain_importances(cache: FoldCache, target: str, model: str = "gbt", how: str = "log1p", columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, source, importance): a tree model's gains by the features' names, mean over the folds (0 where a fold
    doesn't know the feature)."""

    def gains(fold: Fold) -> list[tuple[str, str, float]]:
        train, _ = cache.rows(fold, columns)
        names = [x for x in fold.names if columns is None or x[0] in columns]
        fitted = ml.REGRESSORS[model]().fit(train.withColumn("label", ml.to_target(F.col(target), how)))
        return [(name, source, float(g)) for (source, name), g in zip(names, fitted.featureImportances.toArray(), strict=True)]

    rows = [r for part in cache.side_by_side([lambda f=f: gains(f) for f in cache.folds]) for r in part]
    table = cache.spark.createDataFrame(rows, "feature string, source string, gain double")
    return table.groupBy("feature", "source").agg((F.sum("gain") / len(cache.folds)).alias("importance"))


def dealt(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``theirs``, the features of another row: the row whose key's hash has the rank that the own key has.  Both
    ranks come range by range, and keys are paired before any vector moves; no task sees all rows."""
    numbered = lambda column, name: before_counts(df.groupBy(column.alias(name)).agg(F.count("*").alias("_c")), [], name, "_c", "_at").select(name, "_at")
    own, other = F.xxhash64(F.col(key), F.lit(-1)), F.xxhash64(F.col(key), F.lit(seed))
    pairs = numbered(own, "_own").join(numbered(other, "_other"), "_at").drop("_at")
    moved = df.select(other.alias("_other"), F.col("features").alias("theirs"))
    return df.withColumn("_own", own).join(pairs, "_own").join(moved, "_other").drop("_own", "_other")


def shuffled(df: DataFrame, places: Sequence[int], key: str, seed: int) -> DataFrame:
    """``df`` with these places of the feature vector taken from the row that ``dealt`` gives."""
    taken = F.array(*map(F.lit, places))
    rows = dealt(df, key, seed).withColumns({"_mine": vector_to_array("features"), "_theirs": vector_to_array("theirs")})
    mixed = F.transform("_mine", lambda x, i: F.when(F.array_contains(taken, i), F.get("_theirs", i)).otherwise(x))
    return rows.withColumn("features", array_to_vector(mixed)).drop("theirs", "_mine", "_theirs")


def mixed_batches(sources: Sequence[tuple[str, Sequence[int]]]) -> Callable:
    """A function over batches (y, error, mine, theirs): a row a source whose places differ between the two vectors, with
    those places taken from the other."""

    def mix(batches):
        for b in batches:
            mine, theirs = (b[c].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("mine", "theirs"))
            for source, places in sources:
                at = np.nonzero((mine[:, places] != theirs[:, places]).any(axis=1))[0]
                x = mine[at]
                x[:, places] = theirs[at][:, places]
                ends = pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_pydict({"source": pa.array([source] * len(at), pa.string()), "y": b["y"].take(pa.array(at)), "error": b["error"].take(pa.array(at)), "x": pa.ListArray.from_arrays(ends, pa.array(x.ravel()))})

    return mix


def permutation_importances(cache: FoldCache, target: str, key: str, model: str = "gbt", how: str = "log1p", seed: int = 11) -> DataFrame:
    """(source, importance): by how much the test error (mean absolute) grows when a column's features are dealt anew
    among the test rows of their fold; mean over the folds, rows weighing alike.  Keys are distinct.

    Rows are dealt once for all columns, and a row whose features of a column come out the same keeps its error."""

    def errors(fold: Fold) -> DataFrame:
        fitted = ml.REGRESSORS[model]().fit(fold.train.withColumn("label", ml.to_target(F.col(target), how)))
        error = F.abs(F.col("y") - ml.from_target(F.col("prediction"), how))
        pairs = dealt(fold.test.select(key, F.col(target).alias("y"), "features"), key, seed)
        rows = settled(fitted.transform(pairs).select("y", error.alias("error"), "features", "theirs"))
        sources = [(s, [i for i, (x, _) in enumerate(fold.names) if x == s]) for s in sorted({s for s, _ in fold.names})]
        wide = rows.select("y", "error", vector_to_array("features").alias("mine"), vector_to_array("theirs").alias("theirs"))
        mixed = wide.mapInArrow(mixed_batches(sources), "source string, y double, error double, x array<double>")
        grown = fitted.transform(mixed.withColumn("features", array_to_vector("x")).drop("x")).groupBy("source").agg(F.sum(error - F.col("error")).alias("grown"))
        all_ = rows.agg(F.sum("error").alias("error"), F.count("*").alias("n"))
        names = cache.spark.createDataFrame([(s,) for s, _ in sources], "source string")
        out = settled(names.join(grown, "source", "left").crossJoin(F.broadcast(all_)).select("source", F.coalesce("grown", F.lit(0.0)).alias("grown"), "error", "n"))  # a row a source
        removed(rows)
        return out

    with shuffles_dropped(cache.spark):  # one fold after the other, so that only one fold's vectors are on their way
        sums = reduce(DataFrame.unionByName, [errors(f) for f in cache.folds])
    means = sums.groupBy("source").agg((F.sum("error") / F.sum("n")).alias("base"), (F.sum("grown") / F.sum("n")).alias("importance"))
    return means.select("source", "base", (F.col("base") + F.col("importance")).alias("mae"), "importance")
