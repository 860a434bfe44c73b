"""Leakage-safe modelling: folds by author, train-only features and priors, learners of Spark ML, and decision metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.numbers import dot, ratio, unit, valid_vector
from ..sources.landing import settled
from .quantiles import exact_quantiles, table_quantiles
from .stats import before_counts, spearman

#: Columns that hold or follow from the outcome.
LEAKY = ["view_count", "like_count", "comment_count", "share_count", "collect_count", "engagement_count", "engagement_rate", "weighted_engagement_count", "wer", "bri", "like_per_view", "comment_per_view", "share_per_view", "engagement_per_view", "comment_per_like"]


# --- frames and folds -------------------------------------------------------------------------


def model_frame(df: DataFrame, target: str, vectors: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with a target and valid vectors, and a one-row count of what was dropped and why."""
    good = reduce(lambda a, b: a & b, [valid_vector(F.col(v)) for v in vectors], F.lit(True))
    has = F.col(target).isNotNull()
    report = df.agg(F.count("*").alias("rows"), F.count_if(~has).alias("no_target"), F.count_if(has & ~good).alias("bad_vector"), F.count_if(has & good).alias("kept"))
    return df.where(has & good), report


def check_leakage(features: list[str]) -> None:
    """Raise if a feature is an outcome column or derived from one."""
    bad = [f for f in features if f in LEAKY or any(f.startswith(f"{x}_") for x in LEAKY)]
    if bad:
        raise ValueError(f"outcome columns among the features: {', '.join(bad)}")


def author_folds(df: DataFrame, k: int = 5, author: str = "author_id", seed: int = 42, largest: int = 1_000) -> DataFrame:
    """Balanced folds by author: no author is in two folds, null authors are one.

    The ``largest`` authors go one by one to the fold with the fewest rows so far.  The others stand in
    the order of a hash, and their running row count is cut where each fold has what it lacks, so
    folds differ by about one of the smaller authors, however skewed the sizes are.
    """
    name = F.coalesce(F.col(author).cast("string"), F.lit(""))
    counts = settled(df.groupBy(name.alias("_a")).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    loads, placed = [0] * k, []
    for r in counts.orderBy(F.desc("_n"), "_a").limit(largest).collect():
        fold = min(range(k), key=lambda i: (loads[i], i))
        loads[fold] += r._n
        placed.append((r._a, fold))
    lacking = [max(0.0, total / k - x) for x in loads]
    scale = (total - sum(loads)) / sum(lacking) if sum(lacking) else 0.0
    cuts = [scale * sum(lacking[: i + 1]) for i in range(k - 1)]
    top = F.broadcast(df.sparkSession.createDataFrame(placed, "_a string, _top int"))  # at most ``largest`` rows
    rest = counts.join(top, "_a", "left_anti").groupBy(F.xxhash64(F.lit(seed), "_a").alias("_h")).agg(F.sum("_n").alias("_n"))
    rest = before_counts(rest, [], "_h", "_n").select("_h", sum(((F.col("before") >= c).cast("int") for c in cuts), F.lit(0)).alias("fold"))
    rows = df.withColumn("_a", name).join(top, "_a", "left")
    large = rows.where("_top is not null").withColumn("fold", F.col("_top"))
    small = rows.where("_top is null").withColumn("_h", F.xxhash64(F.lit(seed), "_a")).join(rest, "_h").drop("_h")
    return settled(large.unionByName(small).drop("_a", "_top"))  # read by every fold and learner


def fold_balance(df: DataFrame, target: str, author: str = "author_id") -> DataFrame:
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct(author).alias("authors"), F.avg(target).alias("mean_target"))


def to_target(c: Column, how: str) -> Column:
    return {"raw": c, "log1p": F.log1p(c), "log": F.log(c + 1e-6)}[how]


def from_target(c: Column, how: str) -> Column:
    back = {"raw": c, "log1p": F.expm1(c), "log": F.exp(c) - 1e-6}[how]
    return F.when(back.isNotNull(), F.greatest(F.lit(0.0), back))  # greatest() skips nulls


# --- train-only statistics --------------------------------------------------------------------


def train_baseline(train: DataFrame, test: DataFrame, value: str, brand: str = "brand") -> DataFrame:
    """Test rows with the median of their brand in the training rows (overall median for a new brand)."""
    base = settled(exact_quantiles(train, {"_b": brand}, {"_m": (value, 0.5)}))  # its size is known to the join: rows aren't dealt by brand
    overall = exact_quantiles(train, {}, {"_all": (value, 0.5)})
    return test.join(base, F.col(brand).eqNullSafe(F.col("_b")), "left").crossJoin(F.broadcast(overall)).withColumn("baseline", F.coalesce("_m", "_all")).drop("_b", "_m", "_all")  # one row


def target_prior(train: DataFrame, test: DataFrame, by: str, value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Group mean as a feature: the others' mean on training rows, the group's on test rows, else the overall mean."""
    overall = train.agg(F.avg(value).alias("_all"))
    sums = settled(train.groupBy(F.col(by).alias("_g")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")))  # its size is known to the join
    join = lambda d: d.join(sums, F.col(by).eqNullSafe(F.col("_g")), "left").crossJoin(F.broadcast(overall))  # noqa: E731  one row
    mine = ratio(F.col("_s") - F.col(value), F.col("_n") - 1)
    drop = ["_g", "_s", "_n", "_all"]
    return join(train).withColumn(name, F.coalesce(mine, "_all")).drop(*drop), join(test).withColumn(name, F.coalesce(ratio(F.col("_s"), F.col("_n")), "_all")).drop(*drop)


def shrunken_prior(train: DataFrame, test: DataFrame, parent: str, child: str, value: str, m: float, name: str) -> tuple[DataFrame, DataFrame]:
    """(n mean + m parent mean) / (n + m) of a group within its parent, leaving the row itself out on training rows."""
    overall = train.agg(F.avg(value).alias("_all"))
    up = settled(train.groupBy(F.col(parent).alias("_p")).agg(F.sum(value).alias("_ps"), F.count(value).alias("_pn")))  # its size is known to the join
    own = train.groupBy(F.col(parent).alias("_q"), F.col(child).alias("_c")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))

    def prior(d: DataFrame, out: Column | None) -> DataFrame:
        rows = d.join(up, F.col(parent).eqNullSafe(F.col("_p")), "left").join(own, F.col(parent).eqNullSafe(F.col("_q")) & F.col(child).eqNullSafe(F.col("_c")), "left").crossJoin(F.broadcast(overall))  # one row
        v, one = (out, 1) if out is not None else (F.lit(0.0), 0)
        above = F.coalesce(ratio(F.col("_ps") - v, F.col("_pn") - one), F.col("_all"))
        n, s = F.coalesce(F.col("_n"), F.lit(0)) - one, F.coalesce(F.col("_s"), F.lit(0.0)) - v
        n, s = (n, s) if out is not None else (F.coalesce(F.col("_n"), F.lit(0)), F.coalesce(F.col("_s"), F.lit(0.0)))
        return rows.withColumn(name, (s + m * above) / (n + m)).drop("_p", "_ps", "_pn", "_q", "_c", "_s", "_n", "_all")

    return prior(train, F.col(value)), prior(test, None)


class FoldFeatures:
    """Features fitted on training rows only.

    numbers (log1p, missing -1), angles (name -> period, as sine and cosine), flags, label lists
    (multi-hot of all labels on ``min_df`` rows or more), categories (one-hot, unknown last) and vectors
    (PCA of ``dims``, missing ones take the training mean and a mask).  ``shared`` (vector -> key column and a
    table of distinct ``key`` and ``vector``) is for vectors that many rows have in common: rows carry the key, the
    table's vectors are weighed by their rows, projected once and joined; the features are the same.
    """

    def __init__(self, numbers=(), angles=None, flags=(), lists=(), categories=(), vectors=None, min_df: int = 5, shared: dict[str, tuple[str, DataFrame]] | None = None):
        self.shared = shared or {}
        self.numbers, self.angles, self.flags, self.lists, self.categories, self.vectors, self.min_df = list(numbers), angles or {}, list(flags), list(lists), list(categories), vectors or {}, min_df
        check_leakage([*self.numbers, *self.angles, *self.flags, *self.lists, *self.categories, *self.vectors])

    def _columns(self, df: DataFrame) -> DataFrame:
        new = {f"f_{c}": F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))).otherwise(-1.0) for c in self.numbers}
        for c, period in self.angles.items():
            angle = F.col(c) * (2 * 3.141592653589793 / period)
            new |= {f"f_{c}_sin": F.coalesce(F.sin(angle), F.lit(0.0)), f"f_{c}_cos": F.coalesce(F.cos(angle), F.lit(0.0))}
        new |= {f"f_{c}": F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("double") for c in self.flags}
        new |= {f"l_{c}": F.coalesce(F.col(c), F.array().cast("array<string>")) for c in self.lists}
        new |= {f"c_{c}": F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")) for c in self.categories}
        new |= {f"f_has_{c}": valid_vector(F.col(c)).cast("double") for c in self.vectors if c not in self.shared}
        return df.withColumns(new)

    def fit(self, train: DataFrame) -> FoldFeatures:
        rows = self._columns(train)
        self.means, self.projected, self.axes = {}, {}, {}
        for c, dims in self.vectors.items():
            if c in self.shared:
                self.projected[c] = self._project(rows, c, dims)
                continue
            known = rows.where(f"f_has_{c} = 1").select(array_to_vector(unit(F.col(c))).alias("v"))
            self.means[c] = [float(x) for x in known.agg(Summarizer.mean(F.col("v"))).first()[0]]
            found = PCA(k=dims, inputCol=f"v_{c}", outputCol=f"p_{c}").fit(self._vectors(rows)).pc.toArray()
            self.axes[c] = [[float(x) for x in found[:, i]] for i in range(dims)]
        self.words = self._words(rows)
        return self

    def _words(self, rows: DataFrame) -> dict[str, list[str]]:
        """The labels of ``min_df`` rows or more and the values of every category, most frequent first; one pass counts all."""
        lists, categories = [f"l_{c}" for c in self.lists], [f"c_{c}" for c in self.categories]
        found = {c: [] for c in [*lists, *categories]}

        def counted(batches):
            for b in batches:
                for c in found:
                    words = b[c] if c in categories else pc.list_flatten(b[c])
                    coded = words.dictionary_encode()
                    codes = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
                    if c in lists:  # a label counts once a row
                        parents = pc.list_parent_indices(b[c]).to_numpy().astype(np.int64)
                        codes = np.unique(parents * (len(coded.dictionary) + 1) + codes + 1) % (len(coded.dictionary) + 1) - 1
                    n = np.bincount(codes[codes >= 0], minlength=len(coded.dictionary))
                    yield pa.RecordBatch.from_pydict({"c": pa.array([c] * len(n), pa.string()), "w": coded.dictionary, "n": pa.array(n, pa.int64())})

        if found:
            counts = rows.select(*found).mapInArrow(counted, "c string, w string, n long").groupBy("c", "w").agg(F.sum("n").alias("n"))
            kept = counts.where(F.col("c").isin(categories) | (F.col("n") >= self.min_df))
            for r in kept.orderBy("c", F.desc("n"), "w").collect():  # a row a label or value, which the model holds
                found[r.c].append(r.w)
        return found

    def _project(self, rows: DataFrame, c: str, dims: int) -> tuple[DataFrame, list[float]]:
        """(key, known, principal components) of a shared table's vectors, and the components of their mean."""
        key, table = self.shared[c]
        counts = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").cast("double").alias("n"))
        used = settled(counts.join(table, "key", "left").select("n", unit(F.col("vector")).alias("v")))  # read by the mean and the spread
        known = used.where("v is not null")
        mean = known.agg(Summarizer.mean(array_to_vector("v"), F.col("n"))).first()[0].toArray()
        size = len(mean)

        def spread(batches):
            total = np.zeros((size, size))
            for b in batches:
                x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - mean
                total += (x * b["n"].to_numpy()[:, None]).T @ x
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(size * size), pa.int32()), "s": pa.array(total.ravel())})

        sums = known.mapInArrow(spread, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # size x size numbers
        square = np.zeros(size * size)
        for r in sums:
            square[r.i] = r.s
        n = used.agg(F.sum("n")).first()[0]  # rows without a vector stand at the mean
        axes = np.linalg.svd(square.reshape(size, size) / (n - 1))[0][:, :dims].T
        parts = [dot(unit(F.col("vector")), F.array(*[F.lit(float(x)) for x in a])).alias(f"_{c}_{i}") for i, a in enumerate(axes)]
        return settled(table.select(F.col("key").alias(f"_{c}"), valid_vector(F.col("vector")).alias(f"_{c}_known"), *parts)), [float(a @ mean) for a in axes]

    def _joined(self, rows: DataFrame) -> DataFrame:
        """With the components of shared vectors."""
        for c, (found, mean) in self.projected.items():
            rows = rows.join(found, F.col(self.shared[c][0]) == F.col(f"_{c}"), "left")
            new = {f"p_{c}_{i}": F.coalesce(f"_{c}_{i}", F.lit(m)) for i, m in enumerate(mean)}
            rows = rows.withColumns(new | {f"f_has_{c}": F.coalesce(f"_{c}_known", F.lit(False)).cast("double")}).drop(*found.columns)
        return rows

    def _vectors(self, rows: DataFrame) -> DataFrame:
        for c in self.means:
            rows = rows.withColumn(f"u_{c}", F.coalesce(unit(F.col(c)), F.array(*[F.lit(x) for x in self.means[c]])))
            rows = rows.withColumn(f"v_{c}", array_to_vector(f"u_{c}"))
        return rows

    def _layout(self) -> list[tuple[str, str, str]]:
        """(attribute kind, source column, name) of each place of the feature vector."""
        out = [("numeric", c, f"{c}[{i}]") for c, dims in self.vectors.items() for i in range(dims)]
        out += [("numeric", c, c) for c in [*self.numbers, *self.flags]] + [("numeric", c, f"{c} known") for c in self.vectors]
        out += [("numeric", c, f"{c} {x}") for c in self.angles for x in ("sin", "cos")]
        out += [("numeric", c, f"{c}={w}") for c in self.lists for w in self.words[f"l_{c}"]]
        return out + [("binary", c, f"{c}={w}") for c in self.categories for w in [*self.words[f"c_{c}"], "__unknown", "invalidValues"]]

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """The rows (of ``keep`` columns, else all) with ``features``, written once: a learner reads its rows many times.

        The places and values of a batch's rows are put together as arrays, in the form in which Spark stores sparse vectors,
        and read as vectors; a chain of one transformer a column would make and take apart a vector for each."""
        keep = df.columns if keep is None else list(keep)
        numbers = [x for c, dims in self.vectors.items() for x in self._components(c, dims)]
        numbers += [F.col(f"f_{c}") for c in [*self.numbers, *self.flags, *[f"has_{v}" for v in self.vectors]]] + [F.col(f"f_{c}_{x}") for c in self.angles for x in ("sin", "cos")]
        lists, categories = [f"l_{c}" for c in self.lists], [f"c_{c}" for c in self.categories]
        rows = self._joined(self._vectors(self._columns(df))).select(*keep, *[x.cast("double").alias(f"n_{i}") for i, x in enumerate(numbers)], *lists, *categories)
        layout, kept = self._layout(), len(keep)
        kinds = {}
        for i, (kind, _, name) in enumerate(layout):
            kinds.setdefault(kind, []).append({"idx": i, "name": name})
        fields = df.select(*keep).schema.fields
        written = StructType([*fields, StructField("features", VectorUDT.sqlType())])
        read = StructType([*fields, StructField("features", VectorUDT(), True, {"ml_attr": {"attrs": kinds, "num_attrs": len(layout)}})])
        put = sparse_batches(kept, len(numbers), [(c, self.words[c]) for c in lists], [(c, self.words[c]) for c in categories], len(layout))
        return settled(rows.mapInArrow(put, written), schema=read)

    def _components(self, c: str, dims: int) -> list[Column]:
        if c in self.projected:
            return [F.col(f"p_{c}_{i}") for i in range(dims)]
        return [dot(F.col(f"u_{c}"), F.array(*map(F.lit, a))) for a in self.axes[c]]

    def names(self, transformed: DataFrame | None = None) -> list[tuple[str, str]]:
        """(source column, name) of each place of the feature vector, the same in every transformed table."""
        return [(source, name) for _, source, name in self._layout()]


def sparse_batches(kept: int, numbers: int, lists: list[tuple[str, list[str]]], categories: list[tuple[str, list[str]]], size: int) -> Callable:
    """A function over batches of ``kept`` columns, ``numbers`` number columns, label lists and categories (name, words):
    the kept columns, and sparse vectors of the numbers, a place a word of each list, and a place a word of each
    category with two more (unknown words; nothing)."""

    def put(batches):
        for b in batches:
            n = b.num_rows
            x = np.stack([b.column(kept + i).to_numpy(zero_copy_only=False) for i in range(numbers)], axis=1) if numbers else np.zeros((n, 0))
            row, place = np.nonzero(x)
            at, rows, places, values = numbers, [row], [place], [x[row, place]]
            for c, words in lists:
                found = pc.index_in(pc.list_flatten(b[c]), value_set=pa.array(words, pa.string()))
                code = np.unique(np.asarray(pc.list_parent_indices(b[c]).filter(found.is_valid()), np.int64) * (len(words) + 1) + np.asarray(found.drop_null(), np.int64))
                rows.append(code // (len(words) + 1))
                places.append(at + code % (len(words) + 1))
                at += len(words)
            for c, words in categories:
                found = pc.index_in(b[c], value_set=pa.array(words, pa.string())).fill_null(len(words))
                rows.append(np.arange(n))
                places.append(at + found.to_numpy())
                at += len(words) + 2
            values += [np.ones(len(r)) for r in rows[1:]]
            row, place = np.concatenate(rows), np.concatenate(places)
            order = np.argsort(row * size + place)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
            parts = [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(place[order], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)[order]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], [*b.schema.names[:kept], "features"])

    return put


# --- learners and cross-validation ------------------------------------------------------------

REGRESSORS: dict[str, Callable] = {"gbt": lambda: GBTRegressor(maxIter=8, maxDepth=4, seed=1), "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=6, seed=1)}
CLASSIFIERS: dict[str, Callable] = {"gbt": lambda: GBTClassifier(maxIter=8, maxDepth=4, seed=1), "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=6, seed=1), "logistic": lambda: LogisticRegression(regParam=0.01, maxIter=25)}


def out_of_fold(df: DataFrame, k: int, features: Callable[[], FoldFeatures], fit_predict: FitPredict, columns: Sequence[str] | None = None) -> DataFrame:
    """Predictions of every row by a model that never saw its fold; the loop is over the folds, not over rows."""
    return reduce(DataFrame.unionByName, [fit_predict(train, test) for train, test in fold_rows(df, k, features, columns)])


def fold_rows(df: DataFrame, k: int, features: Callable[[], FoldFeatures], columns: Sequence[str] | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """Training and test rows of every fold with features fitted on the training rows, written once with ``columns`` (all if
    None) and the fold, as a learner reads its rows many times."""
    columns = None if columns is None else list(dict.fromkeys([*columns, "fold"]))
    parts = []
    for fold in range(k):
        rows = features().fit(df.where(F.col("fold") != fold)).transform(df, columns)
        parts.append((rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)))
    return parts


FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def regression(target: str, model: str = "gbt", how: str = "log1p", keep: list[str] = ()) -> FitPredict:
    """keep, fold, y and pred of the test rows."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        fitted = REGRESSORS[model]().fit(train.withColumn("label", to_target(F.col(target), how)))
        return fitted.transform(test).select(*keep, "fold", F.col(target).alias("y"), from_target(F.col("prediction"), how).alias("pred"))

    return run


def screening(target: str, q: float = 0.9, model: str | Callable = "gbt", keep: list[str] = (), cut: float | None = None) -> FitPredict:
    """keep, fold, y_value, y and score of being in the top share, whose threshold is the training rows' quantile
    (``cut`` where the caller has it already).  ``model``: a name of ``CLASSIFIERS``, or a function that makes a
    classifier."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        cut_ = table_quantiles(train, target, [q])[0] if cut is None else cut
        label = lambda d: d.withColumn("label", (F.col(target) >= cut_).cast("double"))
        fitted = (CLASSIFIERS[model]() if isinstance(model, str) else model()).fit(label(train))
        p = vector_to_array("probability")[1]
        return fitted.transform(label(test)).select(*keep, "fold", F.col(target).alias("y_value"), F.col("label").cast("int").alias("y"), p.alias("score"))

    return run


def two_stage(target: str, q: float = 0.75, keep: list[str] = ()) -> FitPredict:
    """A classifier of the top share and a regressor on each side of it; the side is chosen by probability."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        cut = table_quantiles(train, target, [q])[0]
        train = train.withColumn("label", (F.col(target) >= cut).cast("double"))
        scored = CLASSIFIERS["gbt"]().fit(train).transform(test).withColumn("p", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")
        for name, side in (("low", 0), ("high", 1)):
            part = train.where(F.col("label") == side).withColumn("label", F.log1p(target))
            scored = REGRESSORS["gbt"]().fit(part).transform(scored).withColumn(name, from_target(F.col("prediction"), "log1p")).drop("prediction")
        return scored.select(*keep, "fold", F.col(target).alias("y"), "p", F.when(F.col("p") >= 0.5, F.col("high")).otherwise(F.col("low")).alias("pred"))

    return run


def quantile_classes(target: str, classes: int = 4, keep: list[str] = (), precision: float = 0.5) -> FitPredict:
    """Classes cut at the training rows' quantiles: y, pred, p (probabilities), expected class, mapped (the classes'
    training medians weighted by p), and whether the top class's probability reaches the threshold that
    has the precision on the training rows (chosen)."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        edges = quantile_edges(train, target, classes)
        label = lambda d: d.withColumn("label", digitize(F.col(target), edges).cast("double"))
        train = label(train)
        middle = {int(r.label): float(r.m) for r in exact_quantiles(train, {"label": "label"}, {"m": (target, 0.5)}).collect()}  # a row a class
        overall = table_quantiles(train, target, [0.5])[0]
        fitted = RandomForestClassifier(numTrees=20, maxDepth=6, seed=1).fit(train)
        p = vector_to_array("probability")
        top = fitted.transform(train).select(p[classes - 1].alias("score"), (F.col("label") == classes - 1).cast("int").alias("y"))
        best = best_threshold(top, precision).first()
        sums = lambda values: F.aggregate(F.transform(p, lambda x, i: x * F.get(F.array(*map(F.lit, values)), i)), F.lit(0.0), lambda a, x: a + x)
        out = fitted.transform(label(test)).select(
            *keep, "fold", F.col(target).alias("y_value"), F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"), p.alias("p"), sums([float(c) for c in range(classes)]).alias("expected"), sums([middle.get(c, overall) for c in range(classes)]).alias("mapped"), (p[classes - 1] >= float(best.threshold)).alias("chosen")
        )
        return out

    return run


def ranking(target: str, by: str, keep: list[str] = ()) -> FitPredict:
    """Ranks within lists by a regressor on graded relevance; scores map to quantiles of the training target."""
    from .windows import graded_relevance

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        fitted = REGRESSORS["gbt"]().fit(graded_relevance(train.where(F.col(by).isNotNull()), by, target, "label"))
        return mapped_scores(fitted.transform(test).withColumnRenamed("prediction", "score"), train, target).select(*keep, "fold", F.col(by).alias("list"), F.col(target).alias("y"), "score", "pred")

    return run


def mapped_scores(scored: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """Adds pred: the training target's quantile at the score's place among the scores."""
    grid = table_quantiles(train, target, [i / 100 for i in range(101)])
    n = scored.agg(F.count("*").alias("_n"))
    cells = scored.groupBy("score").agg(F.count("*").alias("_c"))
    place = before_counts(cells, [], "score", "_c").crossJoin(F.broadcast(n)).select(F.col("score").alias("_s"), F.floor(100 * F.col("before") / F.greatest(F.col("_n") - 1, F.lit(1))).cast("int").alias("_q"))  # one row
    mapped = F.element_at(F.array(*[F.lit(x) for x in grid]), F.least(F.col("_q"), F.lit(100)) + 1)
    return scored.join(place, F.col("score") == F.col("_s")).withColumn("pred", mapped).drop("_s", "_q")


def regression_cv(df: DataFrame, target: str, k: int, features: Callable[[], FoldFeatures], model: str = "gbt", how: str = "log1p", keep: list[str] = ()) -> DataFrame:
    return out_of_fold(df, k, features, regression(target, model, how, keep), [*keep, target])


def screening_cv(df: DataFrame, target: str, k: int, features: Callable[[], FoldFeatures], q: float = 0.9, model: str = "gbt", keep: list[str] = ()) -> DataFrame:
    return out_of_fold(df, k, features, screening(target, q, model, keep), [*keep, target])


def two_stage_cv(df: DataFrame, target: str, k: int, features: Callable[[], FoldFeatures], q: float = 0.75, keep: list[str] = ()) -> DataFrame:
    return out_of_fold(df, k, features, two_stage(target, q, keep), [*keep, target])


def quantile_class_cv(df: DataFrame, target: str, k: int, features: Callable[[], FoldFeatures], classes: int = 4, keep: list[str] = ()) -> DataFrame:
    return out_of_fold(df, k, features, quantile_classes(target, classes, keep), [*keep, target])


def ranking_cv(df: DataFrame, target: str, by: str, k: int, features: Callable[[], FoldFeatures], keep: list[str] = ()) -> DataFrame:
    return out_of_fold(df, k, features, ranking(target, by, keep), [*keep, by, target]).withColumnRenamed("list", by)


# --- metrics ----------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", baseline: str | None = None, by: list[str] = ()) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(pred).cast("double")
    e = a - b
    log = F.log1p(a) - F.log1p(F.greatest(b, F.lit(0.0)))
    cells = [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(log * log)).alias("rmsle"), F.avg(F.abs(log)).alias("mae_log"), F.avg(F.coalesce(F.try_divide(2 * F.abs(e), F.nullif(F.abs(a) + F.abs(b), F.lit(0.0))), F.lit(0.0))).alias("smape")]
    if baseline:
        cells.append(F.avg(F.abs(ratio(a, F.col(baseline)) - ratio(b, F.col(baseline)))).alias("mae_bri"))
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(*cells)


def quantile_edges(df: DataFrame, value: str, classes: int) -> list[float]:
    return table_quantiles(df, value, [i / classes for i in range(1, classes)])


def digitize(value: Column, edges: list[float]) -> Column:
    """Number of edges below the value (right-closed classes); null stays null."""
    return F.when(value.isNotNull(), sum(((value > e).cast("int") for e in edges), F.lit(0)))


def class_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """Accuracy, macro F1, and precision and recall of the top class (one row a group)."""
    cells = df.groupBy(*by, F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    zero, hit = F.lit(0).cast("long"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0).cast("long"))
    sides = F.array(F.struct(F.col("_y").alias("c"), F.col("_n").alias("yes"), zero.alias("said"), hit.alias("tp")), F.struct(F.col("_p").alias("c"), zero.alias("yes"), F.col("_n").alias("said"), zero.alias("tp")))
    per = cells.select(*by, F.explode(sides).alias("_x")).groupBy(*by, "_x.c").agg(*[F.sum(f"_x.{n}").alias(n) for n in ("tp", "yes", "said")])
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("yes") + F.col("said")), F.lit(0.0))
    top = F.max(F.struct("c", ratio(F.col("tp"), F.col("yes")).alias("r"), ratio(F.col("tp"), F.col("said")).alias("p")))
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("yes")).alias("accuracy"), F.avg(f1).alias("macro_f1"), top.alias("t")).select(*by, "accuracy", "macro_f1", F.col("t.r").alias("top_recall"), F.col("t.p").alias("top_precision"))


def auc(df: DataFrame, score: str = "score", y: str = "y", by: list[str] = ()) -> DataFrame:
    """Exact area under the ROC curve by rank sums, per group; ties count half; null without both outcomes."""
    cells = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(y).cast("long")).alias("_a"), F.count("*").alias("_t"))
    ranked = before_counts(cells, list(by), "_s", "_t").withColumn("_r", F.col("before") + (F.col("_t") + 1) / 2)
    n1, n = F.sum("_a").cast("double"), F.sum("_t").cast("double")
    u = F.sum(F.col("_a") * F.col("_r")) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*by).agg(ratio(u, n1 * (n - n1)).alias("auc"))


def auc_of_classes(df: DataFrame, p: str = "p", y: str = "y", by: list[str] = ()) -> DataFrame:
    """Mean over the classes of the area of each class's probability against the rest (null if a class is missing)."""
    long = df.select(*by, F.col(y).alias("_y"), F.posexplode(p).alias("_class", "_score")).withColumn("_hit", (F.col("_y") == F.col("_class")).cast("int"))
    areas = auc(long, "_score", "_hit", [*by, "_class"])
    return areas.groupBy(*by).agg(F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("auc_ovr"))


def lift_at(df: DataFrame, fractions: list[float], score: str = "score", y: str = "y", key: str = "video_id", by: list[str] = ()) -> DataFrame:
    """Precision and lift among the top max(1, round(n f)) by score (half to even; ties by key).

    One order statistic per group and fraction from the histogram of scores, then a filter; only
    rows at the cut are ordered.
    """
    rows = df.withColumn("_k", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]) if by else F.lit(""))
    base = rows.groupBy("_k").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("base_rate"))
    cells = rows.groupBy("_k", F.col(score).alias("_s")).agg(F.count("*").alias("_t"), F.sum(F.col(y).cast("long")).alias("_a")).withColumn("_neg", -F.col("_s"))
    placed = before_counts(cells, ["_k"], "_neg", "_t", "_above").join(base, "_k")
    wanted = placed.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn("m", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("fraction")).cast("int")))
    whole = wanted.where(F.col("_above") + F.col("_t") <= F.col("m")).groupBy("_k", "fraction").agg(F.sum("_a").alias("hits"))
    cut = wanted.where((F.col("_above") < F.col("m")) & (F.col("_above") + F.col("_t") > F.col("m"))).select(F.col("_k").alias("_ck"), "fraction", "_s", (F.col("m") - F.col("_above")).alias("need"))
    edge = rows.join(cut, (F.col("_k") == F.col("_ck")) & (F.col(score) == F.col("_s"))).select("_k", "fraction", "need", F.col(y).cast("long").alias("_y"), F.col(key).alias("_id"))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "fraction").orderBy("_id"))).where("_r <= need").groupBy("_k", "fraction").agg(F.sum("_y").alias("more"))
    out = base.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).join(whole, ["_k", "fraction"], "left").join(edge, ["_k", "fraction"], "left")
    m = F.greatest(F.lit(1), F.bround(F.col("n") * F.col("fraction")).cast("int"))
    precision = (F.coalesce("hits", F.lit(0)) + F.coalesce("more", F.lit(0))) / m
    return out.select(F.col("_k").alias("group"), "fraction", "n", m.alias("m"), "base_rate", precision.alias("precision"), ratio(precision, F.col("base_rate")).alias("lift"))


def score_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Cumulative tp and fp at every distinct score, from the highest."""
    cells = settled(df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("_a"), F.count("*").alias("_t")))  # read by both counts: a model's scores are found once
    cells = cells.withColumn("_neg", -F.col("threshold"))
    tp = before_counts(cells, [], "_neg", "_a", "_tp").select(F.col("threshold").alias("_s"), (F.col("_tp") + F.col("_a")).alias("tp"))
    n = before_counts(cells, [], "_neg", "_t", "_n").select("threshold", (F.col("_n") + F.col("_t")).alias("n"))
    return n.join(tp, F.col("threshold") == F.col("_s")).select("threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"))


def roc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    total = df.agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n"))
    c = score_curve(df, score, y).crossJoin(F.broadcast(total))  # one row
    return c.select("threshold", ratio(F.col("tp"), F.col("_p")).alias("tpr"), ratio(F.col("fp"), F.col("_n") - F.col("_p")).alias("fpr"))


def best_threshold(df: DataFrame, precision: float, score: str = "score", y: str = "y") -> DataFrame:
    """The threshold of largest recall with at least the precision; where none reaches it, that of largest F1."""
    total = df.agg(F.sum(F.col(y).cast("long")).alias("_p"))
    c = score_curve(df, score, y).crossJoin(F.broadcast(total))  # one row
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("_p"))
    c = c.select("threshold", p.alias("precision"), r.alias("recall"), F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
    good = F.col("precision") >= precision
    best = c.agg(F.max(F.when(good, F.struct("recall", "precision", "threshold", "f1"))).alias("a"), F.max(F.struct("f1", "recall", "precision", "threshold")).alias("b"))
    pick = lambda n: F.when(F.col("a").isNotNull(), F.col(f"a.{n}")).otherwise(F.col(f"b.{n}")).alias(n)
    return best.select(*[pick(n) for n in ("threshold", "precision", "recall", "f1")], F.col("a").isNotNull().alias("reached"))


def pool_adjacent(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic (never falling) rates of neighbouring cells: violators are pooled, weighted by ``n``."""
    blocks: list[list[float]] = []  # hits, n, cells
    for h, m in zip(hits, n, strict=True):
        blocks.append([float(h), float(m), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h1, m1, c1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h1, blocks[-1][1] + m1, blocks[-1][2] + c1]
    return np.repeat([h / m for h, m, _ in blocks], [int(c) for *_, c in blocks])


def calibration_map(df: DataFrame, classes: int, p: str = "p", y: str = "y", bins: int = 1024) -> DataFrame:
    """(fold, class, bin, value): one-vs-rest isotonic rates of each class's probability, fitted on the other folds.

    One job counts hits by fold, class and bin of the score; the counts of a fold's others are the
    total less its own.  Pooling sees at most ``bins`` cells of a fold and class, whatever the rows are;
    bins without rows are interpolated.
    """
    scores = df.select("fold", F.col(y).alias("_y"), F.posexplode(F.slice(p, 1, classes)).alias("class", "_s"))
    at = F.least(F.floor(F.col("_s") * bins), F.lit(bins - 1)).cast("int")
    cells = scores.groupBy("fold", "class", at.alias("bin")).agg(F.count_if(F.col("_y") == F.col("class")).alias("hits"), F.count("*").alias("n"))

    def fitted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        folds, grid, out = sorted(part["fold"].unique()), np.arange(bins), []
        for fold in folds:
            others = part[part["fold"] != fold].groupby("bin")[["hits", "n"]].sum().sort_index()
            value = np.interp(grid, others.index.to_numpy(), pool_adjacent(others["hits"].to_numpy(), others["n"].to_numpy())) if len(others) else np.full(bins, np.nan)
            out.append(pd.DataFrame({"fold": fold, "class": key[0], "bin": grid, "value": value}))
        return pd.concat(out)

    # at most folds x bins cells a class
    return cells.groupBy("class").applyInPandas(fitted, "fold int, class int, bin int, value double")


def calibrate(df: DataFrame, classes: int, p: str = "p", y: str = "y", bins: int = 1024) -> DataFrame:
    """Adds calibrated: the class probabilities by ``calibration_map``, renormalised per row (equal where all are 0)."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("class", "bin", "value"))), lambda x: x["value"])
    maps = calibration_map(df, classes, p, y, bins).groupBy(F.col("fold").alias("_f")).agg(values.alias("_map"))  # folds x classes x bins numbers
    rows = df.join(F.broadcast(maps), F.col("fold") == F.col("_f"), "left")
    found = lambda x, c: F.coalesce(F.get("_map", c * bins + F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")), F.lit(0.0))
    raw = rows.withColumn("_raw", F.transform(F.slice(p, 1, classes), found))
    total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
    return raw.withColumn("_total", total).withColumn("calibrated", F.transform("_raw", lambda x: F.when(F.col("_total") > 0, x / F.col("_total")).otherwise(1.0 / classes))).drop("_f", "_map", "_raw", "_total")


def screening_summary(scored: DataFrame, key: str = "video_id") -> dict[str, float]:
    """Means over the folds of lift and precision at 5, 10 and 20 %, and AUC and rank correlation over all rows."""
    scored = settled(scored)  # read by several jobs
    lifts = lift_at(scored, [0.05, 0.10, 0.20], key=key, by=["fold"]).groupBy("fraction").agg(F.avg("lift").alias("lift"), F.avg("precision").alias("precision")).collect()
    out = {f"lift_{int(round(r.fraction * 100))}": float(r.lift or 0) for r in lifts} | {f"precision_{int(round(r.fraction * 100))}": float(r.precision) for r in lifts}
    out |= {"auc": float(auc(scored).first().auc or 0), "spearman": float(spearman(scored, "score", "y_value").first().rho or 0)}
    return out


def compare(df: DataFrame, target: str, k: int, specs: dict[str, tuple[Callable[[], FoldFeatures], str]], q: float = 0.9, key: str = "video_id") -> DataFrame:
    """One row of screening results per spec (features, learner), with the change in lift against the one before.
    The features of a fold are fitted and written once for all learners that share them, its threshold is found once."""
    built = {f: fold_rows(df, k, f, [key, target]) for f in dict.fromkeys(f for f, _ in specs.values())}
    cuts = [table_quantiles(df.where(F.col("fold") != i), target, [q])[0] for i in range(k)]
    scored = [screening(target, q, model, [key], cut)(*fold).withColumn("name", F.lit(name)) for name, (features, model) in specs.items() for fold, cut in zip(built[features], cuts, strict=True)]
    scored = settled(reduce(DataFrame.unionByName, scored))  # all learners are rated by the same jobs
    at = lambda column, f: F.coalesce(F.avg(F.when(F.abs(F.col("fraction") - f) < 1e-9, F.col(column))), F.lit(0.0))
    name = F.element_at(F.split("group", r"\|(?=[^|]*$)"), 1)  # the fold is the last part
    lifts = lift_at(scored, [0.05, 0.10, 0.20], key=key, by=["name", "fold"]).groupBy(name.alias("name"))
    lifts = lifts.agg(*[at("lift", f).alias(f"lift_{round(100 * f)}") for f in (0.05, 0.10, 0.20)], at("precision", 0.10).alias("precision_10"))
    order = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(specs)], "ord int, name string")
    out = order.join(lifts, "name", "left").join(auc(scored, by=["name"]), "name", "left").join(spearman(scored, "score", "y_value", ["name"]).select("name", F.col("rho").alias("spearman")), "name", "left")
    out = settled(out.select("ord", "name", "lift_5", "lift_10", "lift_20", "precision_10", F.coalesce("auc", F.lit(0.0)).alias("auc"), F.coalesce("spearman", F.lit(0.0)).alias("spearman")))  # a row a learner
    return out.withColumn("delta_lift_10", F.col("lift_10") - F.lag("lift_10").over(Window.orderBy("ord")))


def rank_models(results: DataFrame) -> DataFrame:
    """Best first: lift at 10, then AUC, precision, rank correlation, name."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(*[F.desc_nulls_last(c) for c in ("lift_10", "auc", "precision_10", "spearman")], "name")))


# --- explanations -----------------------------------------------------------------------------


def driver_families(importances: DataFrame, families: DataFrame) -> DataFrame:
    """Importance by family (the longest prefix of the feature's name that a family has), with shares."""
    hit = importances.join(F.broadcast(families), F.expr("startswith(feature, prefix)"), "left")  # families: a rule table
    best = hit.groupBy("feature").agg(F.max(F.struct(F.coalesce(F.length("prefix"), F.lit(0)).alias("n"), F.coalesce("family", F.lit("other")).alias("family")))["family"].alias("family"), F.first("importance").alias("importance"))
    out = best.groupBy("family").agg(F.sum("importance").alias("importance"), F.count("*").alias("features"))
    return out.withColumn("share", ratio(F.col("importance"), F.sum("importance").over(Window.partitionBy())))


def directional_effects(long: DataFrame) -> DataFrame:
    """Of a long table (feature, kind, x, contribution): mean with the flag on less off, or top less bottom third."""
    cuts = exact_quantiles(long.where("kind = 'number'"), {"feature": "feature"}, {"_low": ("x", 1 / 3), "_high": ("x", 2 / 3)})
    rows = long.join(cuts, "feature", "left")
    high = F.when(F.col("kind") == "flag", F.col("x") > 0).otherwise(F.col("x") >= F.col("_high"))
    low = F.when(F.col("kind") == "flag", F.col("x") <= 0).otherwise(F.col("x") <= F.col("_low"))
    out = rows.groupBy("feature", "kind").agg(F.avg(F.when(high, F.col("contribution"))).alias("high"), F.avg(F.when(low, F.col("contribution"))).alias("low"), F.avg(F.abs("contribution")).alias("importance"))
    return out.withColumn("effect", F.col("high") - F.col("low")).withColumn("direction", F.when(F.col("effect") > 0, "up").when(F.col("effect") < 0, "down").otherwise("flat"))


def explain_linear(train: DataFrame, test: DataFrame, names: list[str], label: str, by: str | None = None) -> DataFrame:
    """Contributions of a linear model on held-out rows, coefficient times deviation from the training mean: mean and mean size by feature (and group)."""
    model = LogisticRegression(labelCol=label, regParam=0.01).fit(train)
    mean = [float(x) for x in train.agg(Summarizer.mean(F.col("features"))).first()[0]]
    coef = [float(x) for x in model.coefficients]
    table = train.sparkSession.createDataFrame([(i, names[i] if i < len(names) else f"f{i}", mean[i], coef[i]) for i in range(len(coef))], "i int, feature string, m double, w double")
    keys = [by] if by else []
    cells = test.select(*keys, F.posexplode(vector_to_array("features")).alias("i", "x")).join(F.broadcast(table), "i")
    c = F.col("w") * (F.col("x") - F.col("m"))
    return cells.groupBy(*keys, "feature").agg(F.avg(c).alias("mean_contribution"), F.avg(F.abs(c)).alias("importance"))


def area(df: DataFrame, raw: str = "score", y: str = "y") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=raw, labelCol=y).evaluate(df.withColumn(y, F.col(y).cast("double")))
