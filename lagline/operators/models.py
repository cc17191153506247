"""Models over feature tables with MLlib: boosted trees with early stopping, linear models and a small network.

Nothing here reproduces another library's scores; what is kept is the procedure: windows in time, rounds found on a later
window and stretched for the refit, seeds averaged, specialists, stacking on scores of rows that no model had seen.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import ID
from ..sources.scratch import discard, many_columns, stored
from .evaluate import Fold, blend_scores, clip
from .metrics import average_precision, roc_auc
from .ordered import quantile_values
from .propagate import stack_features


@dataclass(frozen=True)
class Spec:
    """kind: gbt, linear or mlp; goss or dart: own boosting, of sampled rows or with dropped trees. rounds: trees, or iterations.

    stop: what later rows end the trees by, their loss (patience: how little better it may get) or average precision.
    top, other: shares of rows by size of gradient that goss keeps, and draws from the rest. drop: chance of a tree to be
    left out of a round of dart.
    """

    kind: str = "gbt"
    rounds: int = 20
    depth: int = 4
    rate: float = 0.1
    seed: int = 7
    weight: str | None = None
    one_hot: bool = False
    patience: float = 1e-3
    hidden: tuple[int, ...] = (32, 16)
    clip: float = 5.0
    stop: str = "loss"
    top: float = 0.2
    other: float = 0.2
    drop: float = 0.2

    @property
    def trees(self) -> bool:
        return self.kind in ("gbt", "goss", "dart")


class AveragePrecision(Evaluator):
    """Step-wise average precision of a column of scores or of probabilities; larger is better."""

    def __init__(self, label: str = "label", score: str = "score"):
        super().__init__()
        self.label, self.score = label, score

    def _evaluate(self, dataset: DataFrame) -> float:
        kind = dataset.schema[self.score].dataType.simpleString()
        s = vector_to_array(self.score)[1] if kind == "vector" else F.col(self.score)
        value = average_precision(dataset.select(s.alias("score"), F.col(self.label).alias("label"))).first()
        return float("nan") if value is None or value.ap is None else value.ap

    def isLargerBetter(self) -> bool:
        return True


def prepared(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers as doubles (name__n) and flags of what is missing (name__gone)."""
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c] != "string"]
    return df.select("*", *[F.col(c).cast("double").alias(f"{c}__n") for c in numbers], *[F.col(c).isNull().cast("double").alias(f"{c}__gone") for c in numbers])


def codes(rows: DataFrame, columns: Sequence[str], spec: Spec) -> PipelineModel:
    """Codes of strings by frequency (unseen values are a value) and medians of numbers, taken from rows; fits of specs that code strings alike can share them."""
    kinds = dict(rows.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    numbers = [c for c in columns if kinds[c] != "string"]
    stages: list = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="frequencyDesc") for c in text]
    if text and spec.one_hot:
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in text], outputCols=[f"{c}__h" for c in text], dropLast=False, handleInvalid="keep"))
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=[f"{c}__n" for c in numbers], outputCols=[f"{c}__m" for c in numbers]))
    with many_columns(rows.sparkSession):
        return Pipeline(stages=stages).fit(prepared(rows, columns))


@dataclass
class Inputs:
    """What columns become: codes of strings, numbers with medians in their gaps, and a flag for each column of which a row of the fit lacks the value.

    A flag that is 0 in all rows is in no split and weighs nothing when scaled: it is left out. all: parts and their sizes with these flags, too.
    scales: mean and deviation of each place; none for trees.
    """

    codes: PipelineModel
    all: list[tuple[str, int]]
    flags: set[str]
    scales: list[tuple[float, float]] | None = None

    def live(self) -> list[bool]:
        """Of each place of all parts, whether it is used."""
        return [not c.endswith("__gone") or c in self.flags for c, n in self.all for _ in range(n)]

    def transform(self, rows: DataFrame, columns: Sequence[str], limit: float = 0.0) -> DataFrame:
        """Adds features. Columns, not vectors, are filled, scaled and clipped to limit, so that a row is made a vector once."""
        held, parts = self.codes.transform(prepared(rows, columns)), [(c, n) for c, n in self.all if not c.endswith("__gone") or c in self.flags]
        wide = [c for c, _ in parts if c.endswith("__h")]
        named = {} if self.scales else VectorAssembler(inputCols=[c for c, _ in parts], outputCol="features").transform(held.limit(0)).schema["features"].metadata
        held = held.withColumns({c: vector_to_array(c) for c in wide}) if wide else held
        places = [F.get(c, F.lit(k)) if c in wide else F.col(c) for c, n in parts for k in range(n)]
        if self.scales:
            places = [clip((c - F.lit(mean)) * F.lit(1 / std if std else 0.0), -limit, limit) for c, (mean, std) in zip(places, self.scales, strict=True)]
        return held.select("*", array_to_vector(F.array(*places)).alias("features", metadata=named))


def fit_inputs(base: DataFrame, train: DataFrame, columns: Sequence[str], spec: Spec, known: PipelineModel | None = None) -> Inputs:
    """base: the rows that codes, medians and scales are taken from. known: the codes of base, where they have been fitted."""
    kinds, held = dict(base.dtypes), known or codes(base, columns, spec)
    text = [c for c in columns if kinds[c] == "string"]
    numbers = [c for c in columns if kinds[c] != "string"]
    seen = (train if spec.trees else base).agg(*[F.max(F.col(c).isNull()).alias(c) for c in numbers]).first() if numbers else {}
    schema = held.transform(prepared(base.limit(0), columns)).schema
    size = {c: schema[f"{c}__h"].metadata["ml_attr"]["num_attrs"] if spec.one_hot else 1 for c in text}
    every = [*((f"{c}__{'h' if spec.one_hot else 'i'}", size[c]) for c in text), *((f"{c}__m", 1) for c in numbers), *((f"{c}__gone", 1) for c in numbers)]
    out = Inputs(held, every, {f"{c}__gone" for c in numbers if seen[c]})
    if not spec.trees:
        with many_columns(base.sparkSession):
            scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(out.transform(base, columns))
        out.scales = list(zip(scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), strict=True))
    return out


@dataclass
class Boosted:
    """Regression trees and their weights; a margin is the weighted sum of what they predict."""

    trees: list
    weights: list[float]

    def predictions(self, rows: DataFrame) -> DataFrame:
        """Adds _p: what each tree predicts, in order."""
        held = rows
        for k, t in enumerate(self.trees):
            held = t.copy().setPredictionCol(f"_tree{k}").transform(held)
        parts = F.array(*[F.col(f"_tree{k}") for k in range(len(self.trees))]) if self.trees else F.array().cast("array<double>")
        return held.withColumn("_p", parts).drop(*[f"_tree{k}" for k in range(len(self.trees))])

    def margin(self, without: Sequence[int] = ()) -> Column:
        parts = [F.lit(w) * F.element_at("_p", k + 1) for k, w in enumerate(self.weights) if k not in without]
        return reduce(Column.__add__, parts, F.lit(0.0))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin()))

    def staged(self) -> Column:
        """The margins after the first tree, the first two, and so on."""
        weighed = F.zip_with("_p", F.array(*[F.lit(float(w)) for w in self.weights]), lambda p, w: p * w)
        return F.aggregate(weighed, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))


def staged_precision(model: Boosted, rows: DataFrame, label: str = "_y") -> DataFrame:
    """rounds, ap: average precision after every number of trees. All trees score the rows in one pass, and all rounds are one grouped scan."""
    stages = model.predictions(rows).select(F.col(label).cast("int").alias("label"), F.posexplode(model.staged()).alias("_round", "score"))
    held = average_precision(stages.select("label", (F.col("_round") + 1).alias("rounds"), "score"), by=["rounds"])
    return held.select("rounds", "ap")


def best_rounds(model: Boosted, rows: DataFrame, label: str = "_y") -> int:
    """The fewest trees that reach the best average precision of the rows."""
    best = staged_precision(model, rows, label).where("ap is not null").orderBy(F.desc("ap"), "rounds").first()
    return best.rounds if best else len(model.trees)


#: Rounds of boosting between two written tables.
WRITTEN = 10


def boosted(rows: DataFrame, spec: Spec) -> Boosted:
    """Boosting of logistic loss over regression trees: rows are a written table with features, _y and _key.

    Rows are not written anew: a round scores them by the trees since what was last written, and only every WRITTEN rounds
    the trees' predictions are, so that a round costs the same however many there are.
    goss: rows of the largest gradients, and of the rest a share drawn by a hash of _key, seed and round, with the weight
    that makes up for the others. dart: every tree is left out of a round with a chance drawn from the seed; the new tree
    and those left out are scaled so that together they weigh what those left out did.
    """
    model, draw, tables = Boosted([], []), random.Random(spec.seed), []
    held, since = rows.withColumn("_p", F.array().cast("array<double>")), 0
    for k in range(spec.rounds):
        gone = [j for j in range(k) if draw.random() < spec.drop] if spec.kind == "dart" else []
        slope = F.col("_y") - 1 / (1 + F.exp(-2 * model.margin(gone)))
        scored = Boosted(model.trees[since:], []).predictions(held.withColumnRenamed("_p", "_past")).withColumn("_p", F.concat("_past", "_p")).drop("_past")
        if k - since == WRITTEN:
            scored, since = stored(scored, "boost"), k
            held = scored
            tables.append(held)
        now = scored.select("features", "_key", (2 * slope).alias("_g")).withColumn("_w", F.lit(1.0))
        if spec.kind == "goss":
            now = now.withColumn("_size", F.abs("_g"))
            cut = quantile_values(now, "_size", [1 - spec.top])[0]
            u = F.pmod(F.xxhash64("_key", F.lit(spec.seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
            large = F.col("_size") >= F.lit(cut)
            now = now.where(large | (u < spec.other / (1 - spec.top))).withColumn("_w", F.when(large, 1.0).otherwise((1 - spec.top) / spec.other))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="_g", weightCol="_w", maxDepth=spec.depth, maxBins=64, seed=spec.seed).fit(now)
        share = 1 / (len(gone) + 1)
        for j in gone:
            model.weights[j] *= len(gone) * share
        model.trees.append(tree)
        model.weights.append(spec.rate * share if gone else spec.rate)
        for done in tables[:-1]:
            discard(done)
        tables = tables[-1:]
    for done in tables:
        discard(done)
    return model


@dataclass
class Fitted:
    columns: list[str]
    inputs: Inputs
    model: object
    spec: Spec

    @property
    def rounds(self) -> int:
        """Trees that early stopping left, or the iterations asked for."""
        return len(self.model.trees) if self.spec.trees else self.spec.rounds

    def score(self, rows: DataFrame) -> DataFrame:
        """transaction_id and score of each row, written once: a filter on a score would otherwise be planned as one on all columns that it comes from."""
        held = self.inputs.transform(rows, self.columns, self.spec.clip)
        if isinstance(self.model, Boosted):
            out = self.model.predictions(held.select(ID, "features")).select(ID, self.model.probability().alias("score"))
        else:
            out = self.model.transform(held).select(ID, vector_to_array("probability")[1].alias("score"))
        with many_columns(rows.sparkSession):
            return stored(out, "scores")

    def importance(self, rows: DataFrame) -> DataFrame:
        """feature, gain: what the trees gained by each column, its codes and its missing flag together. A row a column."""
        attributes = self.inputs.transform(rows.limit(0), self.columns).schema["features"].metadata["ml_attr"]["attrs"]
        order = sorted((a["idx"], a["name"]) for group in attributes.values() for a in group)
        gains = dict.fromkeys(self.columns, 0.0)
        for (_, name), gain in zip(order, self.model.featureImportances.toArray().tolist(), strict=True):
            gains[name.split("__")[0]] += gain
        return rows.sparkSession.createDataFrame(sorted(gains.items()), "feature string, gain double")


@dataclass
class Matrix:
    """What a fit reads: the fitted inputs, and a written table of features, _y, _key and weights; _later where there are later rows."""

    inputs: Inputs
    rows: DataFrame


def matrix_rows(train: DataFrame, columns: Sequence[str], spec: Spec, valid: DataFrame | None = None, prepare_on: DataFrame | None = None, label: str = "label", weights: Sequence[str] = (), known: PipelineModel | None = None) -> Matrix:
    """For all fits on these rows whose specs code inputs alike. weights: columns that one of them weighs rows by. known: codes() of the rows to prepare on."""
    columns = list(columns)
    labelled = train.where(F.col(label).isNotNull())
    early = valid is not None
    inputs = fit_inputs(train if prepare_on is None else prepare_on, labelled, columns, spec, known)
    if early:
        labelled = labelled.withColumn("_later", F.lit(False)).unionByName(valid.where(F.col(label).isNotNull()).withColumn("_later", F.lit(True)), allowMissingColumns=True)
        labelled = labelled.withColumns({w: F.coalesce(w, F.lit(1.0)) for w in weights})
    rows = inputs.transform(labelled, columns, spec.clip).select("features", F.col(label).cast("double").alias("_y"), F.col(ID).alias("_key"), *(["_later"] if early else []), *weights)
    with many_columns(train.sparkSession):
        return Matrix(inputs, stored(rows, "matrix"))  # read once a round


def network(rows: DataFrame, inputs: Inputs, spec: Spec, **common) -> MultilayerPerceptronClassifier:
    """A perceptron over the live places, which begins with the weights that they have in one over all places."""
    live, first = inputs.live(), spec.hidden[0] if spec.hidden else 2
    wide = [len(live), *spec.hidden, 2]
    drawn = MultilayerPerceptronClassifier(maxIter=0, layers=wide, seed=spec.seed).fit(rows.sparkSession.createDataFrame([(Vectors.dense([0.0] * len(live)), 0.0)], ["features", "label"])).weights.toArray()
    of_inputs = drawn[: len(live) * first].reshape(len(live), first)[np.array(live)]
    begin = np.concatenate([of_inputs.ravel(), drawn[len(live) * first :]])
    return MultilayerPerceptronClassifier(maxIter=spec.rounds, layers=[len(of_inputs), *spec.hidden, 2], seed=spec.seed, initialWeights=Vectors.dense(begin), **common)


def fit(train: DataFrame, columns: Sequence[str], spec: Spec = Spec(), valid: DataFrame | None = None, prepare_on: DataFrame | None = None, label: str = "label", held: Matrix | None = None, known: PipelineModel | None = None) -> Fitted:
    """valid: later rows on which trees stop growing in number. prepare_on: the rows that codes, medians and scales are taken from (default: train).

    held: the matrix of these rows, where fits share one; it stays. known: codes() of the rows to prepare on, where fits share those.
    """
    columns = list(columns)
    early = spec.trees and valid is not None
    own = held or matrix_rows(train, columns, spec, valid if early else None, prepare_on, label, [spec.weight] if spec.weight else [], known)
    inputs, rows = own.inputs, own.rows
    common = {"labelCol": "_y", "featuresCol": "features"} | ({"weightCol": spec.weight} if spec.weight and spec.kind != "mlp" else {})
    by_precision = early and (spec.stop == "precision" or spec.kind != "gbt")
    if spec.kind in ("goss", "dart"):
        model = boosted(rows.where("not _later") if early else rows, spec)
    elif spec.kind == "gbt":
        model = GBTClassifier(maxIter=spec.rounds, maxDepth=spec.depth, stepSize=spec.rate, seed=spec.seed, maxBins=64, validationTol=spec.patience, **common, **({"validationIndicatorCol": "_later"} if early and not by_precision else {}))
    elif spec.kind == "linear":
        model = LogisticRegression(maxIter=spec.rounds, regParam=0.01, **common)
    else:
        model = network(rows, inputs, spec, **common)
    if not isinstance(model, Boosted):
        model = model.fit(rows.where("not _later") if by_precision else rows)
    if by_precision:
        whole = model if isinstance(model, Boosted) else Boosted(list(model.trees), list(model.treeWeights))
        keep = best_rounds(whole, rows.where("_later"))
        model = Boosted(whole.trees[:keep], whole.weights[:keep])
    if held is None:
        discard(rows)
    return Fitted(columns, inputs, model, spec)


def top_features(importance: DataFrame, k: int) -> list[str]:
    """The k columns with the largest gain."""
    return [r.feature for r in importance.orderBy(F.desc("gain"), "feature").limit(k).collect()]  # k rows


def refit(df: DataFrame, fold: Fold, rows: DataFrame, columns: Sequence[str], spec: Spec = Spec(), seeds: Sequence[int] = (0, 1, 2, 3, 4), stretch: float = 1.1) -> DataFrame:
    """Rounds from early stopping on the fold, stretched; then fits on all labelled rows of df, one a seed, and the mean of their scores of rows."""
    probe = fit(fold.train(df), columns, spec, valid=fold.validate(df))
    final = replace(spec, rounds=max(1, math.ceil(probe.rounds * stretch)))
    held = matrix_rows(df, columns, final, weights=[final.weight] if final.weight else [])  # one for all seeds
    out = blend_scores([(fit(df, columns, replace(final, seed=s), held=held).score(rows), 1.0) for s in seeds])
    discard(held.rows)
    return out


def full_and_recent(df: DataFrame, fold: Fold, columns: Sequence[str], spec: Spec = Spec(), days: int = 90, weight: float = 0.6, early: bool = False, known: PipelineModel | None = None) -> DataFrame:
    """A model on all history and a specialist on the last days before the fold, blended by probability. known: codes() of the last days."""
    rows = fold.validate(df)
    one, two = (fit(f.train(df), columns, spec, valid=rows if early else None, known=k).score(rows) for f, k in ((fold, None), (fold.recent(days), known)))
    return blend_scores([(one, weight), (two, 1 - weight)])


def out_of_fold(df: DataFrame, folds: Sequence[Fold], columns: Sequence[str], spec: Spec = Spec()) -> DataFrame:
    """transaction_id, fold, score: every fold's rows scored by a model of what came before; rows for a second stage."""
    parts = [fit(f.train(df), columns, spec).score(f.validate(df)).withColumn("fold", F.lit(f.name)) for f in folds]
    return reduce(DataFrame.unionByName, parts)


def neighbourhood(df: DataFrame, scores: DataFrame, entities: Mapping[str, str], half_us: int) -> DataFrame:
    """df's rows that have a score, with it and the neighbourhood features of each entity (prefix -> column)."""
    held = df.join(scores.select(ID, "score"), ID)
    for p, e in entities.items():
        held = stack_features(held, e, p, half_us=half_us)
    return held


def stacked(df: DataFrame, folds: Sequence[Fold], last: Fold, columns: Sequence[str], entities: Mapping[str, str], half_us: int, first: Spec = Spec(), second: Spec = Spec(depth=3)) -> DataFrame:
    """transaction_id, score, stacked: rows of the last fold, by a second stage that learned from out-of-fold scores and their neighbourhoods."""
    features = ["score", *(f"{p}_nb_{c}" for p in entities for c in ("mean", "max", "n", "gap", "maxgap", "rank"))]
    rows = df.select(ID, "us", *entities.values(), "label")
    before = out_of_fold(df, folds, columns, first)
    scores = fit(last.train(df), columns, first).score(last.validate(df))
    seen = stored(neighbourhood(rows, before, entities, half_us), "stack")
    now = stored(neighbourhood(rows, scores, entities, half_us), "stack")
    return scores.join(fit(seen, features, second).score(now).withColumnRenamed("score", "stacked"), ID)


def grid(df: DataFrame, folds: Sequence[Fold], columns: Sequence[str], arms: Mapping[str, Spec], label: str = "label") -> DataFrame:
    """arm, window, metric: average precision of each arm on each fold; a row each. A window in time, never a random part.

    Arms that code inputs alike read one matrix a fold.
    """
    rows, alike = [], lambda spec: (spec.trees, spec.one_hot)
    weights = {k: sorted({s.weight for s in arms.values() if s.weight and alike(s) == k}) for k in map(alike, arms.values())}
    for fold in folds:
        truth, train, found = fold.validate(df).select(ID, label), fold.train(df), {}
        for arm, spec in arms.items():
            if alike(spec) not in found:
                found[alike(spec)] = matrix_rows(train, columns, spec, label=label, weights=weights[alike(spec)])
            scores = fit(train, columns, spec, label=label, held=found[alike(spec)]).score(fold.validate(df))
            rows.append((arm, fold.name, AveragePrecision(label)._evaluate(truth.join(scores, ID))))
            discard(scores)
        for held in found.values():
            discard(held.rows)
    return df.sparkSession.createDataFrame(rows, "arm string, window string, metric double")


def blend_grid(truth: DataFrame, blends: Mapping[float, DataFrame], label: str = "label") -> DataFrame:
    """weight, metric: average precision of each blend."""
    rows = [(float(w), AveragePrecision(label)._evaluate(truth.select(ID, label).join(s, ID))) for w, s in blends.items()]
    return truth.sparkSession.createDataFrame(rows, "weight double, metric double")


def adversarial(early: DataFrame, late: DataFrame, columns: Sequence[str], split, spec: Spec = Spec()) -> tuple[DataFrame, DataFrame]:
    """How well two periods can be told apart: the area under the ROC curve on held-out rows, and the columns' gains. split: stratified_split."""
    both = stored(split(early.withColumn("period", F.lit(0)).unionByName(late.withColumn("period", F.lit(1)), allowMissingColumns=True), label="period"), "periods")
    model = fit(both.where("not held_out"), columns, spec, label="period")
    test = both.where("held_out")
    auc = roc_auc(test.select(ID, F.col("period").alias("label")).join(model.score(test), ID))
    return auc, model.importance(test)
