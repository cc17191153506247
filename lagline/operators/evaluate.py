"""Walk-forward windows, samples, and model columns. No split is random but the diagnostic one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DAY, dbl
from ..plans.frames import ID, US
from .ordered import placed, quantile_values, running

#: Columns that only group, order or label; never inputs of a model.
ROLES = {ID, US, "timestamp", "customer_id", "merchant_id", "device_id", "label", "fraud", "is_test"}
NUMBERS = ("double", "float", "int", "bigint", "decimal")


@dataclass(frozen=True)
class Fold:
    """Train on us < start, validate on start <= us < end."""

    name: str
    start: int
    end: int
    train_days: int | None = None

    def train(self, df: DataFrame) -> DataFrame:
        held = df.where(F.col(US) < self.start)
        return held.where(F.col(US) >= self.start - self.train_days * DAY) if self.train_days else held

    def validate(self, df: DataFrame) -> DataFrame:
        return df.where((F.col(US) >= self.start) & (F.col(US) < self.end))

    def recent(self, days: int) -> Fold:
        """The same window, trained on the last days before it."""
        return Fold(self.name, self.start, self.end, days)


def walk_forward(first: int, width: int, n: int) -> list[Fold]:
    return [Fold(f"fold{k}", first + k * width, first + (k + 1) * width) for k in range(n)]


def receding(start: int, end: int, cuts: Sequence[int]) -> list[tuple[Fold, int]]:
    """One fixed validation window, and train cut-offs further and further back (days)."""
    return [(Fold(f"minus{d}d", start, end), start - d * DAY) for d in cuts]


def receding_rows(df: DataFrame, start: int, end: int, cuts: Sequence[int], label: str = "label") -> DataFrame:
    """Training rows and positives before each cut-off, and the rows of the one validation window; one pass."""
    y, parts = F.col(label).cast("long"), []
    for fold, cut in receding(start, end, cuts):
        train, valid = F.col(US) < cut, (F.col(US) >= start) & (F.col(US) < end)
        parts.append(F.struct(F.lit(fold.name).alias("fold"), F.count_if(train).alias("train_rows"), F.coalesce(F.sum(F.when(train, y)), F.lit(0)).alias("train_pos"), F.count_if(valid).alias("valid_rows")))
    return df.agg(F.array(*parts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def fold_rows(df: DataFrame, folds: Sequence[Fold], label: str = "label") -> DataFrame:
    """Rows and positives on both sides of each fold, in one pass."""
    parts = []
    for f in folds:
        low = f.start - f.train_days * DAY if f.train_days else None
        train = F.col(US) < f.start if low is None else (F.col(US) < f.start) & (F.col(US) >= low)
        valid = (F.col(US) >= f.start) & (F.col(US) < f.end)
        y = F.col(label).cast("long")
        parts.append(F.struct(F.lit(f.name).alias("fold"), F.count_if(train).alias("train_rows"), F.coalesce(F.sum(F.when(train, y)), F.lit(0)).alias("train_pos"), F.count_if(valid).alias("valid_rows"), F.coalesce(F.sum(F.when(valid, y)), F.lit(0)).alias("valid_pos")))
    return df.agg(F.array(*parts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def feature_columns(df: DataFrame, exclude: Sequence[str] = (), without: Sequence[str] = ()) -> list[str]:
    """Columns that may enter a model: no roles, none excluded, none whose name holds one of `without`."""
    kinds = dict(df.dtypes)
    return [c for c in df.columns if c not in ROLES and c not in exclude and not any(w in c for w in without) and kinds[c].startswith((*NUMBERS, "string"))]


def families(columns: Sequence[str], markers: Sequence[str]) -> list[str]:
    """The columns whose names hold one of the markers."""
    return [c for c in columns if any(m in c for m in markers)]


def model_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """transaction_id, label if there is one, and the columns: numbers as float, text as it is. Any other type, and any role, is refused."""
    kinds, bad = dict(df.dtypes), []
    out = [F.col(c) for c in (ID, "label") if c in df.columns]
    for c in columns:
        if c in ROLES or not kinds[c].startswith((*NUMBERS, "string")):
            bad.append(f"{c} ({kinds[c]})")
        out.append(F.col(c) if kinds[c] == "string" else F.col(c).cast("float").alias(c))
    if bad:
        raise TypeError(f"not model inputs: {', '.join(bad)}")
    return df.select(*out)


def hashed_order(df: DataFrame, label: str, seed: int) -> DataFrame:
    """_place: a row's number, from 0, among rows of its label in the order of a hash of its id; _of: how many there are."""
    held = df.withColumns({"_hash": F.md5(F.concat(F.lit(f"{seed}:"), F.col(ID).cast("string")))})  # md5: any engine can draw the same rows
    ranked = placed(held, [label], ["_hash", ID], "_place")  # whole rows move once, in even ranges
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_of"))
    return ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label"))).drop("_hash", "_label")  # a row a label


def stratified_sample(df: DataFrame, rows: int, label: str = "label", seed: int = 7) -> DataFrame:
    """Exactly `rows` rows (all, if there are no more), positives in their share but one at least; the same rows whatever the partitioning."""
    n, positives = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    if n <= rows:
        return df
    wanted = min(positives, max(1, round(positives * rows / n)))
    quota = F.when(F.col(label) == 1, wanted).otherwise(rows - wanted)
    return hashed_order(df.withColumn("_y", F.coalesce((F.col(label) == 1).cast("int"), F.lit(0))), "_y", seed).where(F.col("_place") < quota).select(*df.columns)


def stratified_split(df: DataFrame, share: float = 0.2, label: str = "label", seed: int = 7) -> DataFrame:
    """Adds held_out: round(share * n) rows of each label, by hash. For the diagnostic of what tells two periods apart only."""
    return hashed_order(df, label, seed).withColumn("held_out", F.col("_place") < F.round(F.col("_of") * F.lit(share)).cast("long")).select(*df.columns, "held_out")


def top_rows(df: DataFrame, by: str, k: int, tie: str = ID) -> DataFrame:
    """The k rows with the largest values, in order; ties by the second column."""
    return df.orderBy(F.desc_nulls_last(by), tie).limit(k)


def blend_scores(parts: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of scores by transaction_id: probabilities, not ranks."""
    total = sum(w for _, w in parts)
    out = None
    for scores, w in parts:
        held = scores.select(ID, (F.col("score") * F.lit(w / total)).alias("score"))
        out = held if out is None else out.unionByName(held)
    return out.groupBy(ID).agg(F.sum("score").alias("score"))


def rank_mean(parts: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of each part's average-tie percent ranks."""
    from .drift import average_rank

    return blend_scores([(average_rank(s, "score", "_rank").select(ID, F.col("_rank").alias("score")), w) for s, w in parts])


def soft_labels(train: DataFrame, unlabelled: DataFrame, scores: DataFrame, label: str = "label", weight: float = 1.0) -> DataFrame:
    """Soft pseudo labels: every unlabelled row twice, positive with weight score and negative with the rest."""
    soft = unlabelled.join(scores, ID).withColumn("_both", F.explode(F.array(F.lit(1), F.lit(0))))
    soft = soft.withColumn(label, F.col("_both")).withColumn("weight", F.lit(weight) * F.when(F.col("_both") == 1, F.col("score")).otherwise(1 - F.col("score"))).drop("_both", "score")
    return train.withColumn("weight", F.lit(1.0)).unionByName(soft, allowMissingColumns=True)


def hard_labels(train: DataFrame, unlabelled: DataFrame, scores: DataFrame, label: str = "label", top: float = 0.02, weight: float = 1.0) -> DataFrame:
    """Hard pseudo labels: 1 for scores at or above the exact quantile 1 - top, else 0."""
    cut = quantile_values(scores, "score", [1 - top])[0]
    hard = unlabelled.join(scores, ID).withColumn(label, (F.col("score") >= F.lit(cut)).cast("int")).withColumn("weight", F.lit(weight)).drop("score")
    return train.withColumn("weight", F.lit(1.0)).unionByName(hard, allowMissingColumns=True)


def compared_by_fold(results: DataFrame, baseline: DataFrame, metric: str = "metric") -> DataFrame:
    """Each result beside the baseline's of the same fold, and their difference; folds that one side lacks have nulls."""
    base = baseline.select("fold", F.col(metric).alias("baseline"))
    return results.join(base, "fold", "full").withColumn("delta", dbl(metric) - dbl("baseline"))


def clip(c: Column, low: float, high: float) -> Column:
    """Nulls stay null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: 1 for the most frequent value, then on (ties by value); 0 is left for values that were not there. The coding of an embedding or an index."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("_one"))
    return running(counts, [], ["n", "value"], {"_before": "_one"}, descending=True).select("value", (F.col("_before") + 1).alias("code"))


def blend_weights(grid: Sequence[float], first: DataFrame, second: DataFrame) -> Mapping[float, DataFrame]:
    """Scores w * first + (1 - w) * second for each w."""
    return {w: blend_scores([(first, w), (second, 1 - w)]) for w in grid}
