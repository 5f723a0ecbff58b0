"""Pooled mean-reversion classifier over all symbols."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators.indicators import reversion_features, reversion_label
from factorspark.session import settled

#: Training rows of a partition. Boosting runs hundreds of small jobs, and each pays for every partition of its table.
ROWS_EACH = 50_000
FEATURES = ("z_10", "z_20", "momentum_decay", "rsi_proxy", "roc_5", "roc_10", "vol_10", "from_high", "from_low", "trend_r2",
            "consecutive", "reversion_speed")


def training_rows(hist: DataFrame, x: str = "score") -> DataFrame:
    return reversion_features(hist, x).join(reversion_label(hist, x), ["symbol", "d"])


def classifier(trees: int = 100, seed: int = 42) -> Pipeline:
    """Gradient-boosted trees: depth 4, step 0.1, 80 percent row samples."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        GBTClassifier(labelCol="reverted", featuresCol="features", maxIter=trees, maxDepth=4, stepSize=0.1,
                      subsamplingRate=0.8, seed=seed)])


def by_size(rows: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """Rows kept in as many partitions as their number asks for, whatever the session's shuffle partitions are.

    Their places follow from symbol and date, so the row samples of the trees are the same in every session.
    """
    kept = settled(rows)
    n = max(1, -(-kept.count() // rows_each))
    dealt = settled(kept.repartition(n, "symbol", "d").sortWithinPartitions("symbol", "d"))
    kept.unpersist()
    return dealt


def fit_reversion(rows: DataFrame, trees: int = 100, folds: int = 3) -> tuple[PipelineModel, float]:
    """Model on all rows and its mean accuracy over expanding, time-ordered folds.

    The dates (one row each) are cut into ``folds + 1`` parts; each fold trains on the parts
    before the one it is tested on.
    """
    days = rows.select("d").distinct().withColumn("part", F.ntile(folds + 1).over(Window.orderBy("d")))
    data = by_size(rows.join(days, "d"))
    last = folds + 2    # beyond the last part: the model on all rows

    def fitted(k: int) -> tuple[PipelineModel, float]:
        model = classifier(trees).fit(data.where(F.col("part") < k))
        hit = None if k == last else model.transform(data.where(F.col("part") == k)).agg(
            F.avg((F.col("prediction") == F.col("reverted")).cast("double"))).first()[0]
        return model, 0.5 if hit is None else float(hit)
    # the fits don't need each other, and each is a long row of jobs that leave most cores idle
    with ThreadPool(folds + 1) as pool:
        done = pool.map(inheritable_thread_target(data.sparkSession)(fitted), range(last, 1, -1))
    right = [hit for _, hit in done[1:]]
    return done[0][0], sum(right) / len(right)


def reversion_probability(model: PipelineModel, hist: DataFrame, accuracy: float, x: str = "score") -> DataFrame:
    """Probability of a reversion at each symbol's last row, with the folds' accuracy."""
    feats = reversion_features(hist, x)
    newest = feats.groupBy("symbol").agg(F.max("d").alias("d"))
    out = model.transform(feats.join(newest, ["symbol", "d"]))
    return out.select("symbol", vector_to_array("probability")[1].alias("reversion_prob"), F.lit(accuracy).alias("cv_accuracy"))


def feature_importances(model: PipelineModel) -> dict[str, float]:
    return dict(zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist()))
