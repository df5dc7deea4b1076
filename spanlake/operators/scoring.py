"""Scores of predictions by substring match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import matched_any, matched_share, scored_prediction

METRICS = {"all": matched_share, "part": matched_any}


def evaluate(predictions: DataFrame, metric: str = "all", by: str = "task", prediction: str = "pred", references: str = "outputs") -> DataFrame:
    """(task, score, nulls): mean score in percent to two places, 0 if a task's references are null; ``empty/all``."""
    share: Column = METRICS[metric](F.col("_pred"), F.col("_refs"))
    # the cleaned, lower-cased text is computed once a row, below a barrier that keeps it out of the references' lambda
    clean = predictions.select(F.col(by), F.col(references).alias("_refs"), F.transform(F.array(F.lower(scored_prediction(F.col(prediction)))), lambda x: x).alias("_one"))
    clean = clean.select(by, "_refs", F.explode("_one").alias("_pred"))
    score = F.round(F.avg(share) * 100, 2)
    return clean.groupBy(by).agg(F.coalesce(score, F.lit(0.0)).alias("score"), F.concat_ws("/", F.sum((F.length("_pred") == 0).cast("long")), F.count("*")).alias("nulls"))
