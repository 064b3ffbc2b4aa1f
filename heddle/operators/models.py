"""Scoring models on vectors: a linear stand-in for the neural stage, its ablations, and batch scores."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled rows a model is fitted on at most; scores cover every row


def _vectors(df: DataFrame, features: Column, label: str | None) -> DataFrame:
    x = df.withColumn("_x", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    return x.withColumn("_y", F.col(label).cast("double")) if label else x


def fit(df: DataFrame, id_col: str, features: Column, label: str, seed: int = 1, sample: int = SAMPLE):
    """A logistic model of a label that is 0 or more; rows below 0 are unlabelled. The sample is the first rows by a hash of the id."""
    rows = _vectors(df.filter(F.col(label) >= 0), features, label).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(sample)
    return LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01).fit(rows.select("_x", "_y"))


def score(model, df: DataFrame, features: Column) -> DataFrame:
    """Adds probs (array) and guess to every row."""
    out = model.transform(_vectors(df, features, None))
    return out.withColumn("probs", vector_to_array("probability")).withColumn("guess", F.col("prediction").cast("int")).drop("_x", "rawPrediction", "probability", "prediction")


def ablation(df: DataFrame, id_col: str, configs: dict[str, Column], label: str, test: Column) -> DataFrame:
    """(config, accuracy, n) of one model for each set of features, fitted on the rest and measured on the test rows."""
    out = None
    for name, cols in configs.items():
        s = score(fit(df.filter(~test), id_col, cols, label), df.filter(test & (F.col(label) >= 0)), cols)
        one = s.agg(F.lit(name).alias("config"), F.avg((F.col("guess") == F.col(label)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
