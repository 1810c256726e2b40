"""Grouped-validation model training on featurised measurement rows, with MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise.functions.thermal import temperature_features
from meltwise.operators.checkpoints import cut

c = F.col
NUMERIC = ["gp", "md_avg", "md_gamma", "vec_avg", "density", "mismatch", "sss_wt", "formers_wt", "vrh", "al_ti_ratio",
           "t_c", "t_sq", "log_k", "inv_k"]
CATEGORICAL = ["route", "tcp_risk"]


def training_frame(features: DataFrame, measurements: DataFrame, prop: str, lo: float, hi: float) -> DataFrame:
    """One row per admissible point with features, temperature terms and the entity weight."""
    rows = measurements.where((c("property") == prop) & c("value").between(lo, hi) & c("temp_c").between(-270, 1500))
    n = rows.groupBy("entity").agg((1.0 / F.sqrt(F.count("*"))).alias("weight"))
    x = features.join(rows, "entity").join(n, "entity")
    return x.withColumns(temperature_features(c("temp_c"))).withColumn("label", c("value"))


def entity_fold(entity: Column, folds: int, seed: int = 42) -> Column:
    """Fold of an entity from its hash, so all rows of an entity share it."""
    return F.pmod(F.xxhash64(F.lit(seed), entity), F.lit(folds)).cast("int")


def with_missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{n}_missing": c(n).isNull().cast("double") for n in columns})


def prep_stages(numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL, flags: list[str] = ()) -> list:
    """Median imputation with indicators, scaling, and one-hot of categories (unknown ones kept apart)."""
    filled = [f"{n}_filled" for n in numeric]
    return [
        Imputer(strategy="median", inputCols=numeric, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numeric_vec"),
        StandardScaler(inputCol="numeric_vec", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=categorical, outputCols=[f"{n}_idx" for n in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{n}_idx" for n in categorical], outputCols=[f"{n}_hot" for n in categorical], handleInvalid="keep"),
        VectorAssembler(inputCols=["scaled", *[f"{n}_hot" for n in categorical], *flags], outputCol="features"),
    ]


def ensemble(df: DataFrame, trees: int = 10, depth: int = 4, rounds: int = 8, stages: list | None = None) -> list:
    """Boosted trees and random forest fitted on one prepared frame; predictions are averaged."""
    prep = Pipeline(stages=prep_stages() if stages is None else stages).fit(df)
    ready = cut(prep.transform(df).select("features", "label", "weight"))
    boost = GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=42, predictionCol="p_boost")
    forest = RandomForestRegressor(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=42, predictionCol="p_forest")
    return [prep, boost.fit(ready), forest.fit(ready)]


def predict(models: list, df: DataFrame) -> DataFrame:
    for m in models:
        df = m.transform(df)
    return df.withColumn("pred", (c("p_boost") + c("p_forest")) / 2.0)


def group_cv(df: DataFrame, folds: int = 5, **params) -> DataFrame:
    """Out-of-fold predictions with entity folds: (entity, temp_c, fold, label, pred)."""
    # Every fold fits several models on these rows, so they are written once.
    x = cut(df.withColumn("fold", entity_fold(c("entity"), folds)))
    out = None
    for k in range(folds):
        models = ensemble(x.where(c("fold") != k), **params)
        y = predict(models, x.where(c("fold") == k)).select("entity", "temp_c", "fold", "label", "pred")
        out = y if out is None else out.unionByName(y)
    return out


def order_statistics(df: DataFrame, keys: list[str], value: str, alpha: float, slices: int = 64) -> DataFrame:
    """Lower and upper conformal order statistics of each group, exact, with sliced running counts."""
    from meltwise.operators.ranks import running_count

    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    r = running_count(counts, keys, value, "_c", slices).join(n, keys)
    end = c("_before") + c("_c")
    hi = F.least(c("_n"), F.ceil((1.0 - alpha) * (c("_n") + 1)))
    lo = F.greatest(F.lit(1), F.floor(alpha * (c("_n") + 1)))
    at = lambda k: F.max(F.when((c("_before") < k) & (k <= end), c(value)))
    return r.groupBy(*keys).agg(at(lo).alias("q_lo"), at(hi).alias("q_hi"), F.max("_n").alias("n"))
