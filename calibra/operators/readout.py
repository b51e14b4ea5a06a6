"""Classifiers on feature vectors, chosen by cross-validation: standardized, optionally projected, multinomial with an L2 penalty."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose(train: DataFrame, tie: str, features: Column, y: Column, dims: list[int] | None, l2: list[float], folds: int = 3):
    """(fitted pipeline, chosen dimensions or None, chosen l2, its NLL on held-out folds). Folds go by a hash of the id."""
    rows = train.select(array_to_vector(features).alias("raw"), y.cast("double").alias("label"), F.pmod(F.xxhash64(tie), F.lit(folds)).cast("int").alias("fold")).persist()
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
    pca = PCA(inputCol="scaled", outputCol="projected", k=1)
    lr = LogisticRegression(featuresCol="projected" if dims else "scaled", family="multinomial", standardization=False, maxIter=60)
    grid = ParamGridBuilder().addGrid(lr.regParam, [2 * v for v in l2])
    if dims:
        grid = grid.addGrid(pca.k, dims)
    stages = [scaler, pca, lr] if dims else [scaler, lr]
    maps = grid.build()
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="logLoss"), numFolds=folds, foldCol="fold")
    model = cv.fit(rows)
    rows.unpersist()
    best = min(range(len(maps)), key=model.avgMetrics.__getitem__)
    return model.bestModel, maps[best].get(pca.k), maps[best][lr.regParam] / 2, model.avgMetrics[best]


def predict(model, rows: DataFrame, features: Column) -> DataFrame:
    """rows with p: the probability of each label."""
    made = model.transform(rows.withColumn("raw", array_to_vector(features)))
    return made.withColumn("p", vector_to_array("probability")).select(*rows.columns, "p")
