"""The price model as an ML stage: equal to the plain fit, in pipelines, saved, in cross-validation."""
import subprocess
import sys

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from abode.operators import model as M
from abode.operators.price_estimator import PriceRidge
from abode.session import scratch_path


def listings(spark, n=600):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        x = [float(v) for v in rng.uniform(1, 9, len(M.INPUTS))]
        rows.append([i, *x, 1e9 * (3 + x[0] + 0.1 * x[1] * x[2] + float(rng.normal(0, 0.1))), i % 5])
    rows[3][1] = None
    rows[4][-2] = None
    return spark.createDataFrame([tuple(r) for r in rows], ["house_id", *M.INPUTS, "price", "fold"]).repartition(3)


def test_degree_5_in_a_pipeline_and_in_another_session(spark):
    df = listings(spark)
    keep = SQLTransformer(statement="SELECT * FROM __THIS__ WHERE house_id >= 0")
    fitted = Pipeline(stages=[keep, PriceRidge()]).fit(df)
    plain = M.fit(df)
    ridge = fitted.stages[1].ridge
    assert ridge.alpha == plain.alpha and len(ridge.beta) == 251 and np.allclose(ridge.beta, plain.beta, rtol=1e-6, atol=1e-9)
    path, data, out = (scratch_path(spark, x) for x in ("pipeline", "pipeline-data", "pipeline-out"))
    fitted.save(path)
    df.write.parquet(data)
    code = f"""
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
PipelineModel.load({path!r}).transform(spark.read.parquet({data!r})).select("house_id", "prediction").write.parquet({out!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    here = {r["house_id"]: r["prediction"] for r in fitted.transform(df).collect()}
    there = {r["house_id"]: r["prediction"] for r in spark.read.parquet(out).collect()}
    assert here == there and here[3] is None and here[4] is not None
    assert PipelineModel.load(path).stages[1].getOrDefault("degree") == 5


def test_cross_validator_and_params(spark):
    df = listings(spark).filter("house_id not in (3, 4)")
    stage = PriceRidge(degree=2, predictionCol="p", inputCols=M.INPUTS[:3])
    grid = ParamGridBuilder().addGrid(stage.alpha, [0.01, 1e5]).build()
    cv = CrossValidator(estimator=stage, estimatorParamMaps=grid, numFolds=2, seed=1,
                        evaluator=RegressionEvaluator(labelCol="price", predictionCol="p", metricName="rmse"))
    best = cv.fit(df)
    assert best.bestModel.ridge.alpha == 0.01 and best.avgMetrics[0] < best.avgMetrics[1]
    path = scratch_path(spark, "stage")
    stage.write().save(path)
    assert PriceRidge.load(path).getOrDefault("degree") == 2
    # without a fold column the folds come from the rows
    assert PriceRidge(degree=1).fit(df.drop("fold")).transform(df).filter(F.col("prediction").isNull()).count() == 0
