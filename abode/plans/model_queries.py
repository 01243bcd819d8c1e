"""Price-model queries (registered on import).

One-input variants (area -> price) have an exact SQL oracle (closed-form
ridge with one standardised feature); the five-input degree-5 model is checked
by rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.functions import price as P
from abode.operators import model as M
from abode.plans.queries import REGISTRY, T, query
from abode.session import scratch_path
from abode.sources.files import TRAIN_FEATURES

ONE_INPUT = ["area"]
RIDGE_ALPHA = 1.0
# The sample requests.
SAMPLE_ROWS = [  # (area, bedrooms, bathrooms, floors, width) - the fixed sample requests
    (240.0, 3, 2, 1, 10.0), (150.0, 2, 1, 1, 8.0), (300.0, 4, 3, 2, 12.0),
    (120.0, 2, 1, 1, 5.0), (500.0, 5, 3, 3, 15.0),
]


def training(t) -> DataFrame:
    """Listings with a numeric price and all five inputs, tagged with split/fold."""
    return _numeric(t.listings)


def _numeric(l: DataFrame) -> DataFrame:
    cond = F.col("price_vnd").isNotNull()
    for c in TRAIN_FEATURES:
        cond = cond & F.col(c).isNotNull()
    df = l.filter(cond).select("house_id", *[F.col(c).cast("double") for c in TRAIN_FEATURES],
                               F.col("price_vnd").cast("double").alias("price"))
    return M.with_split(df)


def _train_test(spark, sf_dir):
    """Training and test rows, read from a written table: a fit goes over them more than once, and cleaning costs most.

    The numbers are written before the filters, which would be pushed below the cleaning and clean each value again.
    """
    numbers = T(spark, sf_dir).listings.select("house_id", *TRAIN_FEATURES, "price_vnd")
    path = scratch_path(spark, "training")
    numbers.write.parquet(path)
    d = _numeric(spark.read.schema(numbers.schema).parquet(path))
    return d.filter(~F.col("is_test")), d.filter(F.col("is_test"))


def _fitted(spark, sf_dir, inputs: tuple, degree: int, alpha):
    """The model, and the training and test rows."""
    tr, te = _train_test(spark, sf_dir)
    return M.fit(tr, list(inputs), degree, alpha=alpha), tr, te


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@query("ml_split")
def q_ml_split(spark, sf_dir):
    return training(T(spark, sf_dir)).select("house_id", "is_test", F.col("fold").cast("int"))


@query("ml_poly_features")
def q_ml_poly_features(spark, sf_dir):
    inputs = ["area", "bedrooms"]
    exps = M.term_order(2, 2)
    names = ["__".join(f"{n}{k if k > 1 else ''}" for n, k in zip(inputs, e) if k) for e in exps]
    p = M.poly_column(training(T(spark, sf_dir)), inputs, 2, "poly")
    arr = M.vector_to_array(F.col("poly"))
    return p.select("house_id", *[arr[i].alias(n) for i, n in enumerate(names)])


@query("ml_scale")
def q_ml_scale(spark, sf_dir):
    tr, _ = _train_test(spark, sf_dir)
    stats = tr.agg(*[F.avg(c).alias(f"m_{c}") for c in TRAIN_FEATURES],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in TRAIN_FEATURES])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                              F.col(f"s_{c}").alias("std")) for c in TRAIN_FEATURES])
    return stats.select(F.inline(rows)).select("feature", _r("mean"), _r("std"))


@query("ml_ridge_fit")
def q_ml_ridge_fit(spark, sf_dir):
    m, tr, _ = _fitted(spark, sf_dir, tuple(ONE_INPUT), 1, RIDGE_ALPHA)
    slope = m.coefficients()[0]
    intercept = m.beta0 - m.beta[0] * m.center[0] / m.scale[0]
    # One row per fit, derived from the training data it was fitted on.
    return tr.agg(F.count(F.lit(1)).alias("n_train")).select(
        F.lit(m.alpha).alias("alpha"), F.round(F.lit(slope), 8).alias("slope"),
        F.round(F.lit(intercept), 8).alias("intercept"), "n_train")


def _cv_frame(spark, model) -> DataFrame:
    rows = [(float(r["alpha"]), float(r["mean_mse"]), bool(r["chosen"])) for r in model.cv]
    return spark.createDataFrame(rows, "alpha double, mean_mse double, chosen boolean") \
        .select("alpha", _r("mean_mse"), "chosen")


@query("ml_grid_search")
def q_ml_grid_search(spark, sf_dir):
    return _cv_frame(spark, _fitted(spark, sf_dir, tuple(ONE_INPUT), 1, None)[0])


@query("ml_evaluate")
def q_ml_evaluate(spark, sf_dir):
    m, _, te = _fitted(spark, sf_dir, tuple(ONE_INPUT), 1, None)
    ev = M.evaluate(m.transform(te))
    return ev.select("n_test", _r("mse"), _r("rmse"), _r("r2"), _r("mape_pct"), "n_zero_price_skipped")


@query("ml_grid_search_poly5")
def q_ml_grid_search_poly5(spark, sf_dir):
    return _cv_frame(spark, _fitted(spark, sf_dir, tuple(M.INPUTS), 5, None)[0])


@query("ml_ridge_fit_poly5")
def q_ml_ridge_fit_poly5(spark, sf_dir):
    m, _, _ = _fitted(spark, sf_dir, tuple(M.INPUTS), 5, None)
    names = M.term_names(m.inputs, [tuple(e) for e in m.exponents])
    rows = [(n, float(c)) for n, c in zip(names, m.coefficients())]
    return spark.createDataFrame(rows, "term string, coefficient double")


@query("ml_evaluate_poly5")
def q_ml_evaluate_poly5(spark, sf_dir):
    m, _, te = _fitted(spark, sf_dir, tuple(M.INPUTS), 5, None)
    return M.evaluate(m.transform(te))


def _batch_predict(spark, sf_dir, inputs, degree):
    """Predictions for all listings; those without an input keep their row with a null prediction."""
    m, _, _ = _fitted(spark, sf_dir, tuple(inputs), degree, None)
    l = T(spark, sf_dir).listings.select("house_id", *[F.col(c).cast("double").alias(c) for c in TRAIN_FEATURES])
    return m.transform(l).select("house_id", F.round("prediction", 2).alias("prediction"))


@query("ml_batch_predict")
def q_ml_batch_predict(spark, sf_dir):
    return _batch_predict(spark, sf_dir, ONE_INPUT, 1)


@query("ml_batch_predict_poly5")
def q_ml_batch_predict_poly5(spark, sf_dir):
    return _batch_predict(spark, sf_dir, M.INPUTS, 5)


def _sample_predict(spark, sf_dir, inputs, degree):
    m, _, _ = _fitted(spark, sf_dir, tuple(inputs), degree, None)
    s = spark.createDataFrame([tuple(float(v) for v in r) for r in SAMPLE_ROWS],
                              "area double, bedrooms double, bathrooms double, floors double, width_meters double")
    out = m.transform(s).withColumn("prediction", F.round("prediction", 2))
    return out.withColumn("price_text", P.fmt_price_long(F.col("prediction").cast("decimal(24,2)")))


@query("ml_sample_predict")
def q_ml_sample_predict(spark, sf_dir):
    return _sample_predict(spark, sf_dir, ONE_INPUT, 1)


@query("ml_sample_predict_poly5")
def q_ml_sample_predict_poly5(spark, sf_dir):
    return _sample_predict(spark, sf_dir, M.INPUTS, 5)


def _importance(spark, sf_dir, inputs, degree):
    m, _, _ = _fitted(spark, sf_dir, tuple(inputs), degree, None)
    names = M.term_names(m.inputs, [tuple(e) for e in m.exponents])
    rows = [(n, abs(c * s)) for n, c, s in zip(names, m.coefficients(), m.term_sigma)]
    df = spark.createDataFrame(rows, "term string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("term")).limit(10)


@query("ml_top10_importance")
def q_ml_top10_importance(spark, sf_dir):
    return _importance(spark, sf_dir, ONE_INPUT, 1).select("term", _r("importance"))


@query("ml_top10_importance_poly5")
def q_ml_top10_importance_poly5(spark, sf_dir):
    return _importance(spark, sf_dir, M.INPUTS, 5)


def _save_load(spark, sf_dir, inputs, degree):
    m, _, te = _fitted(spark, sf_dir, tuple(inputs), degree, None)
    path = scratch_path(spark, "price_model")
    m.save(spark, path)
    loaded = M.RidgeModel.load(spark, path)
    both = loaded.transform(m.transform(te, "before"), "after")
    return both.select("house_id", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"),
                       (F.col("before") == F.col("after")).alias("same"))


@query("model_save_load")
def q_model_save_load(spark, sf_dir):
    return _save_load(spark, sf_dir, ONE_INPUT, 1)


@query("model_save_load_poly5")
def q_model_save_load_poly5(spark, sf_dir):
    return _save_load(spark, sf_dir, M.INPUTS, 5)


assert "ml_split" in REGISTRY
