"""DuckDB oracle for the price-model checks that have a closed form.

Split and folds come from the md5 hex of house_id; ridge with one
standardised input has slope = regr_slope * n / (n + alpha) and intercept =
mean(y) - slope * mean(x), so fold errors and the grid choice are plain SQL.
"""

from __future__ import annotations

HEX = "'0123456789abcdef'"


def _byte(pos: int) -> str:
    return (f"(16 * (instr({HEX}, substr(md5(house_id), {pos}, 1)) - 1) "
            f"+ (instr({HEX}, substr(md5(house_id), {pos + 1}, 1)) - 1))")


INPUTS = ["area", "bedrooms", "bathrooms", "floors", "width_meters"]

CTES = f"""
tr_all AS (SELECT house_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in INPUTS)},
                  CAST(price_vnd AS DOUBLE) AS price, {_byte(1)} < 51 AS is_test,
                  CAST({_byte(3)} % 5 AS INTEGER) AS fold
           FROM listings WHERE price_vnd IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in INPUTS)}),
tr AS (SELECT fold, area AS x, price / 1e9 AS y FROM tr_all WHERE NOT is_test),
te AS (SELECT house_id, area AS x, price / 1e9 AS y FROM tr_all WHERE is_test),
alphas AS (SELECT CAST(a AS DOUBLE) AS alpha FROM (VALUES (0.001), (0.01), (0.1), (1.0), (10.0), (100.0)) t(a)),
fs AS (SELECT f.fold, regr_slope(t.y, t.x) AS s, count(*) AS n, avg(t.x) AS mx, avg(t.y) AS my
       FROM (SELECT DISTINCT fold FROM tr) f JOIN tr t ON t.fold <> f.fold GROUP BY f.fold),
co AS (SELECT fs.fold, a.alpha, fs.s * fs.n / (fs.n + a.alpha) AS b1,
              fs.my - fs.s * fs.n / (fs.n + a.alpha) * fs.mx AS b0 FROM fs CROSS JOIN alphas a),
fm AS (SELECT co.alpha, co.fold, avg((t.y - (co.b0 + co.b1 * t.x)) * (t.y - (co.b0 + co.b1 * t.x))) AS mse
       FROM co JOIN tr t ON t.fold = co.fold GROUP BY co.alpha, co.fold),
gs AS (SELECT alpha, avg(mse) AS mean_mse FROM fm GROUP BY alpha),
best AS (SELECT alpha FROM gs ORDER BY mean_mse, alpha LIMIT 1),
fit AS (SELECT regr_slope(y, x) * count(*) / (count(*) + (SELECT alpha FROM best)) AS b1,
               avg(y) - regr_slope(y, x) * count(*) / (count(*) + (SELECT alpha FROM best)) * avg(x) AS b0 FROM tr),
pr AS (SELECT te.house_id, te.y, fit.b0 + fit.b1 * te.x AS yhat FROM te CROSS JOIN fit)
"""


def model_oracle_queries(Q) -> dict[str, str]:
    o = {}
    o["ml_split"] = Q("SELECT house_id, is_test, fold FROM tr_all", CTES)
    o["ml_poly_features"] = Q(
        "SELECT house_id, area, area * area AS area2, bedrooms, area * bedrooms AS area__bedrooms, "
        "bedrooms * bedrooms AS bedrooms2 FROM tr_all", CTES)
    o["ml_scale"] = Q(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std "
        f"FROM tr_all WHERE NOT is_test" for c in INPUTS), CTES)
    o["ml_ridge_fit"] = Q(
        "SELECT CAST(1.0 AS DOUBLE) AS alpha, round(regr_slope(y, x) * count(*) / (count(*) + 1.0), 8) AS slope, "
        "round(avg(y) - regr_slope(y, x) * count(*) / (count(*) + 1.0) * avg(x), 8) AS intercept, "
        "count(*) AS n_train FROM tr", CTES)
    o["ml_grid_search"] = Q(
        "SELECT alpha, round(mean_mse, 6) AS mean_mse, alpha = (SELECT alpha FROM best) AS chosen FROM gs", CTES)
    o["ml_evaluate"] = Q(
        "SELECT count(*) AS n_test, round(avg((y - yhat) * (y - yhat)), 6) AS mse, "
        "round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, "
        "round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 6) AS r2, "
        "round(avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100, 6) AS mape_pct, "
        "CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_price_skipped FROM pr", CTES)
    yhat = "round((fit.b0 + fit.b1 * {x}) * 1e9, 2)"
    o["ml_batch_predict"] = Q(f"SELECT house_id, {yhat.format(x='area')} AS prediction FROM listings CROSS JOIN fit", CTES)
    c = "CAST(floor((p + 5000000) / 10000000) AS BIGINT)"
    o["ml_sample_predict"] = Q(
        f"SELECT area, bedrooms, bathrooms, floors, width_meters, p AS prediction, "
        f"concat(format('{{:,.2f}}', CAST({c} AS DOUBLE) / 100), ' tỷ VND') AS price_text FROM (SELECT s.*, {yhat.format(x='area')} AS p FROM "
        "(VALUES (240.0::DOUBLE, 3.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE), (150, 2, 1, 1, 8), (300, 4, 3, 2, 12), "
        "(120, 2, 1, 1, 5), (500, 5, 3, 3, 15)) s(area, bedrooms, bathrooms, floors, width_meters) CROSS JOIN fit)", CTES)
    o["ml_top10_importance"] = Q(
        "SELECT 'area' AS term, round(abs(fit.b1) * (SELECT stddev_pop(x) FROM tr), 6) AS importance FROM fit", CTES)
    o["model_save_load"] = Q("SELECT house_id, round(yhat * 1e9, 2) AS before, round(yhat * 1e9, 2) AS after, "
                             "true AS same FROM pr", CTES)
    return o
