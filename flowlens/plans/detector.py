"""The mean-reconstruction detector end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.scores import squared_error
from flowlens.operators import anomaly, clean, encode, evaluate, profile
from flowlens.plans.eda import hist_sql
from flowlens.plans.frames import EV, EV_NUM, ev
from flowlens.plans.registry import query, rounded

ERR = f"""{EV}, st AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in EV_NUM)}
  FROM ev WHERE origin = 'train'), er AS (
  SELECT row_id, origin, binary_label,
         ({" + ".join(f"(({c} - m_{c}) / s_{c}) * (({c} - m_{c}) / s_{c})" for c in EV_NUM)})
         / {len(EV_NUM)} AS error FROM ev, st), th AS (
  SELECT quantile_cont(error, 0.95) AS cut FROM er WHERE origin = 'train' AND binary_label = 0)"""


def fitted(spark, sf):
    rows = ev(spark, sf)
    normal = F.col("binary_label") == 0
    return anomaly.MeanDetector.fit(clean.part(rows, "train"), EV_NUM, normal), rows


@query("anomaly_threshold", f"WITH {ERR} SELECT round_even(cut, 6) AS threshold FROM th")
def anomaly_threshold(spark, sf):
    detector, _ = fitted(spark, sf)
    fit = spark.createDataFrame([(detector.cut,)], "threshold double")
    return rounded(fit, 6, "threshold")


@query("anomaly_flags", f"""WITH {ERR}
SELECT row_id, origin, round_even(error, 6) AS error, CASE WHEN error > cut THEN 1 ELSE 0 END AS flag
FROM er, th""")
def anomaly_flags(spark, sf):
    detector, rows = fitted(spark, sf)
    return rounded(detector.transform(rows).select("row_id", "origin", "error", "flag"), 6, "error")


@query("anomaly_metrics", f"""WITH {ERR}, c AS (
  SELECT origin, count(*) FILTER (binary_label = 0 AND error <= cut) AS tn,
         count(*) FILTER (binary_label = 0 AND error > cut) AS fp,
         count(*) FILTER (binary_label = 1 AND error <= cut) AS fn,
         count(*) FILTER (binary_label = 1 AND error > cut) AS tp FROM er, th GROUP BY 1)
SELECT origin, round_even(100 * (tp + tn)::DOUBLE / (tp + tn + fp + fn), 2) AS accuracy,
       round_even(100 * coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 2) AS precision,
       round_even(100 * coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 2) AS recall,
       round_even(100 * coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 2) AS f1 FROM c""")
def anomaly_metrics(spark, sf):
    detector, rows = fitted(spark, sf)
    return evaluate.binary_metrics(detector.transform(rows), "binary_label", "flag", ["origin"])


@query("density_histogram_80", f"""WITH {ERR}, e AS (
  SELECT binary_label, error FROM er WHERE origin = 'test'), {hist_sql('e', ['error'], 80, 'binary_label')}""")
def density_histogram_80(spark, sf):
    detector, rows = fitted(spark, sf)
    errors = detector.transform(clean.part(rows, "test"))
    out = profile.histogram(errors, ["error"], 80, "binary_label", [0, 1])
    return rounded(rounded(out, 8, "left_edge"), 6, "density")


@query("row_error", f"""WITH {EV}, st AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}" for c in EV_NUM)} FROM ev WHERE origin = 'train')
SELECT row_id, round_even(({" + ".join(f"({c} - m_{c}) * ({c} - m_{c})" for c in EV_NUM)}) / {len(EV_NUM)}, 4)
       AS error FROM ev, st""")
def row_error(spark, sf):
    """Squared error of raw columns against their train means, on array columns."""
    rows = ev(spark, sf)
    means = encode.Standardizer.fit(clean.part(rows, "train"), EV_NUM).stats
    x = F.array(*[F.col(c).cast("double") for c in EV_NUM])
    r = F.array(*[F.lit(means[c][0]) for c in EV_NUM])
    return rows.select("row_id", F.bround(squared_error(x, r), 4).alias("error"))
