"""Profiles of numeric columns and relations between columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from flowlens.operators import clean, profile, relate
from flowlens.plans.frames import EV, EV_CLASSES, EV_NUM, LI, LI_NUM, ev, li, table, union_columns
from flowlens.plans.registry import query, rounded

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("numeric_summary", f"""WITH {LI}, c AS ({union_columns("li", LI_NUM, '''
  '{c}' AS "column", count({c}) AS n, round_even(avg({c}), 4) AS mean,
  round_even(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
  round_even(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round_even(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50,
  round_even(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round_even(max({c})::DOUBLE, 4) AS max''')})
SELECT "column", n, mean, std, round_even(min, 4) AS min, q25, q50, q75, max FROM c""")
def numeric_summary(spark, sf):
    out = profile.numeric_summary(li(spark, sf), LI_NUM)
    return rounded(out, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


@query("skew_rank", f"""WITH {LI}, c AS ({union_columns("li", LI_NUM, '''
  '{c}' AS "column", coalesce(round_even(skewness({c}), 6), 0) AS skewness''')})
SELECT * FROM c ORDER BY skewness DESC, "column" LIMIT 10""")
def skew_rank(spark, sf):
    return rounded(profile.skew_rank(li(spark, sf), LI_NUM), 6, "skewness")


@query("zero_share", f"""WITH {LI}, c AS ({union_columns("li", LI_NUM, '''
  '{c}' AS "column", round_even(count(*) FILTER ({c} = 0) * 100.0::DOUBLE / count(*), 6) AS zero_pct''')})
SELECT * FROM c""")
def zero_share(spark, sf):
    return rounded(profile.zero_share(li(spark, sf), LI_NUM), 6, "zero_pct")


@query("zero_heavy", f"""WITH {LI}, c AS ({union_columns("li", LI_NUM, '''
  '{c}' AS "column", count(*) FILTER ({c} = 0) * 100.0::DOUBLE / count(*) AS zero_pct''')})
SELECT "column", round_even(zero_pct, 6) AS zero_pct FROM c WHERE zero_pct > 90""")
def zero_heavy(spark, sf):
    return rounded(profile.zero_share(li(spark, sf), LI_NUM, 90), 6, "zero_pct")


def _corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END"


PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS r FROM li"
    for a, b in combinations(LI_NUM, 2)
)


@query("corr_matrix", f"""WITH {LI}, p AS ({PAIRS})
SELECT b AS "row", a AS "column", round_even(r, 6) AS r FROM p""")
def corr_matrix(spark, sf):
    return rounded(relate.correlation_matrix(li(spark, sf), LI_NUM), 6, "r")


@query("corr_pairs_high", f"""WITH {LI}, p AS ({PAIRS})
SELECT a, b, round_even(r, 3) AS r FROM p WHERE abs(r) > 0.90 ORDER BY r DESC, a, b""")
def corr_pairs_high(spark, sf):
    return relate.high_pairs(li(spark, sf), LI_NUM)


@query("corr_label_rank", f"""WITH {LI}, c AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", abs({_corr_sql(c, 'y')}) AS abs_r FROM li" for c in LI_NUM)})
SELECT "column", round_even(abs_r, 6) AS abs_r FROM c ORDER BY abs_r DESC NULLS LAST, "column" LIMIT 20""")
def corr_label_rank(spark, sf):
    return rounded(relate.label_correlation(li(spark, sf), LI_NUM, "y", 20), 6, "abs_r")


@query("crosstab_topn", f"""WITH t AS (
  SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10)
SELECT p_brand, {", ".join(f'''count(*) FILTER (p_type = '{t}') AS "{t}"''' for t in PART_TYPES)}
, count(*) FILTER (p_type NOT IN ({", ".join(f"'{t}'" for t in PART_TYPES)})) AS "(other)"
FROM part WHERE p_brand IN (SELECT p_brand FROM t) GROUP BY 1""")
def crosstab_topn(spark, sf):
    parts = relate.keep_top_values(table(spark, sf, "part"), "p_brand", 10)
    return relate.crosstab(parts, "p_brand", "p_type", PART_TYPES)


@query("crosstab_unlisted", f"""WITH {EV}
SELECT origin, count(*) FILTER (label = 'view') AS "view", count(*) FILTER (label = 'click') AS "click",
       count(*) FILTER (label NOT IN ('view', 'click')) AS "(other)" FROM ev GROUP BY 1""")
def crosstab_unlisted(spark, sf):
    return relate.crosstab(ev(spark, sf), "origin", "label", ["view", "click"])


WIDE_SQL = [
    *[f"{a} * {b} AS p_{a}_{b}" for a, b in combinations(LI_NUM[:5], 2)],
    *LI_NUM, "l_tax * 1e-13 AS tiny", "CASE WHEN l_quantity > 40 THEN NULL ELSE l_extendedprice END AS holes",
    "CASE WHEN l_discount > 0.05 THEN NULL ELSE l_quantity END AS gaps",
]
WIDE = [c.rsplit(" ", 1)[-1] for c in WIDE_SQL]
WIDE_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + (
        "max(NULL::DOUBLE)" if "k0" in (a, b) else f"corr({a}::DOUBLE, {b}::DOUBLE)"
    ) + " AS r FROM w" for a, b in combinations(WIDE, 2)
)


@query("corr_wide", f"""WITH {LI}, w AS (SELECT {", ".join(WIDE_SQL)} FROM li), p AS ({WIDE_PAIRS})
SELECT b AS row, a AS "column", round_even(r, 6) AS r FROM p""")
def corr_wide(spark, sf):
    """Twenty columns: products, a constant, one of tiny spread and two with missing cells."""
    wide = li(spark, sf).selectExpr(*WIDE_SQL)
    return rounded(relate.correlation_matrix(wide, WIDE), 6, "r")


@query("top_value_rows", """WITH t AS (
  SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10)
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM t)""")
def top_value_rows(spark, sf):
    return relate.keep_top_values(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 10)


@query("crosstab_category", f"""WITH {LI}
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F",
       count(*) FILTER (l_linestatus = 'O') AS "O", CAST(0 AS BIGINT) AS "(other)" FROM li GROUP BY 1""")
def crosstab_category(spark, sf):
    return relate.crosstab(li(spark, sf), "l_returnflag", "l_linestatus")


def _outlier_sql(view: str, cols: list[str]) -> str:
    fences = union_columns(view, cols, """'{c}' AS "column",
      quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3""")
    vals = union_columns(view, cols, """'{c}' AS "column", {c}::DOUBLE AS v""")
    return f"""f AS (SELECT "column", q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM ({fences})), v AS ({vals})
SELECT v."column", round_even(any_value(lower), 8) AS lower, round_even(any_value(upper), 8) AS upper,
       count(*) FILTER (v < lower OR v > upper) AS outliers
FROM v JOIN f ON v."column" = f."column" GROUP BY 1"""


@query("iqr_outliers", f"WITH {EV}, {_outlier_sql('ev', EV_NUM)}")
def iqr_outliers(spark, sf):
    return rounded(profile.iqr_outliers(ev(spark, sf), EV_NUM), 8, "lower", "upper")


@query("iqr_outliers_items", f"WITH {LI}, {_outlier_sql('li', LI_NUM)}")
def iqr_outliers_items(spark, sf):
    return rounded(profile.iqr_outliers(li(spark, sf), LI_NUM), 8, "lower", "upper")


BOX = ["value", "user_id", "k"]


@query("box_stats_log1p", f"""WITH {EV}, v AS ({union_columns("ev", BOX, '''
  attack_category, '{c}' AS "column", ln(1 + {c}) AS v''')}), q AS (
  SELECT attack_category, "column", count(v) AS n, quantile_cont(v, 0.25) AS q1,
         quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1, 2)
SELECT q.attack_category, q."column", any_value(n) AS n, round_even(any_value(q1), 6) AS q1,
       round_even(any_value(median), 6) AS median, round_even(any_value(q3), 6) AS q3,
       round_even(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
       round_even(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
FROM v JOIN q ON v.attack_category = q.attack_category AND v."column" = q."column" GROUP BY 1, 2""")
def box_stats_log1p(spark, sf):
    out = profile.box_stats(ev(spark, sf), "attack_category", EV_CLASSES, BOX)
    return rounded(out, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("log1p_projection", f"""WITH {EV}
SELECT row_id, attack_category, round_even(ln(1 + value), 6) AS value FROM ev""")
def log1p_projection(spark, sf):
    return ev(spark, sf).select("row_id", "attack_category", F.bround(F.log1p("value"), 6).alias("value"))


def hist_sql(view: str, cols: list[str], bins: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    on = f"AND v.{by} = m.{by}" if by else ""
    group = "GROUP BY 1, 2" if by else "GROUP BY 1"
    vals = union_columns(view, cols, key + """'{c}' AS "column", {c}::DOUBLE AS v""")
    return f"""v AS ({vals}), m AS (
  SELECT {key}"column", CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS low,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS high,
         count(*) AS total FROM v {group}), h AS (
  SELECT {"v." + by + ", " if by else ""}v."column", low, high, total,
         CAST(least(floor((v - low) / (high - low) * {bins}), {bins - 1}) AS INTEGER) AS bin
  FROM v JOIN m ON v."column" = m."column" {on})
SELECT {key}"column", bin, count(*) AS n,
       round_even(any_value(low + bin * ((high - low) / {bins})), 8) AS left_edge,
       round_even(count(*) / (any_value(total) * any_value((high - low) / {bins})), 6) AS density
FROM h GROUP BY {key}"column", bin"""


@query("histogram_40", f"WITH {EV}, {hist_sql('ev', EV_NUM, 40)}")
def histogram_40(spark, sf):
    return rounded(rounded(profile.histogram(ev(spark, sf), EV_NUM, 40), 8, "left_edge"), 6, "density")


@query("histogram_40_items", f"WITH {LI}, {hist_sql('li', LI_NUM, 40)}")
def histogram_40_items(spark, sf):
    return rounded(rounded(profile.histogram(li(spark, sf), LI_NUM, 40), 8, "left_edge"), 6, "density")


@query("numeric_columns", f"WITH {EV} SELECT row_id, value, user_id, k, round_even(log_value, 9) AS log_value, hour FROM ev")
def numeric_columns(spark, sf):
    flows = ev(spark, sf)
    return rounded(flows.select(*clean.numeric_columns(flows)), 9, "log_value")
