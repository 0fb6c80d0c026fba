"""Contribution reports on given values: standardised columns stand in for attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.scores import direction
from flowlens.operators import clean, contributions, encode
from flowlens.operators.surrogate import Context
from flowlens.plans.frames import EV, EV_NUM, ev, union_columns
from flowlens.plans.registry import query, rounded
from flowlens.sources import spread

# fixed multipliers of the second explanation list
TWIST = {"value": 0.5, "user_id": 1.5, "k": 1.0, "log_value": 0.8, "hour": 1.2}

CON = f"""{EV}, st AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in EV_NUM)},
         avg(binary_label) AS base FROM ev WHERE origin = 'train'), con AS ({" UNION ALL ".join(
    f"SELECT row_id, binary_label, base, '{c}' AS feature, {c}::DOUBLE AS value, "
    f"({c} - m_{c}) / s_{c} AS contribution, {TWIST[c]}::DOUBLE * (({c} - m_{c}) / s_{c}) AS other FROM ev, st"
    for c in EV_NUM)}), rk AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS rank,
         row_number() OVER (PARTITION BY row_id ORDER BY abs(other) DESC, feature) AS rank2 FROM con)"""


def contribution_rows(spark, sf, weights=None):
    """(row_id, binary_label, base, items) with scaled values as contributions."""
    rows = ev(spark, sf)
    train = clean.part(rows, "train")
    scaler = encode.Standardizer.fit(train, EV_NUM)
    base = train.agg(F.avg("binary_label")).scalar()
    weights = weights or {c: 1.0 for c in EV_NUM}
    items = contributions.pack(
        {c: (F.col(c), F.col(f"z_{c}") * F.lit(weights[c])) for c in EV_NUM}
    )
    return scaler.transform(spread(rows)).select("row_id", "binary_label", base.alias("base"), items.alias("items"))


@query("topk_contribution", f"""WITH {CON}
SELECT row_id, CAST(rank AS INTEGER) AS rank, feature, round_even(contribution, 4) AS contribution,
       CASE WHEN contribution > 0 THEN 'attack' ELSE 'normal' END AS direction FROM rk WHERE rank <= 3""")
def topk_contribution(spark, sf):
    return contributions.topk(contribution_rows(spark, sf).drop("binary_label", "base"), 3)


@query("waterfall", f"""WITH {CON}, t AS (
  SELECT row_id, base, CASE WHEN rank < 4 THEN rank ELSE 4 END AS rank,
         CASE WHEN rank < 4 THEN feature ELSE 'other' END AS feature, contribution FROM rk), g AS (
  SELECT row_id, any_value(base) AS base, CAST(rank AS INTEGER) AS rank, feature,
         sum(contribution) AS contribution FROM t GROUP BY row_id, rank, feature), s AS (
  SELECT *, base + sum(contribution) OVER (PARTITION BY row_id) AS score,
         base + sum(contribution) OVER (PARTITION BY row_id ORDER BY rank DESC) AS end_at FROM g)
SELECT row_id, rank, feature, round_even(base, 6) AS base, round_even(score, 6) AS score,
       round_even(contribution, 6) AS contribution, round_even(end_at, 6) AS end_at,
       round_even(end_at - contribution, 6) AS start_at FROM s""")
def waterfall(spark, sf):
    out = contributions.waterfall(contribution_rows(spark, sf).drop("binary_label"), 4)
    return rounded(out, 6, "base", "score", "contribution", "end_at", "start_at")


@query("rank_pairing", f"""WITH {CON}
SELECT a.row_id, CAST(a.rank AS INTEGER) AS rank, a.feature AS left_feature, b.feature AS right_feature,
       a.feature = b.feature AS matches
FROM rk a JOIN rk b ON a.row_id = b.row_id AND a.rank = b.rank2 WHERE a.rank <= 4""")
def rank_pairing(spark, sf):
    left, right = contribution_rows(spark, sf), contribution_rows(spark, sf, TWIST)
    return contributions.pair_ranks(left, right, 4)


STATS = """stt AS (SELECT {key} feature, avg(abs({v})) AS mean_abs, max(abs({v})) AS max_abs,
  stddev_pop(abs({v})) AS std_abs FROM con {where} GROUP BY ALL)"""


@query("rank_table_pairing", f"""WITH {CON}, a AS (SELECT feature, avg(abs(contribution)) AS m FROM con GROUP BY 1),
b AS (SELECT feature, avg(abs(other)) AS m FROM con GROUP BY 1),
ra AS (SELECT CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank, feature FROM a),
rb AS (SELECT CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank, feature FROM b)
SELECT rank, ra.feature AS left_feature, rb.feature AS right_feature
FROM (SELECT * FROM ra WHERE rank <= 3) ra FULL JOIN (SELECT * FROM rb WHERE rank <= 4) rb USING (rank)""")
def rank_table_pairing(spark, sf):
    def ranks(weights, k):
        stats = contributions.feature_stats(contribution_rows(spark, sf, weights))
        return contributions.global_rank(stats, k).select("rank", "feature")

    return contributions.pair_rank_tables(ranks(None, 3), ranks(TWIST, 4))


@query("rank_numbering", f"""WITH {CON}, {STATS.format(key="", v="contribution", where="")}
SELECT CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank, feature,
       round_even(mean_abs, 4) AS mean_abs, round_even(max_abs, 4) AS max_abs,
       round_even(std_abs, 4) AS std_abs FROM stt""")
def rank_numbering(spark, sf):
    return contributions.global_rank(contributions.feature_stats(contribution_rows(spark, sf)), 20)


@query("contribution_stats", f"""WITH {CON}, {STATS.format(key="binary_label,", v="contribution", where="")}
SELECT binary_label, feature, round_even(mean_abs, 6) AS mean_abs, round_even(max_abs, 6) AS max_abs,
       round_even(std_abs, 6) AS std_abs FROM stt""")
def contribution_stats(spark, sf):
    stats = contributions.feature_stats(contribution_rows(spark, sf), by=("binary_label",))
    return rounded(stats, 6, "mean_abs", "max_abs", "std_abs")


TOP3 = "SELECT feature FROM (SELECT feature, avg(abs({v})) AS m FROM con GROUP BY 1 ORDER BY m DESC, feature LIMIT 3)"


@query("feature_agreement", f"""WITH {CON}
{TOP3.format(v="contribution")} INTERSECT {TOP3.format(v="other")}""")
def feature_agreement(spark, sf):
    left = contributions.feature_stats(contribution_rows(spark, sf))
    right = contributions.feature_stats(contribution_rows(spark, sf, TWIST))
    return contributions.agreement(left, right, 3)


@query("direction_flags", f"""WITH {CON}
SELECT row_id, feature, CASE WHEN contribution > 0 THEN 'attack' ELSE 'normal' END AS direction FROM con""")
def direction_flags(spark, sf):
    long = contributions.to_long(contribution_rows(spark, sf).select("row_id", "items"))
    return long.select("row_id", "feature", direction(F.col("contribution")).alias("direction"))


@query("rule_token", f"""WITH {CON}, c AS (
  SELECT row_id, feature, CASE WHEN contribution > 1 THEN feature || ' > 1.00'
    WHEN contribution > -1 THEN '-1.00 < ' || feature || ' <= 1.00' ELSE feature || ' <= -1.00' END AS condition
  FROM con)
SELECT row_id, feature, split_part(condition, ' ', 1) AS token,
       contains(feature, split_part(condition, ' ', 1)) OR contains(split_part(condition, ' ', 1), feature)
         AS matches FROM c""")
def rule_token(spark, sf):
    long = contributions.to_long(contribution_rows(spark, sf).select("row_id", "items"))
    z, f = F.col("contribution"), F.col("feature")
    condition = (
        F.when(z > 1, F.concat(f, F.lit(" > 1.00")))
        .when(z > -1, F.concat(F.lit("-1.00 < "), f, F.lit(" <= 1.00")))
        .otherwise(F.concat(f, F.lit(" <= -1.00")))
    )
    rules = long.select("row_id", "feature", condition.alias("condition"))
    return contributions.text_match(rules, "feature", "condition").drop("condition")


@query("summary_points", f"""WITH {CON}
SELECT row_id, feature, round_even(value, 6) AS value, round_even(contribution, 6) AS contribution
FROM con WHERE feature IN ({TOP3.format(v="contribution")})""")
def summary_points(spark, sf):
    points = contributions.summary_points(contribution_rows(spark, sf).select("row_id", "items"), 3)
    return rounded(points, 6, "value", "contribution")


BINS = f"""{EV}, q AS ({union_columns("(SELECT * FROM ev WHERE origin = 'train')", EV_NUM, '''
  '{c}' AS feature, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,
  quantile_cont({c}::DOUBLE, 0.75) AS q3''')})"""


@query("surrogate_quartiles", f"""WITH {BINS}
SELECT feature, round_even(q1, 6) AS q1, round_even(q2, 6) AS q2, round_even(q3, 6) AS q3 FROM q""")
def surrogate_quartiles(spark, sf):
    context = Context.fit(clean.part(ev(spark, sf), "train"), EV_NUM)
    return rounded(context.quartile_table(spark), 6, "q1", "q2", "q3")


@query("surrogate_bins", f"""WITH {BINS}, v AS ({union_columns("(SELECT * FROM ev WHERE origin = 'train')", EV_NUM, '''
  '{c}' AS feature, {c}::DOUBLE AS v''')}), b AS (
  SELECT v.feature, v, CASE WHEN v <= q1 THEN 0 WHEN v <= q2 THEN 1 WHEN v <= q3 THEN 2 ELSE 3 END AS bin
  FROM v JOIN q ON v.feature = q.feature)
SELECT feature, bin, count(*) AS n, round_even(avg(v), 6) AS mean, round_even(stddev_pop(v), 6) AS std,
       round_even(min(v), 6) AS low, round_even(max(v), 6) AS high FROM b GROUP BY 1, 2""")
def surrogate_bins(spark, sf):
    context = Context.fit(clean.part(ev(spark, sf), "train"), EV_NUM)
    return rounded(context.bin_table(spark), 6, "mean", "std", "low", "high")
