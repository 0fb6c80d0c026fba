"""Class balance, projections, filters and cleaning reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.labels import category_table
from flowlens.functions.sampling import lattice_order, sample_rows
from flowlens.operators import clean, encode, profile
from flowlens.plans.frames import EV, EV_GROUPS, EV_NUM, LI, LI_KEY, ORD, ev, li, orders
from flowlens.plans.registry import query

CAT_COLS = ["o_orderstatus", "o_orderpriority"]
NULLED = ["l_discount", "l_tax", "l_quantity", "l_returnflag"]


@query("label_distribution", f"""WITH {EV}
SELECT attack_category, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, 1""")
def label_distribution(spark, sf):
    return profile.frequencies(ev(spark, sf), "attack_category")


@query("label_lookup", f"""WITH {EV}
SELECT label, attack_category, count(*) AS n FROM ev GROUP BY 1, 2""")
def label_lookup(spark, sf):
    table = category_table(spark, EV_GROUPS)
    found = clean.add_category_by_lookup(ev(spark, sf).drop("attack_category"), table)
    return found.groupBy("label", "attack_category").agg(F.count("*").alias("n"))


@query("class_share", f"""WITH {EV}, c AS (
  SELECT attack_category, count(*) AS n FROM ev GROUP BY 1)
SELECT attack_category, n, round_even(n * 100.0 / sum(n) OVER (), 1)::DOUBLE AS share_pct FROM c""")
def class_share(spark, sf):
    return profile.class_share(ev(spark, sf), "attack_category")


@query("imbalance_ratio", f"""WITH {EV}
SELECT round_even(sum(binary_label)::DOUBLE / nullif(sum(1 - binary_label), 0), 6) AS ratio FROM ev""")
def imbalance_ratio(spark, sf):
    return profile.imbalance(ev(spark, sf)).select(F.bround("ratio", 6).alias("ratio"))


@query("binary_label_count", f"""WITH {EV}
SELECT count(*) FILTER (binary_label = 0) AS n_normal,
       count(*) FILTER (binary_label = 1) AS n_attack FROM ev""")
def binary_label_count(spark, sf):
    return profile.binary_counts(ev(spark, sf))


@query("unknown_excluded", f"""WITH {EV}
SELECT origin, count(*) FILTER (attack_category <> 'Unknown') AS kept,
       count(*) FILTER (attack_category = 'Unknown') AS excluded FROM ev GROUP BY 1""")
def unknown_excluded(spark, sf):
    return clean.unknown_report(ev(spark, sf))


@query("known_rows", f"""WITH {EV}
SELECT row_id, attack_category FROM ev WHERE attack_category <> 'Unknown'""")
def known_rows(spark, sf):
    return clean.known_only(ev(spark, sf)).select("row_id", "attack_category")


@query("drop_meta", f"""WITH {EV}
SELECT row_id, label, value, user_id, k, attack_category, binary_label, origin FROM ev""")
def drop_meta(spark, sf):
    return clean.drop_meta(ev(spark, sf), "log_value", "hour")


@query("feature_projection", f"""WITH {EV} SELECT row_id, value, user_id, k, hour, origin FROM ev""")
def feature_projection(spark, sf):
    flows = ev(spark, sf).drop("log_value")
    return flows.select(*clean.feature_columns(flows))


def _encoded_orders(spark, sf):
    stacked = orders(spark, sf)
    return encode.OneHot.fit(stacked, CAT_COLS), stacked


@query("prefix_projection", f"WITH {ORD} SELECT row_id, o_totalprice FROM ord")
def prefix_projection(spark, sf):
    hot, stacked = _encoded_orders(spark, sf)
    wide = hot.transform(stacked)
    return wide.select(*clean.numeric_columns(wide, ["origin"], CAT_COLS))


@query("preview", f"WITH {EV} SELECT row_id, label, value, user_id, k FROM ev ORDER BY row_id LIMIT 5")
def preview(spark, sf):
    return clean.preview(ev(spark, sf).select("row_id", "label", "value", "user_id", "k"), 5)


@query("schema_census", f"""WITH {EV}
SELECT origin, count(*) AS n_rows, CAST(9 AS BIGINT) AS n_cols FROM ev GROUP BY 1""")
def schema_census(spark, sf):
    return clean.shape(ev(spark, sf))


@query("normal_only", f"""WITH {EV}
SELECT row_id, value, user_id, k FROM ev WHERE binary_label = 0""")
def normal_only(spark, sf):
    return clean.normal_only(ev(spark, sf)).select("row_id", "value", "user_id", "k")


@query("dedup_count", f"""WITH {LI}, g AS (
  SELECT origin, count(*) AS c FROM li GROUP BY origin, {", ".join(LI_KEY)})
SELECT origin, sum(c)::BIGINT AS before,
       (CASE WHEN origin = 'train' THEN count(*) ELSE sum(c) END)::BIGINT AS after,
       (CASE WHEN origin = 'train' THEN sum(c) - count(*) ELSE 0 END)::BIGINT AS removed
FROM g GROUP BY origin""")
def dedup_count(spark, sf):
    return clean.dedup_report(li(spark, sf), LI_KEY)


@query("dedup_rows", f"""WITH {EV}
SELECT min(row_id) AS row_id, label, user_id, hour, origin FROM ev WHERE origin = 'train'
GROUP BY label, user_id, hour, origin
UNION ALL SELECT row_id, label, user_id, hour, origin FROM ev WHERE origin = 'test'""")
def dedup_rows(spark, sf):
    return clean.dedup_train(ev(spark, sf).select("row_id", "label", "user_id", "hour", "origin"))


@query("duplicate_count", f"""WITH {LI}, g AS (
  SELECT origin, count(*) - 1 AS extra FROM li GROUP BY origin, {", ".join(LI_KEY)})
SELECT origin, sum(extra)::BIGINT AS duplicates FROM g GROUP BY 1""")
def duplicate_count(spark, sf):
    return clean.duplicate_count(li(spark, sf), LI_KEY)


@query("null_census", f"""WITH {LI}
SELECT origin, sum((l_discount = 0)::INT + (l_tax = 0)::INT + (l_quantity = 25)::INT
                   + (l_returnflag = 'N')::INT)::BIGINT AS null_cells FROM li GROUP BY 1""")
def null_census(spark, sf):
    """Missing cells after zero rates, quantity 25 and flag N are declared missing."""
    holes = {"l_discount": 0.0, "l_tax": 0.0, "l_quantity": 25.0, "l_returnflag": "N"}
    frame = li(spark, sf).withColumns({c: F.nullif(c, F.lit(v)) for c, v in holes.items()})
    return profile.null_cells(frame, NULLED)


@query("distinct_census", f"""WITH {LI}, c AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM li"
    for c in [*LI_KEY, "l_extendedprice"])}) SELECT * FROM c""")
def distinct_census(spark, sf):
    return profile.distinct_counts(li(spark, sf), [*LI_KEY, "l_extendedprice"])


@query("row_counts", f"WITH {LI} SELECT origin, count(*) AS n FROM li GROUP BY 1")
def row_counts(spark, sf):
    return profile.row_counts(li(spark, sf))


def _dummies_sql(column: str, values: list[str]) -> str:
    return ", ".join(
        f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{column}_{v}\"" for v in values
    )


STATUS = ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DUMMIES = f"{_dummies_sql('o_orderstatus', STATUS)}, {_dummies_sql('o_orderpriority', PRIORITY)}"


@query("onehot_union", f"WITH {ORD} SELECT row_id, o_totalprice, origin, {DUMMIES} FROM ord")
def onehot_union(spark, sf):
    hot, stacked = _encoded_orders(spark, sf)
    return hot.transform(stacked)


@query("dummy_reconstruct", f"WITH {ORD} SELECT row_id, o_orderpriority FROM ord")
def dummy_reconstruct(spark, sf):
    hot, stacked = _encoded_orders(spark, sf)
    return hot.reconstruct(hot.transform(stacked), "o_orderpriority").select("row_id", "o_orderpriority")


@query("label_encode", f"""WITH {ORD}
SELECT row_id, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM ord""")
def label_encode(spark, sf):
    return encode.label_encode(orders(spark, sf), CAT_COLS).select("row_id", *CAT_COLS)


@query("target_encode", f"""WITH {ORD}, c AS (
  SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS y
  FROM (SELECT DISTINCT o_orderstatus FROM ord WHERE origin = 'train'))
SELECT row_id, origin, CAST(y AS DOUBLE) AS y FROM ord JOIN c USING (o_orderstatus)""")
def target_encode(spark, sf):
    stacked = orders(spark, sf)
    model = encode.fit_target(clean.part(stacked, "train"), "o_orderstatus")
    return model.transform(stacked).select("row_id", "origin", "y")


@query("split_back", f"""WITH {ORD}
SELECT row_id, 'back_' || origin AS part, {DUMMIES} FROM ord""")
def split_back(spark, sf):
    both = orders(spark, sf)
    stacked = clean.stack_splits(
        clean.part(both, "train").drop("origin"), clean.part(both, "test").drop("origin")
    )
    wide = encode.OneHot.fit(stacked, CAT_COLS).transform(stacked).drop("o_totalprice")
    parts = [
        clean.part(wide, p).withColumn("part", F.lit(f"back_{p}")).drop("origin")
        for p in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])


@query("scale_train_test", f"""WITH {LI}, s AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}"
                    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "k0"))}
  FROM li WHERE origin = 'train'), z AS ({" UNION ALL ".join(
    f"SELECT origin, '{c}' AS \"column\", ({c} - m_{c}) / s_{c} AS z FROM li, s"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "k0"))})
SELECT origin, "column", round_even(avg(z), 6) + 0.0 AS mean, round_even(stddev_pop(z), 6) AS std,
       round_even(min(z), 6) AS low, round_even(max(z), 6) AS high
FROM z GROUP BY 1, 2""")
def scale_train_test(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "k0"]
    rows = li(spark, sf)
    scaled = encode.Standardizer.fit(clean.part(rows, "train"), cols).transform(rows, "z_")
    z = lambda f, c: F.bround(f(f"z_{c}"), 6)
    wide = scaled.groupBy("origin").agg(
        *[
            F.struct(
                F.lit(c).alias("column"), (z(F.avg, c) + 0.0).alias("mean"),
                z(F.stddev_pop, c).alias("std"), z(F.min, c).alias("low"), z(F.max, c).alias("high"),
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ]
    )
    return wide.select("origin", F.inline(F.array(*[f"s{i}" for i in range(len(cols))])))


@query("scale_rows", f"""WITH {EV}, s AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in EV_NUM)}
  FROM ev WHERE origin = 'train')
SELECT row_id, origin, {", ".join(f"round_even(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in EV_NUM)}
FROM ev, s""")
def scale_rows(spark, sf):
    rows = ev(spark, sf)
    scaler = encode.Standardizer.fit(clean.part(rows, "train"), EV_NUM)
    return scaler.transform(rows).select(
        "row_id", "origin", *[F.bround(c, 6).alias(c) for c in scaler.outputs()]
    )


@query("point_lookup", f"""WITH {EV}
SELECT row_id, label, value, k FROM ev WHERE row_id IN (0, 17, 404, 999)""")
def point_lookup(spark, sf):
    return clean.lookup(ev(spark, sf), [0, 17, 404, 999]).select("row_id", "label", "value", "k")


@query("random_pick", f"""WITH {EV}
SELECT row_id, label FROM ev WHERE binary_label = 1
ORDER BY (row_id * 2654435761 + 42) % 4294967296, row_id LIMIT 1""")
def random_pick(spark, sf):
    pool = F.col("binary_label") == 1
    return clean.random_pick(ev(spark, sf), 42, pool, order=lattice_order).select("row_id", "label")


@query("first_by_class", f"""WITH {EV}
SELECT binary_label, min(row_id) AS row_id FROM ev GROUP BY 1""")
def first_by_class(spark, sf):
    return clean.first_by_class(ev(spark, sf))


@query("seeded_sample", f"""WITH {EV}
SELECT row_id, binary_label, value FROM ev
ORDER BY (row_id * 2654435761 + 42) % 4294967296, row_id LIMIT 500""")
def seeded_sample(spark, sf):
    rows = ev(spark, sf).select("row_id", "binary_label", "value")
    return sample_rows(rows, 500, order=lattice_order)
