"""The operators over whole tables, one query each, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import mixing

    docs = _table(spark, sf, "documents").select("doc_id", "source", "text")
    rows = mixing.with_copies(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


@_query
def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import pieces

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return pieces.encode(docs, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import exact

    rows = exact.decisions(_table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query
def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import near

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return near.decisions(docs, words=3, percent=85)


@_query
def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import quality

    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return quality.decisions(docs)


@_query
def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import chat

    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.read_back(chat.examples(rows.unionByName(extra)))


@_query
def op8_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import pii

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return pii.digest(pii.scan(docs), "pii_base", "pii_spans", pii.BASE)


@_query
def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import pii, secret_scan

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return pii.digest(secret_scan.scan(docs), "secret_base", "secret_spans", secret_scan.BASE)


@_query
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import licenses

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text", "detections")


@_query
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from flowlens.llm import warc
    from flowlens.session import require_checkpoint_dir

    pages = _table(spark, sf, "pages").select("page_id", "url", "html")
    out = f"{require_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, out)
    back = warc.read(spark, out, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op11_prefix_tree(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import prefix_tree

    return prefix_tree.report(_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


@_query
def op12_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import decontaminate

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.decisions(docs, _table(spark, sf, "benchmark").select("item_id", "text"))


@_query
def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    from flowlens.llm import infill

    made = infill.transform(_table(spark, sf, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLES["op1_mix_sources"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM w GROUP BY source),
total AS (SELECT CAST(1.5 AS DOUBLE) * sum(source_size) AS budget FROM s),
rounds AS (
  SELECT 0 AS i, CAST(NULL AS DOUBLE) AS share
  UNION ALL
  SELECT i + 1, (
    SELECT ((SELECT budget FROM total) - CAST(coalesce(sum(2 * source_size) FILTER (weight * r.share >= 2 * source_size), 0) AS BIGINT))
           / CAST(sum(weight) FILTER (r.share IS NULL OR weight * r.share < 2 * source_size) AS BIGINT)
    FROM s)
  FROM rounds r WHERE i < 200 AND (i = 0 OR r.share IS NOT NULL)),
final AS (SELECT arg_max(share, i) AS share FROM rounds WHERE share IS NOT NULL),
t AS (
  SELECT source, source_size,
         CASE WHEN (SELECT share FROM final) IS NULL OR weight * (SELECT share FROM final) >= 2 * source_size
              THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (SELECT share FROM final) END AS target
  FROM s),
r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate,
         CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text), 1, 13) AS BIGINT) AS DOUBLE)
           / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       rate, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r"""

ORACLES["op5_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents),
k AS (
  SELECT doc_id, sha256(plain) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k"""

ORACLES["op6_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok'),
l AS (
  SELECT *, 6 + 1 + 8 + length(role) + length(text)
         + length(regexp_replace(role || text, '[^\\<>:]', '', 'g')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS final
  FROM c),
p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                             ROWS UNBOUNDED PRECEDING) AS prefix FROM l)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR final) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""

ORACLES["op7_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
b AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest,
         max(page_id) OVER (PARTITION BY payload) AS best FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(digest, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b"""

ORACLES["op12_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
s AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM s))),
h AS (SELECT r, i, size, item FROM p JOIN s USING (size, phrase)),
c AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM h)) GROUP BY r),
n AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""

ORACLES["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, coalesce(array_to_string(u[1 : least(x, y)], ''), '') AS pre,
         coalesce(array_to_string(u[least(x, y) + 1 : greatest(x, y)], ''), '') AS mid,
         coalesce(array_to_string(u[greatest(x, y) + 1 : n], ''), '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""

ORACLES["op11_prefix_tree"] = r"""
WITH r AS (
  SELECT conv_id, role, text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
           str_split(CAST(conv_id AS VARCHAR), ''), lambda d: [CAST(256 + ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
           lambda s, x: CASE WHEN x > 0 THEN xor(s, x - 256) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END),
         CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM r)),
m AS (
  SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN r ON r.conv_id = c.conv_id - c.conv_id % 100 AND place <= h
  UNION ALL SELECT conv_id, 1, place, role, text FROM c JOIN r USING (conv_id) WHERE place > h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM m),
p AS (
  SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '')
           OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix
  FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (
  SELECT *, lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS above,
         depth = max(depth) OVER (PARTITION BY conv_id) AS final FROM p),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(above) AS above, max(chars) AS chars,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final) AS ends
  FROM q GROUP BY prefix, depth),
k AS (SELECT above AS prefix, count(*) AS n FROM n WHERE above IS NOT NULL GROUP BY above),
v AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
t AS (
  SELECT a.prefix, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n_convs - 1) * v.chars) AS saved
  FROM v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.prefix)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN t USING (prefix) LEFT JOIN v o ON o.prefix = v.above"""
