"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, in DataFrame
functions alone.

Every window of N words of a benchmark item (the whole item, if it is shorter) becomes a row of a
set: hash, words, and the class of items it occurs in. The set is cut into parts of at most
PART_BYTES, measured before; one part at a time is broadcast, and each text's windows are hashed
and looked up where the text is. Equal hashes only propose: the words are compared before a window
counts. What is shuffled is a row per text and one per verified window, never a text.

Windows that occur in the same items share a class, and texts with the same classes share their
list of items, so a passage that many items and many texts hold is listed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import (
    ascii_lower, kept_table, lookup, numbered, possible_member, text_or_empty,
)

N = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a lower-cased text
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART_BYTES = 64 << 20
ROW_BYTES = 120  # of a set's row besides its words


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(WORDS), F.lit(0))


def _key(size: Column, words: Column, at: Column, n: int) -> Column:
    """Hash of the n words from ``at`` on; words that aren't there add nothing."""
    return F.xxhash64(size, *[F.get(words, at + i) for i in range(n)])


def windows(bench: DataFrame, *, item_id: str = "item_id", text: str = "text", n: int = N) -> tuple[DataFrame, DataFrame]:
    """The set (key, size, phrase, class) and the members (class, item) of its classes.

    A class is the set of items a phrase occurs in, told apart by how many they are and two sums
    of hashes over them, which combine before a shuffle. Ids are strings, a null one is empty. Items without
    a word give nothing.
    """
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(text).alias("words"))
    size = F.least(F.size("words"), F.lit(n))
    starts = F.sequence(F.lit(0), F.size("words") - size)
    cut = items.where(F.size("words") > 0).select("item", "words", size.alias("size"), F.explode_outer(starts).alias("at"))
    phrases = kept_table(cut.select(
        "item", "size", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("phrase")
    ).distinct())
    mixed = lambda i: F.sum(F.xxhash64(F.lit(i), "item").cast("decimal(20,0)"))
    grouped = phrases.groupBy("phrase", "size").agg(F.count(F.lit(1)).alias("k"), mixed(1).alias("a"), mixed(2).alias("b"))
    kind = F.md5(F.concat_ws(":", "k", "a", "b"))
    grouped = grouped.withColumns({"class": kind, "words": F.split("phrase", " ")})
    table = kept_table(grouped.select(_key(F.col("size"), F.col("words"), F.lit(0), n).alias("key"), "size", "phrase", "class"))
    named = table.groupBy("class").agg(F.min("phrase").alias("phrase"))
    return table, kept_table(named.join(phrases.select("item", "phrase"), "phrase").select("class", "item"))


def _scan(docs: DataFrame, part: DataFrame, sizes: list[int], first: bool) -> DataFrame:
    """Rows of verified windows (start, end, class) and, if ``first``, one of each text (start null)."""
    last = F.size("words") - sizes[0]
    at = docs.withColumn("at", F.explode_outer(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))))
    probes = []
    for size in sizes:
        full = (F.col("at") >= 0) & (F.col("at") + size <= F.size("words"))
        probes.append(F.when(full, _key(F.lit(size), F.col("words"), F.col("at"), size)))
    probe = probes[0] if len(sizes) == 1 else F.explode_outer(F.array(*probes))
    probed = at.withColumn("probe", probe)
    same = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ") == F.col("phrase")
    met = probed.join(F.broadcast(part), (F.col("probe") == F.col("key")) & same, "left")
    met = met.where(F.col("phrase").isNotNull() | ((F.col("at") < 0) & F.lit(first)))
    hit = F.col("phrase").isNotNull()
    return met.select(
        "id", "digest", F.size("words").cast("long").alias("n_words"), F.when(hit, F.col("at")).alias("start"),
        F.when(hit, F.col("at") + F.col("size")).alias("end"), "class",
    )


def found(
    docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = N, part_bytes: int = PART_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """What each different (id, text) holds, and the classes' items.

    First: id, digest (of the text), copies (rows of that id and text), n_words, covered (sorted
    numbers of the words inside a window), classes (sorted). Second: class, item.
    """
    table, members = windows(bench, item_id=item_id, text=item_text, n=n)
    row = table.agg(
        F.sum(F.octet_length("phrase") + ROW_BYTES).alias("bytes"), F.sort_array(F.collect_set("size")).alias("sizes")
    ).first()
    parts, sizes = max(1, -(-(row["bytes"] or 0) // part_bytes)), list(row["sizes"]) or [n]
    plain = text_or_empty(text)
    slim = docs.select(F.col(doc_id).alias("id"), F.sha2(plain, 256).alias("digest"), words_of(text).alias("words"))
    scanned = [
        _scan(slim, table if parts == 1 else table.where(F.pmod("key", F.lit(parts)) == i), sizes, i == 0)
        for i in range(parts)
    ]
    if parts > 1:  # a part's broadcast is gone before the next one comes
        scanned = [kept_table(s) for s in scanned]
    rows = reduce(DataFrame.unionByName, scanned)
    per = rows.groupBy("id", "digest").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("start").isNull()).alias("marks"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.collect_set("class")).alias("classes"),
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    copies = (F.col("marks") / len(sizes)).cast("long")
    return per.select("id", "digest", copies.alias("copies"), "n_words", F.sort_array(covered).alias("covered"), "classes"), members


def decisions(docs: DataFrame, bench: DataFrame, **names) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words and holds nothing, like an empty one. Repeated rows give equal rows, an
    empty table none; without benchmark words nothing is contaminated. Null ids are ids like others.
    """
    per, members = found(docs, bench, **names)
    listed = F.when(F.size("classes") > 0, F.md5(F.array_join("classes", ",")))
    slim = kept_table(per.select(
        "id", "copies", "n_words", F.size("covered").cast("long").alias("n_hit"), "classes", listed.alias("listed")))
    sets = slim.where("listed IS NOT NULL").groupBy("listed").agg(
        F.sum("copies").alias("size"), F.min("classes").alias("classes"))
    each = sets.select("listed", "size", F.explode_outer("classes").alias("class")).join(members, "class")
    items = each.groupBy("listed", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items = kept_table(items.select(
        "listed", "size", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    total = slim.agg(F.sum("copies")).first()[0] or 0
    dirty = lookup(slim.where("listed IS NOT NULL").drop("classes"), items, ["listed"], "size", total).drop("size")
    clean = slim.where("listed IS NULL").drop("classes").withColumns(
        {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    rows = clean.unionByName(dirty).withColumn("_", F.explode_outer(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def without_words(text: Column, covered: Column) -> Column:
    """The text without the words of these numbers and what stands between two of them."""
    words, gaps = F.regexp_extract_all(text, F.lit(RAW_WORDS), F.lit(0)), F.split(text, RAW_WORDS, -1)
    run = F.transform(covered, lambda p, k: F.concat(
        F.array_repeat(F.lit(False), p - F.when(k > 0, F.get(covered, k - 1)).otherwise(-1) - 1), F.array(F.lit(True))))
    tail = F.array_repeat(F.lit(False), F.size(words) - F.element_at(covered, -1))
    gone = F.concat(F.flatten(run), tail)  # one flag for each word, and false behind the last
    zipped = F.arrays_zip(
        gaps.alias("gap"), words.alias("word"), gone.alias("gone"), F.concat(F.array(F.lit(False)), gone).alias("before"))
    left = lambda x: F.concat(
        F.when(x["gone"] & x["before"], "").otherwise(x["gap"]), F.when(x["gone"], "").otherwise(F.coalesce(x["word"], F.lit(""))))
    return F.array_join(F.transform(F.filter(zipped, lambda x: x["gap"].isNotNull()), left), "")


def clean(
    docs: DataFrame, bench: DataFrame, *, remove: str = "documents", least_share: float = 0.0, doc_id: str = "doc_id",
    text: str = "text", **names,
) -> DataFrame:
    """The caller's rows and columns without contaminated documents, or without the hit spans.

    ``remove`` is documents or spans. Texts with a smaller share of hit words than ``least_share`` stay
    as they are. Texts that surely hold nothing pass by without a shuffle.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    plain, at = numbered(docs)
    ident, words = at[doc_id], at[text]
    per, _ = found(plain, bench, doc_id=ident, text=words, **names)
    dirty = per.where((F.size("covered") > 0) & (F.size("covered") >= F.col("n_words") * least_share))
    key = lambda i, d: F.xxhash64(F.coalesce(i.cast("string"), F.lit("")), d)
    dirty = kept_table(dirty.select(
        key(F.col("id"), F.col("digest")).alias("key"), "copies", "covered", F.col("id").alias("same_id"), F.col("digest").alias("same")))
    digest = F.sha2(text_or_empty(words), 256)
    rows = plain.withColumn("digest", digest).withColumn("key", key(F.col(ident), F.col("digest")))
    rows = possible_member(rows, "key", dirty, "open")
    passed = rows.where("NOT open").select(*plain.columns)
    total = dirty.agg(F.sum("copies")).first()[0] or 0
    text_id = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    some = rows.where("open").withColumn("same", F.col("digest")).withColumn("same_id", text_id(F.col(ident)))
    keyed = dirty.withColumn("same_id", text_id(F.col("same_id")))
    met = lookup(some, keyed, ["key", "same_id", "same"], "copies", total, "left")
    if remove == "documents":
        met = met.where("covered IS NULL")
    else:
        cut = F.when(F.col("covered").isNull(), F.col(words)).otherwise(without_words(text_or_empty(words), F.col("covered")))
        met = met.withColumn(words, cut)
    return passed.unionByName(met.select(*plain.columns)).toDF(*docs.columns)

