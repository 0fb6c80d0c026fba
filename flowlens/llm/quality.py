"""Quality rules: fixed limits, then robust outliers among documents of a language and source.

The verdict uses minimum-covariance-determinant estimates. Each document gives a vector of
transformed statistics; per (language, source) the half of the documents whose covariance has the
smallest determinant is sought by concentration steps: distances under the last estimate, the
half with the smallest, its mean and covariance, until the determinant falls no more. Starts are
the whole group and the group's parts above and below its mean in each statistic. The half's
covariance is multiplied by its consistency factor, and a document is rejected when its squared
distance exceeds a chi-square quantile.

All documents take part. A step is one aggregate over a slim table (one short row per document):
distances are counted in fine logarithmic bins, so the half's limit is a count and no task sorts
or holds a group, and the sums of the half combine before their shuffle. Groups stay rows of a
table; their small matrices are inverted where they lie.

A group of fewer than SMALLEST documents is judged by its language's estimate, and such a
language by that of all. Copies would shrink a group's covariance to a point: equal vectors count
once in the estimate, and where a direction's variance is below LEAST_SHARE of that among all
documents, it is raised to that. FLOOR only keeps the matrices regular.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import HEAVY, extended, kept_table, lookup, numbered, small_jobs, with_python

MIN_WORDS, MAX_REPEATED = 20, 30  # words; per cent of words in repeated windows
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["symbols", "dup_lines", "repeats", "word_length", "variety"]
FLOOR = 0.005  # spread added to every statistic; those of the halves are 0.0075 to 0.06
LEAST_SHARE = 0.25
OUTSIDE = 1e-9  # share of a normal group's documents beyond the cutoff
SMALLEST = 200
ALL = "all"
EARLY_STEPS, FINALISTS, MOST_STEPS = 2, 2, 100
STAYS = 1e-3  # a fall of the determinant's logarithm that no longer counts: 0.01 % of a spread
BINS_PER_OCTAVE = 64


def chi2_share(x: float, d: int) -> float:
    """Share of a chi-square distribution of d (odd) degrees below x."""
    share, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, d + 1, 2):
        share, term = share - term, term * x / k
    return share


def chi2_quantile(share: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, d) < share else (low, mid)
    return high


def consistency(share: float, d: int) -> float:
    """What the covariance of the closest share of a normal sample is multiplied by."""
    return 1.0 if share >= 1 else share / chi2_share(chi2_quantile(share, d), d + 2)


CUTOFF = math.sqrt(chi2_quantile(1 - OUTSIDE, len(STATS)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more, exactly.

    Windows are numbered by doubling: pairs of words, pairs of pairs, pairs of those.
    """
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    span = 1
    while span < WINDOW:
        pair = code[:-span] * np.int64(len(words)) + code[span:]
        _, code = np.unique(pair, return_inverse=True)
        span *= 2
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-WINDOW][again] += 1
    edge[WINDOW:][again] -= 1
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()  # splits at just the six ASCII blanks
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """Adds the base counts and the number of distinct words and of lines with a word."""
    with_python(docs.sparkSession)
    schema = extended(docs, *[(n, "long") for n in [*BASE, "n_distinct", "n_lines"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(text)):
                t = value.as_py() or ""
                lines = sum(1 for x in t.split("\n") if x.strip(BLANKS))
                rows.append((*base_counts(t), len(set(t.encode().split())), lines))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return docs.mapInArrow(run, schema)


def _vector() -> list[Column]:
    """Statistics on scales where ordinary texts of any length spread alike; counts that are nought in
    most texts get a prior of several events, so that the first event is a small step."""
    c = {n: F.col(n).cast("double") for n in [*BASE, "n_distinct", "n_lines"]}
    ratio = lambda part, prior, whole, size: F.sqrt((part + prior) / (whole + size))
    return [
        ratio(c["n_symbols"], 10.0, c["n_words"], 100.0),
        ratio(c["n_dup_lines"], 4.0, c["n_lines"], 20.0),
        ratio(c["n_repeat_words"], 100.0, c["n_words"], 200.0),
        F.log((c["word_chars"] + 100.0) / (c["n_words"] + 20.0)),
        # distinct words fall as a power of the length; this is that power, drawn to 1 when short
        F.log((c["n_distinct"] + 20.0) / (c["n_words"] + 20.0)) / F.log(c["n_words"] + 40.0),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _packed(mean: np.ndarray, inverse: np.ndarray) -> list[float]:
    """A model as a row holds it, rounded so that reruns agree."""
    return [*np.round(mean, 9).tolist(), *np.round(inverse[np.triu_indices(len(mean))], 3).tolist()]


def _unpacked(model: list[float]) -> tuple[np.ndarray, np.ndarray]:
    d = len(STATS)
    inverse = np.zeros((d, d))
    inverse[np.triu_indices(d)] = model[d:]
    return np.array(model[:d]), inverse + np.triu(inverse, 1).T


def _estimates(sums: DataFrame) -> DataFrame:
    """(g, size, start, n, model, det) of rows of sums: centre and inverse covariance of the n rows,
    and the logarithm of its determinant."""
    d = len(STATS)
    schema = extended(sums.select("g", "size", "start", "n"), ("model", "array<double>"), ("det", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            models, dets = [], []
            for n, s1, s2 in zip(at["n"].to_pylist(), at["s1"].to_pylist(), at["s2"].to_pylist()):
                mean = np.array(s1) / n
                cov = np.zeros((d, d))
                cov[np.triu_indices(d)] = np.array(s2) / n
                cov = cov + np.triu(cov, 1).T - np.outer(mean, mean) + FLOOR**2 * np.eye(d)
                models.append(_packed(mean, np.linalg.inv(cov)))
                dets.append(round(float(np.linalg.slogdet(cov)[1]), 6))
            arrays = [at["g"], at["size"], at["start"], at["n"], pa.array(models, pa.list_(pa.float64())), pa.array(dets, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return sums.mapInArrow(run, schema)


def _governed(groups: DataFrame, pooled: DataFrame) -> DataFrame:
    """(g, size, model) for verdicts: covariances times their consistency factor, degenerate
    directions raised to LEAST_SHARE of the variance that ``pooled``, one row, has there."""
    d = len(STATS)
    rows = groups.crossJoin(F.broadcast(pooled.select(F.col("model").alias("wide"), (F.col("n") / F.col("size")).alias("part"))))
    schema = groups.select("g", "size", "model").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            models = []
            for n, size, model, wide, part in zip(*[at[c].to_pylist() for c in ("n", "size", "model", "wide", "part")]):
                mean, inverse = _unpacked(model)
                cov = np.linalg.inv(inverse) * consistency(n / size, d)
                root = np.linalg.cholesky(np.linalg.inv(_unpacked(wide)[1]) * consistency(part, d))
                back = np.linalg.inv(root)
                share, turn = np.linalg.eigh(back @ cov @ back.T)
                turn = back.T @ turn
                models.append(_packed(mean, (turn / np.maximum(share, LEAST_SHARE)) @ turn.T))
            yield pa.RecordBatch.from_arrays([at["g"], at["size"], pa.array(models, pa.list_(pa.float64()))], schema.names)

    return rows.mapInArrow(run, schema)


def _distance2(model: str = "model") -> Column:
    """Squared Mahalanobis distance of the row's v under the model."""
    d, total, at = len(STATS), F.lit(0.0), len(STATS)
    diff = [F.col("v")[i] - F.col(model)[i] for i in range(d)]
    for i in range(d):
        for j in range(i, d):
            total = total + diff[i] * diff[j] * F.col(model)[at] * (1.0 if i == j else 2.0)
            at += 1
    return total


def _sums(rows: DataFrame) -> DataFrame:
    """Per group and start the number, sums and sums of products of v."""
    d = len(STATS)
    v = [F.col("v")[i] for i in range(d)]
    return rows.groupBy("g", "size", "start").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in v]).alias("s1"),
        F.array(*[F.sum(v[i] * v[j]) for i in range(d) for j in range(i, d)]).alias("s2"),
    )


def _named(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their group g: language and source, where those have SMALLEST documents; else
    all rows of such sources in the language; where those are too few, all rows (ALL)."""
    rows = rows.withColumn("g", F.col("pair"))
    for wider in (_named("lang"), F.lit(ALL)):
        sizes = kept_table(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")))
        rows = _joined(rows, sizes).withColumn("g", F.when(F.col("size") >= SMALLEST, F.col("g")).otherwise(wider)).drop("size")
    return kept_table(rows)


def _joined(rows: DataFrame, groups: DataFrame, total: int | None = None) -> DataFrame:
    """Rows with their group's facts; groups that hold many rows are broadcast, at most HEAVY of them."""
    if total is None:
        total = groups.agg(F.sum("size")).first()[0] or 0
    return lookup(rows, groups, ["g"], "size", total)


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates of every group: of all its rows, and of those above and below its mean in each statistic."""
    d = len(STATS)
    sized = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.avg(F.col("v")[i]) for i in range(d)]).alias("mean"))
    rows = _joined(rows, kept_table(sized))
    sides = [F.when(F.col("v")[i] < F.col("mean")[i], 2 * i + 1).otherwise(2 * i + 2) for i in range(d)]
    return kept_table(_estimates(_sums(rows.withColumn("start", F.explode(F.array(F.lit(0), *sides))))))


def _step(rows: DataFrame, tries: DataFrame, total: int, few: bool) -> DataFrame:
    """Estimates of the half that lies closest to each of the given ones; of old and new the one of smaller
    determinant over a half, and whether that is a new one. With ``few``, all groups are broadcast."""
    packed = lambda t, *more: kept_table(t.groupBy("g", "size").agg(F.collect_list(F.struct("start", "model", *more)).alias("t")))
    bins = F.floor(F.log2(F.greatest(_distance2(), F.lit(0.0)) + 1e-6) * BINS_PER_OCTAVE).cast("int")
    joined = lambda groups: rows.join(F.broadcast(groups), "g") if few else _joined(rows, groups, total)
    spread = lambda groups: joined(groups).select("g", "size", "v", F.inline("t")).withColumn("bin", bins)
    counts = spread(packed(tries)).groupBy("g", "size", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    limits = counts.groupBy("g", "size", "start").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).select("g", "start", F.expr(
        "aggregate(array_sort(bins), struct(0L as seen, cast(null as int) as lim), (a, x) -> struct(a.seen + x.n as seen, "
        "case when a.lim is null and 2 * (a.seen + x.n) >= size then x.bin else a.lim end as lim)).lim"
    ).alias("half"))
    closest = spread(packed(tries.join(limits, ["g", "start"]), "half")).where("bin <= half")
    new = _estimates(_sums(closest)).select("g", "size", "start", *[F.col(c).alias(f"{c}_") for c in ("n", "model", "det")])
    both = new.join(tries.select("g", "start", "n", "model", "det", "halved"), ["g", "start"])
    better = ~F.col("halved") | (F.col("det_") < F.col("det") - STAYS)
    return kept_table(both.select(
        "g", "size", "start", *[F.when(better, F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in ("n", "model", "det")],
        F.lit(True).alias("halved"), better.alias("moved"),
    ))


def _best(tries: DataFrame, k: int) -> DataFrame:
    """The k estimates of smallest determinant of every group."""
    names = [c for c in tries.columns if c != "g"]
    order = ["det", "start", *[c for c in names if c not in ("det", "start")]]
    packed = tries.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct(*order))), 1, k).alias("best"))
    return packed.select("g", F.inline("best")).select(*tries.columns)


def halves(rows: DataFrame) -> DataFrame:
    """(g, size, n, model, det) of the half of smallest determinant found in every group of rows (g, v)."""
    total = rows.count()
    tries = _starts(rows).withColumn("halved", F.lit(False)).withColumn("moved", F.lit(True))
    few = not tries.where(F.col("size") * HEAVY <= total).limit(1).count()  # groups that hold many rows each are few
    for step in range(MOST_STEPS):
        tries = _step(rows, tries, total, few)
        if step + 1 == EARLY_STEPS:
            tries = kept_table(_best(tries, FINALISTS))
        if not tries.where("moved").limit(1).count():
            break
    return kept_table(_best(tries, 1).select("g", "size", "n", "model", "det"))


def fit(rows: DataFrame) -> DataFrame:
    """(g, size, model) for every group of rows (g, v); equal rows count once in the estimate, each in size."""
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    every = rows.where(F.col("g") != ALL).withColumn("g", F.lit(ALL))
    found = halves(kept_table(rows.unionByName(every).distinct()))
    return kept_table(_governed(found, found.where(F.col("g") == ALL)).drop("size").join(sizes, "g"))


def decisions(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept, distance.

    Words are runs without ASCII white space; a null text has none. A text with fewer than
    MIN_WORDS words, or more than MAX_REPEATED per cent of them in repeated windows, fails; any
    other is kept unless its distance exceeds CUTOFF. Null languages and sources are values of
    their own. Repeated rows are judged each; an empty table gives an empty table.
    """
    named = docs.select(*[F.col(c).alias(n) for c, n in ((doc_id, "id"), (text, "text"), (lang, "lang"), (source, "source"))])
    rows, groups = _fitted(named)
    judged = _verdict(_joined(rows, groups))
    return judged.select(F.col("id").alias("doc_id"), *BASE, "base_failed", "kept", "distance")


def _described(docs: DataFrame) -> DataFrame:
    """Rows with text, lang, source as base counts, base_failed, pair and v."""
    rows = statistics(docs, "text").withColumn("v", F.array(*_vector())).drop("n_distinct", "n_lines")
    return rows.withColumn("base_failed", base_failed()).withColumn("pair", _named("lang", "source"))


def _fitted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slim rows with their group, and the groups' estimates."""
    with small_jobs(docs.sparkSession):
        rows = _placed(kept_table(_described(docs).drop("text")))
        return rows, fit(rows.select("g", "v"))


def _verdict(rows: DataFrame) -> DataFrame:
    far = F.sqrt(F.greatest(_distance2(), F.lit(0.0)))
    rows = rows.withColumn("distance", far)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def keep(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that stay, with the caller's columns. Texts are described again and judged by the
    estimate of their language and source, so no verdict has to be joined to a text."""
    plain, at = numbered(docs)
    named = plain.select("*", F.col(at[text]).alias("text"), F.col(at[lang]).alias("lang"), F.col(at[source]).alias("source"))
    rows, groups = _fitted(named.select("text", "lang", "source"))
    pairs = rows.groupBy("pair").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("n"))
    pairs = kept_table(_joined(pairs, groups).drop("size"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    judged = _verdict(lookup(_described(named), pairs, ["pair"], "n", total))
    return judged.where("kept").select(*plain.columns).toDF(*docs.columns)
