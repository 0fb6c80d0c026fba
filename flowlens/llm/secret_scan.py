"""Secrets: fixed patterns, and strings whose windows are too random to be written by hand.

Every maximal run of a character class (hexadecimal in lower or in upper case, or letters, digits
and the signs of base 64) is searched with a sliding window of WINDOW characters and has its class's
limit, also where it is part of a longer run of another class. The window's Shannon entropy is kept
by counts: a step takes one character out and one in, and changes two counts and the sum of n log n by
two terms. The counts lie in a few long integers, so a step copies little. Strings of known harmless forms are suppressed. DataFrame expressions only, row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import text_or_empty, without_names
from flowlens.llm.spans import as_spans, let, matches, together

BASE = ["assign", "access", "hex"]
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
LEAST_VALUE = 6
WINDOW = 20
NEAR = 200  # characters before a hexadecimal run that are searched for a harmless word
_SIGN = "[A-Za-z0-9+/_-]"  # = only stands behind, so that name= in front is no part of a value
RUNS = {
    "hex": [rf"[0-9a-f]{{{WINDOW},}}+", rf"[0-9A-F]{{{WINDOW},}}+"],
    "base64": [rf"(?<!{_SIGN})(?:{_SIGN}{{{WINDOW},}}+=*+|{_SIGN}{{{WINDOW - 1}}}=++|{_SIGN}{{{WINDOW - 2}}}={{2,}}+)"],
}
ONLY_HEX = "^(?:[0-9a-f]+|[0-9A-F]+)=*$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LIMITS = {"hex": 3.0, "base64": 3.85}  # bits a character, of at most log2(WINDOW) = 4.32
# fixed values: forms that look random and are no secrets
HARMLESS = "(?i:example|sample|dummy|placeholder|changeme)"
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    HARMLESS,
    r"0123456789|(?i:abcdefghij)",
    r"^[0-9+/_=-]+$",
    r"^(?:[A-Za-z]++[_/-])++[A-Za-z0-9]{1,12}$",  # groups give nothing back, so they repeat in a loop
    r"^(?:[a-z]{2,}+|[A-Z][a-z]{2,}+)(?:[A-Z][a-z]{2,}+)++$",
]


def peak_entropy(value: Column) -> Column:
    """The largest entropy of any window of the string, in bits a character. Linear in its length."""
    weights = [F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)]
    bits, each = WINDOW.bit_length(), 63 // WINDOW.bit_length()  # of one count, and counts in one long
    numbers = -(-(len(ALPHABET) + 1) // each)
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), (code % each * bits).cast("int"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")
    )

    def step(a: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]

        def count(code: Column) -> Column:
            held = F.get(a["counts"], F.floor(code / each).cast("int"))
            return F.call_function("shiftright", held, (code % each * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

        weight = lambda n: F.get(F.array(*weights), n)
        more, less = count(into), count(out)
        change = F.when(into == out, 0.0).otherwise(
            weight(more + 1) - weight(more) + F.when(out > 0, weight(less - 1) - weight(less)).otherwise(0.0)
        )
        total = a["sum"] + change
        counts = F.transform(a["counts"], lambda n, j: n + F.when(j == F.floor(into / each), one(into)).otherwise(0)
                             - F.when((out > 0) & (j == F.floor(out / each)), one(out)).otherwise(0))
        entropy = F.lit(math.log2(WINDOW)) - total / WINDOW
        return F.struct(
            F.when(into == out, a["counts"]).otherwise(counts).alias("counts"), total.alias("sum"),
            F.when(x["full"], F.greatest(a["best"], entropy)).otherwise(a["best"]).alias("best"),
        )

    def peak(c: Column) -> Column:
        left = F.concat(F.array_repeat(F.lit(0), WINDOW), c)  # what leaves the window, 0 while it fills
        moves = F.transform(F.filter(F.arrays_zip(c.alias("into"), left.alias("out")), lambda x: x["into"].isNotNull()),
                            lambda x, i: F.struct(x["into"].alias("into"), x["out"].alias("out"), (i >= WINDOW - 1).alias("full")))
        return F.aggregate(moves, start, step)["best"]

    return let(codes, peak)


def entropy_spans(text: Column, near: int = NEAR) -> Column:
    allowed = lambda v: F.regexp_like(v, F.lit("|".join(f"(?:{p})" for p in ALLOWED)))
    named = lambda s: F.regexp_like(s["before"], F.lit(rf"{HARMLESS}[A-Za-z0-9+/_=-]*$"))
    out = []
    for order, (name, limit) in enumerate(LIMITS.items(), len(BASE)):
        for pattern in RUNS[name]:
            skip = named if name == "hex" else lambda s: F.regexp_like(s["text"], F.lit(ONLY_HEX))
            open_ones = F.filter(matches(text, pattern, near=near), lambda s: ~allowed(s["text"]) & ~skip(s))
            scored = F.transform(open_ones, lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), peak_entropy(s["text"]).alias("bits"),
            ))
            random = _above(limit)
            out.append(as_spans(F.filter(scored, random), order, f"entropy_{name}", lambda s: s["bits"] / math.log2(WINDOW)))
    return F.concat(*out)


def _above(limit: float):
    return lambda s: s["bits"] >= limit


def scan(docs: DataFrame, *, text: str = "text", near: int = NEAR) -> DataFrame:
    """Adds secret_base and secret_spans, arrays of struct<start, order, kind, end, score>.

    Base kinds stay as they are; random strings are added. A hexadecimal run that follows a harmless word in one run
    with it, at most ``near`` characters before, is none. A null text is empty and has no spans, an
    empty table no rows; a text or a run may be of any length. Places count code points. Repeated rows
    give equal rows. Caller columns of the added names are replaced.
    """
    docs = without_names(docs, ["secret_base", "secret_spans"])
    t, sure = text_or_empty(text), lambda s: F.lit(1.0)
    assigned = F.filter(matches(t, ASSIGN, 1), lambda s: F.length(s["group"]) >= LEAST_VALUE)
    base = together(
        as_spans(assigned, 0, "assign", sure), as_spans(matches(t, ACCESS), 1, "access", sure),
        as_spans(matches(t, HEX), 2, "hex", sure),
    )
    return docs.withColumn("secret_base", base).withColumn("secret_spans", together(F.col("secret_base"), entropy_spans(t, near)))
