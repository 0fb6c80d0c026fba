"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Everything is a DataFrame expression over one row; nothing is shuffled. The patterns look
behind a start, so that a long run of letters or digits is entered once and not at each of
its characters, and repeat groups either a bounded number of times or without giving any back, which the
matcher does in a loop and not by calling itself, so that no text is too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import text_or_empty, without_names
from flowlens.llm.spans import NEAR, as_spans, matches, mentions, together, written

BASE = ["email", "ip", "card", "phone"]
KEPT_FROM = 0.5  # least score of spans of the kinds that aren't base kinds

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
# a whole run of digits with single separators; runs of other sizes can't be card numbers
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])"
# fixed values: words that make a kind likelier
WORDS = {
    "email": ["e-?mail", "mail", "contact", "correo", "courriel"],
    "ip": ["ip", "address", "host", "server", "adresse"],
    "card": ["card", "visa", "mastercard", "amex", "payment", "karte", "tarjeta", "carte"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "tel[eé]fono"],
    "iban": ["iban", "account", "bank", "konto", "cuenta", "compte"],
    "ssn": ["ssn", "social", "security"],
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(number: Column) -> Column:
    """Remainder of an account number with its first four signs at the end, letters as 10 to 35."""
    turned = F.concat(F.substring(number, 5, 2**31 - 1), F.substring(number, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        sign = F.substring(turned, i, F.lit(1))
        letter = F.ascii(sign) - 55
        return F.when(letter >= 10, rest * 100 + letter).otherwise(rest * 10 + F.ascii(sign) - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add)


def _nearby(s: Column, kind: str) -> Column:
    """Whether a word of the kind stands near a match, on either side."""
    return mentions(s["before"], WORDS[kind]) | mentions(s["after"], WORDS[kind])


def scan(docs: DataFrame, *, text: str = "text", near: int = NEAR) -> DataFrame:
    """Adds pii_base and pii_spans, arrays of struct<start, order, kind, end, score>.

    Base kinds stay whatever their score; the others (iban by mod 97, ssn, phones without a
    country) from KEPT_FROM on. A word of its kind within ``near`` characters on either side (and
    not beyond the next match) makes a span likelier. A null text is empty and has no spans, an empty
    table no rows; a text may be of any length and hold any number of spans. Places count code
    points. Repeated rows give equal rows. Caller columns of the added names are replaced.
    """
    def _kind(text: Column, order: int, kind: str, pattern: str, confirmed, start: float) -> Column:
        found = F.filter(matches(text, pattern, near=near), confirmed)
        return as_spans(found, order, kind, lambda s: F.lit(start) + F.when(_nearby(s, kind), 0.25).otherwise(0.0))

    docs = without_names(docs, ["pii_base", "pii_spans"])
    t, plain = text_or_empty(text), lambda s: digits(s["text"])
    base = together(
        _kind(t, 0, "email", EMAIL, lambda s: F.lit(True), 0.7),
        _kind(t, 1, "ip", IP, lambda s: F.regexp_like(s["text"], F.lit(IP_PARTS)), 0.5),
        _kind(t, 2, "card", CARD, lambda s: luhn(plain(s)), 0.7),
        _kind(t, 3, "phone", PHONE, lambda s: F.length(plain(s)).between(9, 15), 0.5),
    )
    more = together(
        _kind(t, 4, "iban", IBAN, lambda s: mod97(F.replace(s["text"], F.lit(" "), F.lit(""))) == 1, 0.7),
        _kind(t, 5, "ssn", SSN, lambda s: F.lit(True), 0.4),
        as_spans(
            F.filter(matches(t, LOCAL_PHONE, near=near), lambda s: _nearby(s, "phone")), 6, "local_phone",
            lambda s: F.lit(0.55),
        ),
    )
    kept = F.filter(more, lambda s: s["score"] >= KEPT_FROM)
    return docs.withColumn("pii_base", base).withColumn("pii_spans", together(F.col("pii_base"), kept))


def digest(docs: DataFrame, base: str, spans: str, kinds: list[str]) -> DataFrame:
    """doc_id, n_<kind>, base_sha256 and spans of scanned rows."""
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select(
        "doc_id", *[count(k) for k in kinds], F.sha2(written(F.col(base)), 256).alias("base_sha256"),
        written(F.col(spans)).alias("spans"),
    )
