"""Fill-in-middle examples: texts cut at units and put in the order prefix, suffix, middle.

A unit is a run of ASCII letters or one other character. Where units end is found eight bytes at
a time: the UTF-8 bytes of many documents are viewed as 64-bit words, a few additions and masks
set the high bit of every byte that ends a unit, and the set bits are counted per word. The k-th
unit of a document is then found by a binary search in the running counts and, in the one word it
ends in, by a product that puts the running count of the word's marks into its eight bytes.

Cuts and order depend on the document's id alone, so reruns and retries agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import extended, text_or_empty, with_python, without_names

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100 each
AT_ONCE = 1 << 22  # bytes of text handled and sent on together; a longer text goes alone
ADDED = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


def _every(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101_0101_0101_0101)


_HIGH, _LOW = _every(0x80), _every(0x01)
_ONE, _BYTE, _TOP, _WORD = np.uint64(1), np.uint64(8), np.uint64(56), np.uint64(7)


class Marks:
    """High bits of the marked bytes of 64-bit words, with running counts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes in front of byte ``at``."""
        word, bits = at >> 3, (at & 7).astype(np.uint64) * _BYTE
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << bits) - _ONE))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th marked byte, counted from 1."""
        word = np.searchsorted(self.before, k, "left") - 1
        rest = (k - self.before[word]).astype(np.uint64)
        upto = (self.words[word] >> _WORD) * _LOW  # byte j: marks in bytes 0 to j
        reached = ((upto | _HIGH) - rest * _LOW) & _HIGH  # byte j: whether that is rest or more
        return word * 8 + 8 - np.bitwise_count(reached)


def _following(marks: np.ndarray) -> np.ndarray:
    """The marks of every byte's successor."""
    return (marks >> _BYTE) | (np.append(marks[1:], np.uint64(0)) << _TOP)


def unit_marks(data: bytes | np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the bytes that end a unit, and of those that begin a character, in texts that lie one
    behind the other and end at ``ends``."""
    raw = np.frombuffer(data, np.uint8)
    words = np.zeros(len(raw) // 8 + 1, "<u8")
    words.view(np.uint8)[: len(raw)] = raw
    low = (words & _every(0x7F)) | _every(0x20)
    letter = (low + _every(0x80 - ord("a"))) & ~(low + _every(0x80 - ord("z") - 1)) & ~words & _HIGH
    inner = words & ~(words << _ONE) & _HIGH  # 10xxxxxx
    unit = _HIGH & ~_following(inner) & ~(letter & _following(letter))
    last = ends[np.diff(ends, prepend=0) > 0] - 1
    np.bitwise_or.at(unit, last >> 3, _ONE << ((last & 7).astype(np.uint64) * _BYTE + _WORD))
    return Marks(unit), Marks(_HIGH & ~inner)


def cuts(data: bytes | np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """Per text: units, first and second cut (bytes), characters in front of and between them."""
    starts = np.concatenate([[0], ends[:-1]])
    unit, char = unit_marks(data, ends)
    skipped = unit.rank(starts)
    n = unit.rank(ends) - skipped
    a, b = h1 % (n + 1), h2 % (n + 1)
    at = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        cut = starts.copy()
        some = k > 0
        cut[some] = unit.select(skipped[some] + k[some]) + 1
        at.append(cut)
    chars = [char.rank(x) for x in (starts, *at)]
    return n, at[0], at[1], chars[1] - chars[0], chars[2] - chars[1]


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most AT_ONCE bytes, or of one row."""
    row, base = 0, 0
    while row < len(ends):
        upto = max(row + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        yield row, upto
        row, base = upto, int(ends[upto - 1])


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to every row.

    ``n`` counts the text's units. ``form`` is plain, psm or spm; a plain row's output is its text
    and its numbers of characters are null. A null text is empty, an empty one plain; so is a text
    that contains a mark. A null id is written as nothing, so all such rows share their draws.
    Repeated rows give equal results, an empty table none. Texts of any length are cut whole; one
    text's output is what a row holds at most. Caller columns of the added names are replaced.
    """
    rest = without_names(docs, [n for n, _ in ADDED])
    draw = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(draw, 8 * i + 1, 8), 16, 10).cast("long")
    whole = text_or_empty(text)
    plain = (whole == "") | (number(2) % 100 >= PLAIN_FROM)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(whole, F.lit(mark))
    form = F.when(plain, "plain").when(number(3) % 100 < SPM_BELOW, "spm").otherwise("psm")
    drawn = [number(0).alias("h1"), number(1).alias("h2"), form.alias("kind"), whole.alias("whole")]  # taken by place
    ready = docs.select(*[F.col(f"`{c}`") for c in rest.columns], *drawn)
    with_python(docs.sparkSession)
    schema = extended(rest, *ADDED)
    keep, names = len(rest.columns), [f.name for f in schema]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, forms, texts = batch.columns[keep:]
            texts = texts.cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for lo, hi in _slices(offsets[1:] - offsets[0]):
                data = memoryview(texts.buffers()[2] or b"")[offsets[lo] : offsets[hi]]
                ends = offsets[lo + 1 : hi + 1] - offsets[lo]
                n, first, second, before, between = cuts(
                    data, ends, *(h.slice(lo, hi - lo).to_numpy(zero_copy_only=False) for h in (h1, h2))
                )
                kinds, out, start = forms.slice(lo, hi - lo).to_pylist(), [], 0
                for kind, a, b, end in zip(kinds, first.tolist(), second.tolist(), ends.tolist()):
                    whole = data[start:end]
                    pre, mid, suf = data[start:a], data[a:b], data[b:end]
                    out.append(bytes(whole) if kind == "plain" else b"".join(
                        (p, pre, s, suf, m, mid) if kind == "psm" else (s, suf, p, pre, m, mid)))
                    start = end
                hidden = np.array([k == "plain" for k in kinds])
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(lo, hi - lo) for c in batch.columns[:keep]), pa.array(n, pa.int64()), pa.array(kinds, pa.string()),
                    pa.array(before, pa.int64(), mask=hidden), pa.array(between, pa.int64(), mask=hidden),
                    pa.array(out, pa.binary()).view(pa.string()),  # unchecked, as Spark holds it
                ], names)

    return ready.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Texts hold no mark, and no mark can begin in
    a text and end in a mark, so the marks found are those that were put in, each once."""
    def between(left: str, right: str) -> Column:
        head = F.substring_index(output, right, 1)
        return F.substring_index(head, left, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
