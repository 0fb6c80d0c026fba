"""Exact merge-type encoding of whole texts with a SentencePiece vocabulary, and decoding.

A text's encoding under a merge vocabulary is the only sequence of tokens in which every two
neighbours are compatible: re-merging the characters of the pair gives the pair again. The
encoder walks the text with the longest token at each place (all found by one Aho-Corasick
pass), steps to the token's next shorter prefix when it doesn't fit its left neighbour, and goes
back when none fits. A bit per position remembers where no encoding of the rest was found.

Places that no token crosses cut a text into chunks that encode on their own, so repeated
chunks (words) are encoded once per task. The cuts are read off the vocabulary.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.common import extended, freed_after, text_or_empty, with_python, without_names

GAP = "▁"
MEMO = 300_000  # remembered pairs of a worker; only speed depends on it
CHUNKS = 150_000  # remembered chunks of a task, in each of two generations
LONG_CHUNK = 64
ROWS_AT_ONCE = 128
_READY: dict[str, "PieceCodec"] = {}


def ranks_and_bytes(path: str) -> tuple[dict[str, float], dict[str, int], list[int]]:
    """Merge order and ids of the mergeable pieces (gaps as blanks), and the ids of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    order, ids, single = {}, {}, [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            single[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            spaced = piece.replace(GAP, " ")
            order[spaced], ids[spaced] = -model.get_score(i), i
    if -1 in single:
        raise ValueError("the vocabulary has no byte pieces")
    return order, ids, single


def merge(symbols: list[str], order: dict[str, float]) -> list[str]:
    """Joins the best neighbouring pair, leftmost first, until none is in the vocabulary."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(
            ((order[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in order),
            default=None,
        )
        if best is None:
            break
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


class _Chunks(dict):
    """Chunk to its decimal ids, in two generations; encodes what neither holds."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, chunk: str) -> str:
        joined = self.old.get(chunk)
        if joined is None:
            ids = self.codec.ids_of(chunk)
            text, joined = self.codec.decode_pieces(ids), ",".join(map(str, ids))
            if text != chunk:
                self.codec.unlike[chunk] = text
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = joined
        return joined


class PieceCodec:
    """Encoder and decoder of one vocabulary file; built once per Python worker."""

    def __init__(self, path: str):
        import ahocorasick

        self.order, self.ids, self.bytes = ranks_and_bytes(path)
        chars = {c for p in self.order for c in p}
        reachable = [p for p in self.order if len(p) > 1 and merge(list(p), self.order) == [p]]
        self.tokens = sorted(chars | {p for p in self.order if len(p) == 1}) + reachable
        number = {t: i for i, t in enumerate(self.tokens)}
        self.length = [len(t) for t in self.tokens]
        self.shorter = [
            next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.tokens
        ]
        self.alphabet = frozenset(chars)
        self.out = [self._ids(t) for t in self.tokens]
        self.matcher = ahocorasick.Automaton()
        for t, i in number.items():
            self.matcher.add_word(t, i)
        self.matcher.make_automaton()
        self.fits: dict[int, bool] = {}
        self.chunks = re.compile(self._chunk_pattern())
        self.unlike: dict[str, str] = {}  # decoded texts of chunks that don't decode to themselves
        self.known = _Chunks(self)
        self.text_of = {i: p for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}

    def _ids(self, token: str) -> tuple[int, ...]:
        if token in self.ids:
            return (self.ids[token],)
        return tuple(self.bytes[b] for b in token.encode())

    def _chunk_pattern(self) -> str:
        """Cuts between character classes that no piece joins; none where a piece would join them."""
        joined: dict[str, set[str]] = {}
        for p in self.order:
            for a, b in zip(p, p[1:]):
                if b == " " and a != " ":
                    return r"(?s).+"
                if a != " ":
                    joined.setdefault(a, set()).add(b)
                    joined.setdefault(b, set()).add(a)
        marks, todo = set(), ["."]
        while todo:  # all that pieces join to a full stop, directly or not
            c = todo.pop()
            if c not in marks:
                marks.add(c)
                todo += joined.get(c, ())
        if any(c.isalpha() and c.isascii() for c in marks):
            marks = set()
        lone = {chr(i) for i in range(128) if not chr(i).isalpha() and chr(i) not in joined and chr(i) != " "}
        m = "".join(map(re.escape, sorted(marks - lone)))
        n = "".join(map(re.escape, sorted(lone)))
        some = f" *[{m}]+|" if m else ""
        return f"{some} *[^{m}{n} ]+| *[{n}]| +"

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the characters of both tokens gives these two tokens again."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[key] = a + b not in self.order and merge(list(a + b), self.order) == [a, b]
        return known

    def forget(self) -> None:
        """Drops the chunks of a part's texts: the worker lives on, and most chunks are in few texts."""
        self.known, self.unlike = _Chunks(self), {}

    def encode_chunk(self, chunk: str) -> list[int]:
        """Token numbers of a chunk whose characters all occur in the vocabulary."""
        longest = [-1] * len(chunk)
        size = self.length
        for end, token in self.matcher.iter(chunk):
            longest[end + 1 - size[token]] = token  # later ends are longer
        fits, shorter, whole = self.fits, self.shorter, len(chunk)
        failed = bytearray(whole // 8 + 1)
        done: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + size[token]
            if not failed[end >> 3] >> (end & 7) & 1:
                ok = last < 0 or fits.get(last << 20 | token)
                if ok or ok is None and self.fit(last, token):
                    done.append(token)
                    if end == whole:
                        return done
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                failed[at >> 3] |= 1 << (at & 7)
                if not done:
                    raise ValueError("no compatible sequence of tokens")
                back = done.pop()
                at -= size[back]
                last = done[-1] if done else -1
                token = shorter[back]

    def ids_of(self, chunk: str) -> list[int]:
        if self.alphabet.issuperset(chunk):
            return self._plain(chunk)
        out: list[int] = []
        for known, run in itertools.groupby(chunk, self.alphabet.__contains__):
            part = "".join(run)
            out += self._plain(part) if known else [self.bytes[b] for b in part.encode()]
        return out

    def _plain(self, chunk: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.out.__getitem__, self.encode_chunk(chunk))))

    def split(self, text: str) -> list[str]:
        """The chunks of a text behind the blank that the vocabulary's encoder puts in front."""
        return self.chunks.findall(" " + text.replace(GAP, " ")) if text else []

    def joined(self, chunks: list[str]) -> str:
        """Decimal ids of all chunks, joined by commas."""
        return ",".join(map(self.known.__getitem__, chunks))

    def decoded(self, chunks: list[str]) -> str:
        """What the chunks' ids decode to."""
        return "".join(map(self.unlike.get, chunks, chunks))[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.joined(self.split(text))
        return [int(i) for i in ids.split(",")] if ids else []

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of the ids, runs of byte ids read as UTF-8."""
        whole = [self.text_of.get(i) for i in ids]
        if None not in whole:
            return "".join(whole)
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text_of[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_pieces(ids)[1:] if ids else ""


def codec(path: str) -> PieceCodec:
    if path not in _READY:
        _READY[path] = PieceCodec(path)
    return _READY[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, text: str = "text", *, ids: bool = True) -> DataFrame:
    """Adds n_tokens, token_ids (unless ``ids`` is false), ids_sha256, decoded_sha256.

    A null text counts as empty and has no ids; both digests are then those of the empty
    string. Rows aren't compared, so repeated rows and ids are fine. Caller columns of the
    added names are replaced. ``model`` is a path that every executor can read. Texts pass
    through in Arrow batches; a batch is the only thing a task holds.
    """
    path = model or default_model()
    added = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    kept = without_names(docs, added)
    with_python(docs.sparkSession)
    more = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    schema = extended(kept, *more, *([("token_ids", "array<int>")] if ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS_AT_ONCE):  # ids take many times their text's space
                    yield encoded(own, whole.slice(start, ROWS_AT_ONCE))
        finally:
            own.forget()

    def encoded(own: PieceCodec, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, id_hash, text_hash, lists = [], [], [], []
        for value in batch.column(batch.schema.get_field_index(text)):
            chunks = own.split(value.as_py() or "")
            joined = own.joined(chunks)
            counts.append(joined.count(",") + 1 if joined else 0)
            id_hash.append(hashlib.sha256(joined.encode()).hexdigest())
            text_hash.append(hashlib.sha256(own.decoded(chunks).encode()).hexdigest())
            if ids:
                lists.append(np.array(joined.split(",") if joined else [], dtype=np.int32))
        columns = [pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
        columns += [pa.array(lists, pa.list_(pa.int32()))] if ids else []
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return kept.mapInArrow(freed_after(run), schema)
