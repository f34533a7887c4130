"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Every byte of the vocabulary becomes one character, a token a piece with the negative rank as its score, and
nothing is normalised. The model then merges the pair of highest score first, the leftmost of equal ones,
which is the order of the ranks. A text is split by the rank file's pattern and each match encoded alone;
decoding maps ids to pieces and their characters back to bytes.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from photoflow.llm.encoding import groups

#: the character of byte b is chr(FIRST + b): letters, of which none is white space or special to the model
FIRST = 0x100
#: bound of a worker's cache in matches, and characters of the longest that is kept
MAX_WORDS, MAX_LETTERS = 500_000, 64
#: characters from which a text is matched piece by piece, and matches of a piece
LONG, PIECE = 1 << 20, 1 << 16
#: bytes from which a match is cut where no token reaches across
LONG_MATCH = 4096
#: the model format's field numbers and values (fixed by it): a message's fields, the kind of an unknown piece, BPE
PIECES, TRAINER, NORMALIZER, STRING, SCORE, KIND, UNKNOWN, MODEL_TYPE, BPE = 1, 2, 3, 1, 2, 3, 2, 3, 2
ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 3, 4, 5

_READY: dict[tuple[str, str], "ByteBPE"] = {}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, content: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _score(value: float) -> bytes:
    return _varint(SCORE << 3 | 5) + struct.pack("<f", value)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def as_characters(raw: bytes) -> str:
    """One character for each byte."""
    return (np.frombuffer(raw, np.uint8).astype("<u2") + FIRST).tobytes().decode("utf-16-le")


def as_bytes(characters: str) -> bytes:
    """The bytes of which as_characters made these."""
    return (np.frombuffer(characters.encode("utf-16-le"), "<u2") - FIRST).astype(np.uint8).tobytes()


def serialize(tokens: list[bytes], ranks: list[int]) -> bytes:
    """A sentencepiece BPE model whose piece i is tokens[i]; the unknown piece, which nothing meets, comes last."""
    pieces = [_message(PIECES, _message(STRING, as_characters(t).encode()) + _score(-r)) for t, r in zip(tokens, ranks, strict=True)]
    unknown = _message(PIECES, _message(STRING, b"<unk>") + _score(0) + _number(KIND, UNKNOWN))
    identity = _message(STRING, b"identity") + _number(ADD_DUMMY_PREFIX, 0) + _number(REMOVE_EXTRA_WHITESPACES, 0) + _number(ESCAPE_WHITESPACES, 0)
    return b"".join([*pieces, unknown, _message(TRAINER, _number(MODEL_TYPE, BPE)), _message(NORMALIZER, identity)])


#: texts whose classes all libraries agree on, and their letters and digits
_PLAIN = re.compile("[\n -~\xa1-\xff]*")
_LETTERS, _DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_CLASSES = {"[^\\s\\p{L}\\p{N}]": f"[^\\s{_LETTERS}{_DIGITS}]", "\\p{L}": f"[{_LETTERS}]", "\\p{N}": f"[{_DIGITS}]"}


class Matcher:
    """The matches of a pattern in a text, letters and digits being what the rank files' own library takes for them.

    Two libraries may follow different versions of Unicode. A character that they class differently is
    replaced, for matching only, by one that both see as the rank file's library sees the first. A pattern
    without other classes than those of _CLASSES has a quicker form for plain texts.
    """

    #: characters that both see as letters, digits and neither, none of them part of a word that a pattern names
    STANDS = {"\\p{L}": "Z", "\\p{N}": "7", None: "\ue000"}

    def __init__(self, pattern: str):
        import regex

        self.found = regex.compile(pattern)
        self.differs = _differing()
        for kind, plain in _CLASSES.items():
            pattern = pattern.replace(kind, plain)
        self.plain = None if "\\p" in pattern else re.compile(pattern)

    def _same_length(self, text: str) -> str:
        odd = set(text) & self.differs.keys() if not text.isascii() else ()
        return text.translate({ord(c): self.STANDS[self.differs[c]] for c in odd}) if odd else text

    def __call__(self, text: str) -> Iterator[list[str]]:
        """Lists of matches, in order; a long text's come in several."""
        if self.plain and len(text) < LONG and _PLAIN.fullmatch(text):
            yield self.plain.findall(text)
            return
        seen = self._same_length(text)
        if seen is text and len(text) < LONG:
            yield self.found.findall(text)
            return
        matches = self.found.finditer(seen)
        while part := [text[m.start() : m.end()] for m in islice(matches, PIECE)]:
            yield part


_DIFFERING: dict[str, str | None] = {}


def _differing() -> dict[str, str | None]:
    """Characters that the libraries class differently, with the class (or none) that tiktoken sees; once for each worker."""
    if not _DIFFERING:
        import regex
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        theirs = {}
        for kind in ("\\p{L}", "\\p{N}"):
            library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
            theirs |= dict.fromkeys(library.decode(library.encode_ordinary(every)), kind)
        ours = {c: kind for kind in ("\\p{L}", "\\p{N}") for c in regex.findall(kind, every)}
        _DIFFERING.update({c: theirs.get(c) for c in ours.keys() | theirs.keys() if ours.get(c) != theirs.get(c)})
        _DIFFERING.setdefault("", None)  # stands for itself
    return _DIFFERING


class ByteBPE:
    """encode(text) and decode(ids) by the ranks of a file, whose pattern splits a text before any merge."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        order = [self.ranks[t] for t in self.tokens]
        self.rank = np.array(order, np.int32)
        self.model = SentencePieceProcessor(model_proto=serialize(self.tokens, order))
        self.piece = {r: as_bytes(self.model.id_to_piece(i)) for i, r in enumerate(order)}
        self.match = Matcher(pattern)
        self.words: dict[str, bytes] = {}
        # pairs of neighbouring bytes that some token holds: no merge reaches across any other
        self.inside = np.zeros(1 << 16, bool)
        for t in self.tokens:
            self.inside[[a << 8 | b for a, b in zip(t, t[1:], strict=False)]] = True

    def _parts(self, raw: bytes) -> list[int]:
        """Lengths of the parts of a match between which no merge reaches."""
        if len(raw) < LONG_MATCH:
            return [len(raw)]
        b = np.frombuffer(raw, np.uint8).astype(np.uint16)
        return np.diff([0, *(np.flatnonzero(~self.inside[b[:-1] << 8 | b[1:]]) + 1).tolist(), len(raw)]).tolist()

    def _new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(match, little-endian 32-bit ids): of a whole token its rank, else of what the model merges."""
        merged, raws, sizes = [], [], []
        for w in words:
            raw = w.encode()
            if raw in self.ranks:
                yield w, struct.pack("<i", self.ranks[raw])
            else:
                parts = self._parts(raw)
                merged.append((w, len(parts)))
                raws.append(raw)
                sizes += parts
        characters, ends = as_characters(b"".join(raws)), np.cumsum([0, *sizes]).tolist()
        answers = self.model.encode([characters[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], num_threads=1)
        ids = self.rank[np.fromiter(chain.from_iterable(answers), np.int64)].astype("<i4").tobytes()
        ends = np.cumsum([0, *map(len, answers)])[np.cumsum([0, *(n for _, n in merged)])] * 4
        yield from ((w, ids[i:j]) for (w, _), i, j in zip(merged, ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def _learn(self, matches: set[str]) -> list[str]:
        """Put the ids of all matches into the cache; returns those that are too long to stay in it."""
        new = [w for w in matches if w not in self.words]
        if len(self.words) + len(new) > MAX_WORDS:
            self.words = {w: self.words[w] for w in matches if w in self.words}
        self.words.update(self._new(new))
        return [w for w in new if len(w) > MAX_LETTERS]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every whole text."""
        short = [list(chain(*self.match(t))) if len(t) < LONG else None for t in texts]
        out: list[np.ndarray] = []
        long = self._learn(set().union(*(m for m in short if m)))
        raw = [b"".join(map(self.words.__getitem__, m)) if m is not None else None for m in short]
        for t, ids in zip(texts, raw, strict=True):
            if ids is None:
                parts = []
                for matches in self.match(t):
                    long += self._learn(set(matches))
                    parts.append(b"".join(map(self.words.__getitem__, matches)))
                ids = b"".join(parts)
            out.append(np.frombuffer(ids, "<i4"))
        for w in long:
            self.words.pop(w, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


def coder(path: str, pattern: str) -> ByteBPE:
    """One for each worker."""
    if (path, pattern) not in _READY:
        _READY.clear()
        _READY[path, pattern] = ByteBPE(path, pattern)
    return _READY[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs without text_col, with the token ids (array of int) of every whole text instead.

    A null text counts as empty and has no ids. Texts are not shuffled. A column of docs that has the name
    ids_col is refused; repeated rows, null ids and any other columns pass as they are. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != text_col]
    if ids_col in kept:
        raise ValueError(f"docs already has a column {ids_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and a collection would walk the whole cache
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            rest = batch.select(list(range(1, batch.num_columns)))
            for at, texts in groups(batch.column(0)):
                found = bpe.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*rest.slice(at, len(texts)).columns, ids], names=[*kept, ids_col])

    own = docs.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in kept])
    return own.mapInArrow(run, StructType([*own.schema.fields[1:], StructField(ids_col, ArrayType(IntegerType()))]))


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """tokens with the bytes that its ids stand for, by the inverse mapping; null ids give null, an unknown id is an error."""
    if bytes_col in tokens.columns:
        raise ValueError(f"tokens already has a column {bytes_col}")
    names = [*tokens.columns, bytes_col]
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(place)
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                lists = (ids[k] for k in range(s, s + part.num_rows))
                made = [bpe.decode(x.values.to_pylist() if x.values is not None else []) if x.is_valid else None for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=names)

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(bytes_col, BinaryType())]))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, the number of its ids, and the sha256 of their decimal digits and of what they decode to."""
    tokens = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern), ranks_path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
