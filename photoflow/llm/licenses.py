"""License notices: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits holds at least one of k+1 pieces of it unchanged (pigeonhole). One
automaton finds the exact phrases and all pieces in a text brought to lower case and single spaces; around
each piece the regex library's bounded-error matching verifies the notice and counts its edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.llm.words import ALNUM, slices

#: words that must stand consecutively -> label
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label, notice, edits that it may have
NOTICES = [
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("apache-2", "licensed under the apache license version 2 0", 3),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by-nc", "creative commons attribution noncommercial", 3),
    ("gpl-3", "gnu general public license version 3", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("all-rights-reserved", "all rights reserved", 1),
]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[ALNUM == 0] = 32


def normal(data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Texts as lower-case words, a space before and after each; and the number of words of each."""
    word = ALNUM[data] != 0
    first = off[:-1][off[:-1] < len(data)]
    after = np.zeros(len(data), bool)  # the byte before is a word's, in the same text
    after[1:] = word[:-1]
    after[first] = False
    kept = word | after
    at = np.append(0, np.cumsum(kept))[off]
    starts = np.append(0, np.cumsum(word & ~after))[off]
    # a text that ends in a word has no space there yet
    raw = _LOWER[data[kept]].tobytes()
    out = [f" {raw[a:b].decode()}" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [t if t[-1] == " " else t + " " for t in out], np.diff(starts)


def _pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    def __init__(self, notices: list[tuple[str, str, int]], phrases: dict[str, str]):
        self.notices, self.phrases = notices, list(phrases.items())
        self.fuzzy = [regex.compile(f"(?:{regex.escape(n)}){{e<={k}}}", regex.BESTMATCH) for _, n, k in notices]
        keys: dict[str, list[tuple[int, int]]] = {}
        for i, (_, n, k) in enumerate(notices):
            for at, piece in _pieces(n, k):
                keys.setdefault(piece, []).append((i, at))
        for i, (words, _) in enumerate(self.phrases):
            keys.setdefault(f" {words} ", []).append((-1 - i, 0))
        self.find = ahocorasick.Automaton()
        for key, uses in keys.items():
            self.find.add_word(key, (len(key), uses))
        self.find.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, int, float]]]:
        """(start character, label) of the exact phrases; (start, end, label, edits, similarity) of the notices."""
        exact, spans = [], set()
        done: dict[int, int] = {}
        for end, (size, uses) in self.find.iter(text):
            start = end - size + 1
            for i, at in uses:
                if i < 0:
                    exact.append((start + 1, self.phrases[-1 - i][1]))
                    continue
                label, notice, k = self.notices[i]
                if start < done.get(i, -1):
                    continue
                lo, hi = max(0, start - at - k), start - at + len(notice) + k
                m = self.fuzzy[i].search(text, lo, min(hi, len(text)))
                if m:
                    edits = sum(m.fuzzy_counts)
                    a, b = m.start(), m.end()
                    while a < b and text[a] == " ":
                        a += 1
                    spans.add((a, b, label, edits, 1 - edits / len(notice)))
                    done[i] = m.end()
        return exact, sorted(spans)


def words_at(text: str, places: list[int]) -> dict[int, int]:
    """For each character place the number of the word there, in one pass over the text."""
    out, done, n = {}, 0, -1
    for p in sorted(set(places)):
        n += text.count(" ", done, p)
        out[p], done = n, p
    return out


SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:bigint,last_word:bigint,edits:bigint,text:string>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str, int]] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per input row: words, places of the exact phrases, labels, best similarity, and the notices' spans.

    A null text is empty: no words, no labels (empty strings), score 0, null places. Phrases of one text
    may overlap; each place counts. Ties between notices keep every label. Other columns are ignored.
    """
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for b in batches:
            for at, data, off in slices(b.column(1)):
                texts, n_words = normal(data, off)
                rows = []
                for text in texts:
                    exact, spans = scanner.scan(text)
                    word = words_at(text, [p for p, _ in exact] + [p for s in spans for p in (s[0], s[1] - 1)])
                    places = sorted(word[p] for p, _ in exact)
                    base = {x for _, x in exact}
                    rows.append((
                        len(exact), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {s[2] for s in spans})),
                        1.0 if exact else max((s[4] for s in spans), default=0.0),
                        [{"label": s[2], "first_word": word[s[0]], "last_word": word[s[1] - 1], "edits": s[3], "text": text[s[0] : s[1]]} for s in spans],
                    ))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("text", pa.string())]))]
                names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n_words), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "n_words", *names])

    return t.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
