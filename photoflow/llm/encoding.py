"""Token ids by the tokenizers library, memoised per word.

The vocabulary files state how a text is split into words before any merge is looked up, so the ids of a
text are those of its words. Distinct words are far fewer than words. Texts with characters whose classes
or cases libraries might see differently are cut at single spaces only, and the library splits the rest.
Texts that hold the string of a special token go to the library as they are.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: upper bound of a worker's cache, in words (some 170 bytes each); when full, only words met again stay
MAX_WORDS = 600_000
#: characters of the longest word that is kept
MAX_LETTERS = 64
#: new words that the library is given at once
BULK = 1000
_PLAIN = re.compile("[\n -~\xa1-\xff]*")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: the splitting rules that the vocabulary files state, for plain texts
_BYTE_LEVEL = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^\s{_L}{_N}]+")
_READY: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """encode(texts) gives the little-endian ids of every whole text as the library does with add_special_tokens=False.

    With special_as_text the string of a special token in a text is ordinary text; by default it becomes
    the special token's id, as the library has it.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.lower = self.tok.normalizer is not None
        self.cut, self.space = (_WORD_LEVEL, "") if self.lower else (_BYTE_LEVEL, " ")
        self.words: dict[str, bytes] = {}
        self.again: set[str] = set()
        tokens = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        # where one word ends, or the next begins, in the ids of many words at once
        self.mark = np.array([t.endswith("</w>") if self.lower else t.startswith("Ġ") for t in tokens])

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        kind = "H" if self.dtype == "<u2" else "I"
        return [array(kind, x.ids).tobytes() for x in found]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids): words of letters, which the rules split from each other, many in one call."""
        simple = [w for w in words if (w.isalpha() if self.lower else w[0] == " " and w[1:].isalpha())]
        chosen = set(simple)
        other = [w for w in words if w not in chosen]
        joined = ["".join(f" {w}" for w in part) if self.lower else "".join(part) for part in (simple[s : s + BULK] for s in range(0, len(simple), BULK))]
        for s, raw in zip(range(0, len(simple), BULK), self._whole(joined), strict=True):
            part, ids = simple[s : s + BULK], np.frombuffer(raw, self.dtype)
            at = np.flatnonzero(self.mark[ids])
            ends = at + 1 if self.lower else np.append(at[1:], len(ids))
            if len(ends) != len(part):
                other += part
                continue
            cuts = [0, *(ends * ids.itemsize).tolist()]
            yield from zip(part, [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True)
        yield from zip(other, self._whole(other), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and a collection would walk the whole cache
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.findall(t.lower() if self.lower else t) if self._plain(t) else None for t in texts]
        all_words = set().union(*(p for p in cut if p))
        known = all_words & self.words.keys()
        new = list(all_words - known)
        self.again |= known
        if len(self.words) + len(new) > MAX_WORDS:
            keep = self.again if len(self.again) + len(new) <= MAX_WORDS else known
            self.words, self.again = {w: self.words[w] for w in keep}, set()
        self.words.update(self._words(new))
        get = self.words.__getitem__
        out = [self._cautious(t) if p is None else b"".join(map(get, p)) for p, t in zip(cut, texts, strict=True)]
        for w in new:
            if len(w) > MAX_LETTERS:
                del self.words[w]
        return out

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _cautious(self, text: str) -> bytes:
        """Cut at single spaces between other characters, which is never within a word of either kind."""
        if any(s in text for s in self.special):
            return self._whole([text])[0]
        units = _SAFE_CUT.split(text)
        return b"".join(self._whole([units[0], *(self.space + u for u in units[1:])]))


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per worker."""
    key = (path, special_as_text)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(path, special_as_text)
    return _READY[key]


def groups(column: pa.Array, most: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with about `most` bytes together; a longer text comes alone; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, column.slice(at, end - at).to_pylist()
        at = end
