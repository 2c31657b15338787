"""Byte-level BPE of whole texts through segments: pieces that tokenize independently.

A pre-token never holds a space after a character that isn't white, so a text may be cut
before each single space. Blocks of texts are cut and their distinct pieces found by Arrow; each distinct
piece is split into words (pre-tokens), and each distinct word encoded once. Texts with a space beside other
white space or with a possible special string stay one piece.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewright.llm.common import Interner

#: Distinct words kept and their characters, beyond which those go that one block alone had.
MAX_WORDS, MAX_CHARS = 300_000, 4_000_000
#: White space, and more than any splitting pattern takes for it.
WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Ragged:
    """A growing table of id lists, by number."""

    def __init__(self, dtype):
        self.flat, self.ends = np.empty(1 << 16, dtype), np.zeros(1, np.int64)

    def add(self, body: np.ndarray, size: np.ndarray) -> None:
        ends = self.ends[-1] + np.cumsum(size)
        if len(ends) and ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(int(ends[-1]), self.flat.dtype)])
        self.flat[self.ends[-1] : self.ends[-1] + len(body)] = body
        self.ends = np.concatenate([self.ends, ends])


class WordTable:
    """Ids of blocks of texts. encode: a word to its ids (None where others encode); find: the splitting pattern's findall; whole: a text with a special string to its ids."""

    def __init__(self, encode: Callable[[str], list[int]] | None, find: Callable[[str], list[str]], whole: Callable[[str], list[int]] | None = None, dtype=np.int32):
        self.encode, self.find, self.whole, self.dtype = encode, find, whole, dtype
        self.words, self.chars, self.word_ids, self.uses = Interner(), 0, Ragged(dtype), np.zeros(0, np.uint8)

    def clear(self) -> None:
        """Keeps the words that two blocks had, or none if these are too many."""
        stay = np.flatnonzero(self.uses > 1)
        stay = stay if 2 * len(stay) < MAX_WORDS else stay[:0]
        every, old = list(self.words), self.word_ids
        self.words, self.word_ids, self.uses = Interner(), Ragged(self.dtype), np.ones(len(stay), np.uint8)
        self.words.codes([every[k] for k in stay.tolist()])
        self.chars = sum(map(len, self.words))
        size = np.diff(old.ends)[stay]
        self.word_ids.add(old.flat[spread(old.ends[stay], size)], size)

    def learn(self, known: int) -> None:
        """Encodes the words met since there were so many."""
        fresh = list(islice(self.words, known, None))
        self.chars += sum(map(len, fresh))
        found = [self.whole(w) if self.whole and "<|" in w else self.encode(w) for w in fresh]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.word_ids.add(np.fromiter(chain.from_iterable(found), self.dtype, int(size.sum())), size)

    def split(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of pieces that a space precedes, end to end, and how many each has. Letters alone, and letters with a comma or a stop, skip the pattern."""
        pieces = pieces.cast(pa.string())
        alone = np.asarray(pc.utf8_is_alpha(pieces))
        stem = pc.utf8_slice_codeunits(pieces, 0, -1)
        comma, stop = np.asarray(pc.ends_with(pieces, ",")), np.asarray(pc.ends_with(pieces, "."))
        tailed = (comma | stop) & np.asarray(pc.utf8_is_alpha(stem))
        easy = alone | tailed
        other = [self.find(" " + p) for p in pieces.filter(pa.array(~easy)).to_pylist()]
        size = np.where(alone, 1, 2)
        size[~easy] = np.fromiter(map(len, other), np.int64, len(other))
        starts = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        stems = pc.if_else(pa.array(tailed), stem, pieces).filter(pa.array(easy))
        out[starts[easy]] = self.words.codes(pc.binary_join_element_wise(" ", stems, "").to_pylist())
        out[starts[tailed] + 1] = np.where(comma[tailed], self.words[","], self.words["."]) if tailed.any() else 0
        rest = np.flatnonzero(~easy)
        out[spread(starts[rest], size[rest])] = self.words.codes(list(chain.from_iterable(other)))
        return out, size

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, at their positions: numbers of words for distinct pieces end to end, how many each piece has, the pieces of all texts, and how many each text has."""
        column = column.fill_null("")
        whole = pc.match_substring_regex(column, f" {WHITE}|{WHITE} ")
        special = pc.match_substring(column, "<|") if self.whole else pa.array(np.zeros(len(column), bool))
        whole = pc.or_(whole, special)
        parts = pc.split_pattern(pc.if_else(whole, pa.scalar("", column.type), column), " ")
        n = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words, size = self.split(coded.dictionary)
        code = coded.indices.to_numpy().astype(np.int64)
        # no space precedes a text's first piece; a whole text is one piece
        heads = pc.if_else(whole, column, pc.list_element(parts, 0)).to_pylist()
        first = [[h] if s else self.find(h) for h, s in zip(heads, special.to_pylist(), strict=True)]
        code[np.cumsum(n) - n] = len(size) + np.arange(len(n))
        words = np.concatenate([words, self.words.codes(list(chain.from_iterable(first)))])
        size = np.concatenate([size, np.fromiter(map(len, first), np.int64, len(first))])
        return words, size, code, n

    def looked_up(self, words: np.ndarray, size: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of what numbers() gave, end to end, and where each text's begin, the total last."""
        flat, at = gather(self.word_ids.flat, self.word_ids.ends, words, size)
        return gather(flat, at, code, n)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin, the total last; null is empty."""
        if len(self.words) > MAX_WORDS or self.chars > MAX_CHARS:
            self.clear()
        known = len(self.words)
        found = self.numbers(column)
        self.learn(known)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.words) - len(self.uses), np.uint8)])
        met = np.unique(found[0])
        self.uses[met] = np.minimum(self.uses[met], 1) + 1
        return self.looked_up(*found)


def spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all stretches, end to end."""
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts - (stop - size), size)


def gather(flat: np.ndarray, ends: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry code[i] of a ragged table, for all i end to end; sizes: how many codes each text has."""
    begin, size = ends[code], np.diff(ends)[code] if len(code) else np.zeros(0, np.int64)
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total) + np.repeat(begin - (stop - size), size)
    starts = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes)])]
    return flat[at], starts
