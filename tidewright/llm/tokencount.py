"""Token counts without tokenizing: a byte-level BPE compiled to deterministic transducers.

Two machines run in cascade. The first reads character classes and marks the bytes at
which a pre-token begins (the splitting pattern of byte-level BPE needs one character of
look-ahead and a short memory for contractions). The second reads bytes; its transitions
carry the change in the number of tokens emitted for the pre-token so far. A state holds
every position at which a vocabulary entry may still be under way, with the last token of
the encoding up to there, which is all that later bytes can depend on. States and
transitions are compiled when first needed and kept for the life of the worker.

A text is cut into chunks of equal length, run side by side. A chunk maps the state at its
entry to the state at its exit and a count. After the first pre-token boundary inside a chunk
that map is constant, so the maps are composed by a prefix scan: the last constant map to the
left gives the entry state, and only the bytes before the first boundary are run from it.

Nulls and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; texts of
any length are chunked alike; special strings count as one token, as the library's default.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import common
from tidewright.llm.segments import byte_letters

CHUNK = 256
#: States kept before the compiled tables are dropped and begun anew.
MAX_STATES = 300_000
LETTER, NUMBER, OTHER, WHITE, SPACE = range(5)
#: The contractions that the splitting pattern treats as pre-tokens.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[32] = SPACE
    return out


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte, whether a pre-token begins there. starts: where the texts begin, ascending, the total last."""
    flags = np.zeros(len(data), bool)
    if not len(data):
        return flags
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind = char_classes()[code]
    first = np.zeros(len(code) + 1, bool)  # a text begins at this character
    inner = starts[:-1][starts[:-1] < len(data)]
    first[np.searchsorted(lead, inner)] = True
    first[-1] = True
    white = kind >= WHITE
    before, was = np.empty_like(kind), np.empty_like(white)
    before[0], before[1:] = OTHER, kind[:-1]
    was[0], was[1:] = False, white[:-1]
    to_come = np.empty_like(white)  # a character that isn't white follows in the same text
    to_come[:-1] = ~white[1:] & ~first[1:-1]
    to_come[-1] = False
    at = np.where(white, ~was | to_come, np.where(was, before != SPACE, kind != before)) | first[:-1]
    quote = np.flatnonzero(code == 39)
    if len(quote):
        opens = first[quote] | np.isin(before[quote], (LETTER, NUMBER, WHITE))
        quote = quote[opens]
        padded = np.concatenate([code, np.zeros(3, np.uint32)])
        ends = np.concatenate([first, np.ones(3, bool)])
        for tail in CONTRACTIONS:
            hit = np.ones(len(quote), bool)
            for k, c in enumerate(tail, 1):
                hit &= (padded[quote + k] == ord(c)) & ~ends[quote + k]
            q = quote[hit]
            at[q + 1] = False
            after = q + len(tail) + 1
            after = after[after < len(code)]
            after = after[kind[after] == LETTER]
            at[after] = True
    flags[lead[at]] = True
    return flags


class Transducer:
    """The byte machine, compiled lazily. State 0 is the start of a pre-token."""

    def __init__(self, path: str):
        tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        self.model = tok.model
        self.shown = byte_letters()
        back = {c: b for b, c in self.shown.items()}
        self.entry: dict[bytes, int] = {}
        for word, i in tok.get_vocab(with_added_tokens=False).items():
            if all(c in back for c in word):
                self.entry[bytes(back[c] for c in word)] = i
        for s in self.special:
            self.entry.pop(s, None)
        self.content = {i: w for w, i in self.entry.items()}
        self.live = {w[:k] for w in self.entry for k in range(1, len(w) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(b"", ((0, -1, 0),))]
        self.index = {self.states[0]: 0}
        self.symbol = np.full(256, -1, np.int16)  # only bytes that occur get a column
        self.byte: list[int] = []
        self.next = np.full((1024, 64), -1, np.int32)  # 16 times the next state, plus 8 more than the change in count

    def pair(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        key = (left, right)
        if key not in self.pairs:
            text = "".join(self.shown[b] for b in (self.content[left] if left >= 0 else b"") + self.content[right])
            self.pairs[key] = [t.id for t in self.model.tokenize(text)] == ([left, right] if left >= 0 else [right])
        return self.pairs[key]

    def symbols(self, data: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(data, minlength=256) * (self.symbol < 0)).tolist():
            self.symbol[b] = len(self.byte)
            self.byte.append(b)
            if len(self.byte) > self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full((len(self.next), 32), -1, np.int32)], axis=1)
        return self.symbol[data]

    def compile(self, state: int, symbol: int) -> None:
        tail, open_at = self.states[state]
        tail += bytes([self.byte[symbol]])
        held, last, gain = [], None, 0
        for size, before, count in open_at:
            piece = tail[len(tail) - size - 1 :]
            if piece in self.live:
                held.append((size + 1, before, count))
            if last is None and (t := self.entry.get(piece)) is not None and self.pair(before, t):
                last, gain = t, count + 1
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        now = tuple((size, before, count - gain) for size, before, count in held) + ((0, last, 0),)
        key = (tail[len(tail) - now[0][0] :], now)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
            if to == len(self.next):
                self.next = np.concatenate([self.next, np.full((max(1024, len(self.next) // 4), self.next.shape[1]), -1, np.int32)])
        if not -8 <= gain < 8:  # what four bits hold
            raise ValueError(f"the vocabulary changes a count by {gain} at one byte")
        self.next[state, symbol] = to * 16 + gain + 8

    def run(self, data: np.ndarray, flags: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of the stretches [start, end) of symbols, run side by side."""
        order = np.argsort(start - end, kind="stable")
        start, size, state = start[order], (end - start)[order], entry[order].astype(np.int32)
        count = np.zeros(len(start), np.int32)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        for k, n in enumerate(active):
            at = start[:n] + k
            symbol = data[at]
            now = np.where(flags[at], 0, state[:n])
            to = self.next[now, symbol]
            if to.min() < 0:
                lost = np.unique(now[to < 0].astype(np.int64) * 256 + symbol[to < 0])
                for key in lost.tolist():
                    self.compile(key >> 8, key & 255)
                to = self.next[now, symbol]
            count[:n] += (to & 15) - 8
            state[:n] = to >> 4
        out, total = np.empty_like(state), np.empty_like(count)
        out[order], total[order] = state, count
        return out, total

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each text [starts[i], starts[i + 1])."""
        if len(self.states) > MAX_STATES:
            self.reset()
        flags = boundaries(data, starts)
        data = self.symbols(data)
        size = np.diff(starts)
        pieces = -(-size // CHUNK)
        text = np.repeat(np.arange(len(size)), pieces)
        if not len(text):
            return np.zeros(len(size), np.int64)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[text] + nth * CHUNK
        end = np.minimum(begin + CHUNK, starts[text + 1])
        cuts = np.flatnonzero(flags)
        first = np.append(cuts, len(data))[np.searchsorted(cuts, begin)]
        fixed = first < end  # the chunk's map is constant
        exits = np.zeros(len(text), np.int32)
        total = np.zeros(len(text), np.int64)
        own = np.flatnonzero(fixed)
        exits[own], total[own] = self.run(data, flags, first[own], end[own], np.zeros(len(own), np.int32))
        # scan: the nearest constant map to the left; from there the other chunks in between are applied in turn
        source = np.maximum.accumulate(np.where(fixed, np.arange(len(text)), -1))
        head = np.flatnonzero(first > begin)
        hops = head - source[head - 1]
        for hop in range(1, int(hops.max(initial=0)) + 1):
            now = head[hops == hop]
            state, n = self.run(data, flags, begin[now], np.minimum(first[now], end[now]), exits[now - 1])
            total[now] += n
            loose = now[~fixed[now]]
            exits[loose] = state[~fixed[now]]
        return np.bincount(text, total, len(size)).astype(np.int64)


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(column: pa.Array, machine: Transducer) -> np.ndarray:
    """Tokens of each text; a special string is one token and parts the text around it."""
    data, starts = common.raw(column)
    whole = data.tobytes()
    found = sorted((m.start(), m.end()) for s in machine.special for m in regex.finditer(regex.escape(s), whole)) if any(s in whole for s in machine.special) else []
    if not found:
        return machine.counts(data, starts)
    found = [(a, b) for a, b in found if np.searchsorted(starts, a, "right") == np.searchsorted(starts, b - 1, "right")]
    keep = np.ones(len(data), bool)
    for a, b in found:
        keep[a:b] = False
    gone = np.concatenate([[0], np.cumsum(~keep)])
    cut = np.array([a for a, _ in found], np.int64)
    places = np.concatenate([starts[:-1], cut])
    owner = np.concatenate([np.arange(len(starts) - 1), np.searchsorted(starts, cut, "right") - 1])
    order = np.lexsort((np.concatenate([np.zeros(len(starts) - 1), np.ones(len(cut))]), places, owner))
    places, owner = places[order] - gone[places[order]], owner[order]
    n = machine.counts(data[keep], np.append(places, int(keep.sum())))
    out = np.bincount(owner, n, len(starts) - 1).astype(np.int64)
    return out + np.bincount(owner, minlength=len(starts) - 1) - 1


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs; no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part in common.blocks(batches):
            n_bytes = np.diff(np.concatenate([[0], common.text_ends(part.column("text"))]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes), pa.array(count_tokens(part.column("text"), machine))], ["doc_id", "n_bytes", "n_tokens"])

    out = common.texts_of(docs).mapInArrow(common.freed(scan), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
