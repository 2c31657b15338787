"""Document fingerprints by locally consistent parsing.

A text's bytes are symbols of level 0. At each level, runs of one symbol become one symbol;
deterministic coin tossing then gives each symbol a small label that depends only on it and
its few left neighbours (twice the place of the lowest bit in which it differs from the symbol before,
plus that bit, repeated until labels are below 6); a symbol whose label is a local maximum opens a phrase; and
a phrase's name, a digest of its symbols, is a symbol of the next level. Where a phrase opens depends on a
bounded neighbourhood only, so equal substrings have equal names inside, wherever they stand.

A fingerprint is a one-permutation minhash of a text's phrase names from level FIRST on, and the name
of the whole text: SLOTS values of 16 bits in hexadecimal. The likeness of two fingerprints estimates
the Dice coefficient of the phrase sets.

Null and empty texts have no phrases and the fingerprint of the empty text; two of them are wholly alike. Rows are
in descending order of doc_id, nulls last, rows of one id (or of none) by a hash of the text; each repeated row is a document of its own. A
lone document's next document is itself. An empty table gives no rows. Rows are dealt by ranges of what orders them, which is
read off the row itself, so that the rows of docs may come in another order each time; equal rows are counted before they are dealt. So
no doc_id, null or text fills a task by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import common
from tidewright.llm.suffix import bucket_of

FIRST, SLOTS = 2, 64
U = np.uint64
STEP = 0x9E3779B97F4A7C15
LEVELS = 40


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels: neighbours that differ get labels that differ. first: where a text begins."""
    left = np.empty_like(x)
    left[1:], left[:1] = x[:-1], 0
    left[first] = ~x[first]
    low = x ^ left
    low &= ~low + x.dtype.type(1)
    return (2 * np.bitwise_count(low - x.dtype.type(1)) + ((x & low) != 0)).astype(np.uint8)


def folded(name: np.ndarray, group: np.ndarray, salt: int) -> np.ndarray:
    """A digest of each group's names in order; group: where each group begins."""
    if not len(group):
        return np.zeros(0, U)
    size = np.diff(np.append(group, len(name)))
    place = np.arange(len(name), dtype=U) - np.repeat(group, size).astype(U)
    return mix(np.add.reduceat(mix(name + (place + U(1)) * U(STEP)), group) + size.astype(U) * U(0xD1342543DE82EF95) + U(salt))


def level_up(name: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and texts of the next level's symbols."""
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    if not fresh.all():  # runs
        at = np.flatnonzero(fresh)
        n = np.diff(np.append(at, len(name))).astype(U)
        name, owner = np.where(n > 1, mix(name[at] + n * U(STEP)), name[at]), owner[at]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    label = toss(name, first)
    for _ in range(3):
        label = toss(label, first)
    low = np.int8(-1)
    value = label.astype(np.int8)
    before, after = np.empty_like(value), np.empty_like(value)
    before[1:], before[0], after[:-1], after[-1] = value[:-1], low, value[1:], low
    before[first] = low
    after[first[1:] - 1] = low
    opens = (value > before) & (value > after)
    opens[first] = True
    if len(first) > 0:  # a text's second symbol may not open a phrase right after its first
        second = first + 1
        second = second[second < len(name)]
        second = second[owner[second] == owner[second - 1]]
        opens[second] = False
    group = np.flatnonzero(opens)
    return folded(name, group, level), owner[group]


def phrases(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names that count for the fingerprint, and their texts' numbers."""
    size = np.diff(starts)
    owner = np.repeat(np.arange(len(size)), size)
    name = mix(data.astype(U) + U(1))
    names, owners = [], []
    for level in range(1, LEVELS):
        if not len(name):
            break
        name, owner = level_up(name, owner, level)
        count = np.bincount(owner, minlength=len(size))
        if level >= FIRST:
            names.append(name)
            owners.append(owner)
        top = count[owner] == 1  # the whole text's name
        if level < FIRST:
            names.append(name[top])
            owners.append(owner[top])
        name, owner = name[~top], owner[~top]
    return (np.concatenate(names), np.concatenate(owners)) if names else (np.zeros(0, U), np.zeros(0, np.int64))


def sketches(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit values of each text."""
    name, owner = phrases(data, starts)
    n = len(starts) - 1
    least = np.full(n * SLOTS, ~U(0))
    if len(name):
        h = mix(name + U(STEP))
        cell = owner * SLOTS + (h & U(SLOTS - 1)).astype(np.int64)
        order = np.lexsort((h, cell))
        cell = cell[order]
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        least[cell[head]] = h[order[head]]
    least = least.reshape(n, SLOTS)
    full = least != ~U(0)
    some = full.any(axis=1)
    value = least.copy()
    for hop in range(1, SLOTS):  # an empty slot borrows from the next full one
        lack = ~full & some[:, None]
        if not lack.any():
            break
        lender = np.roll(full, -hop, axis=1)
        take = lack & (value == ~U(0)) & lender
        value[take] = mix(np.roll(least, -hop, axis=1) + U(hop))[take]
        if not ((value == ~U(0)) & some[:, None]).any():
            break
    return (mix(value) >> U(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Dice coefficient of the phrase sets, row by row."""
    jaccard = (a == b).mean(axis=1)
    return 2 * jaccard / (1 + jaccard)


def hexes(sketch: np.ndarray) -> list[str]:
    body = sketch.astype(">u2").tobytes()
    size = 2 * SLOTS
    return [body[k : k + size].hex() for k in range(0, len(body), size)]


def of_texts(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    return sketches(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hexes(sketches(*common.raw(part.column("text")))))], ["doc_id", "fingerprint"])

    return common.texts_of(docs).mapInArrow(common.freed(scan), "doc_id long, fingerprint string")


#: What orders the rows, ascending: no id, the id reversed, the text's hash. Only a row's own values, so that it has the same place each time it is read.
ORDER = ["no_id", "down", "hash"]
#: Kinds of dealt rows: a document, the one after a part's last, further copies of a document.
OWN, TAIL, COPIES = range(3)
#: Rows that the cuts between parts are taken from, about.
SAMPLE_ROWS = 50_000
#: Rows of a batch of equal ones that are written out.
OUT_ROWS = 4096


def ordered(docs: DataFrame) -> DataFrame:
    """ORDER, doc_id and text of every row."""
    base = common.texts_of(docs)
    down = F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long")))
    return base.select(F.col("doc_id").isNull().cast("long").alias("no_id"), down.alias("down"), F.xxhash64("text").alias("hash"), "doc_id", "text")


def repeats(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows, those that come first with their doc_id and text; those of them with further copies, and how many these are."""
    keys = np.stack([b.column(c).to_numpy() for c in ORDER], axis=1)
    if len(np.unique(keys, axis=0)) == len(keys):
        none = np.zeros(0, np.int64)
        return np.arange(len(keys)), none, none
    seen: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
        seen.setdefault(key, []).append(k)
    more = [(at[0], len(at) - 1) for at in seen.values() if len(at) > 1]
    return np.array([at[0] for at in seen.values()]), np.array([k for k, _ in more], np.int64), np.array([n for _, n in more], np.int64)


def with_next(docs: DataFrame) -> DataFrame:
    """part, kind, doc_id, text and n: rows dealt into parts in order, each ended by the document that follows its last (TAIL). Of equal rows that a task
    reads together one is dealt in order; the next document of the others is itself, so they are one row with their number n, in any part (COPIES)."""
    rows = ordered(docs)
    n = common.parts(docs)
    step = max(1, docs.count() // SAMPLE_ROWS)
    some = rows.select(ORDER).where(F.pmod(F.xxhash64("down", "hash"), F.lit(step)) == 0).distinct().toArrow()
    keys = np.stack([some.column(c).to_numpy() for c in ORDER], axis=1)
    keys = keys[np.lexsort(keys.T[::-1])]
    cuts = np.unique(keys[np.linspace(0, len(keys) - 1, n + 1).astype(int)[1:-1]], axis=0) if len(keys) else keys  # in the rows' order

    def part_of(b: pa.RecordBatch) -> np.ndarray:
        return bucket_of([b.column(c).to_numpy() for c in ORDER], cuts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = part_of(b)
            words = np.stack([b.column(c).to_numpy() for c in ORDER], axis=1)
            by = np.lexsort((*words.T[::-1], part))
            head = by[np.flatnonzero(np.diff(part[by], prepend=-1))]
            yield pa.RecordBatch.from_arrays([pa.array(part[head]), *(pa.array(words[head, k]) for k in range(len(ORDER)))], ["part", *ORDER])

    found = rows.select(ORDER).mapInArrow(common.freed(first), "part int, " + ", ".join(f"{c} long" for c in ORDER))
    heads = sorted((r.part, tuple(r.x)) for r in found.groupBy("part").agg(F.min(F.struct(*ORDER)).alias("x")).collect())  # a row for each part
    goes = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}  # a part's first document also closes the part before it

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "kind", "hash", "doc_id", "text", "n"]
        task = TaskContext.get().partitionId()

        def rows_at(b: pa.RecordBatch, at: np.ndarray, part: np.ndarray, kind: int, n: np.ndarray) -> pa.RecordBatch:
            some = b.take(pa.array(at))
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(at), kind, np.int32)), *(some.column(c) for c in names[2:5]), pa.array(n, pa.int64())], names)

        for number, b in enumerate(common.blocks(batches)):
            once, twice, n = repeats(b)
            one = np.ones(len(b), np.int64)
            yield rows_at(b, once, part_of(b)[once], OWN, one[once])
            if len(twice):
                yield rows_at(b, twice, (twice + 7919 * number + 104729 * task) % (len(cuts) + 1), COPIES, n)
            to = [goes.get(key) for key in zip(*(b.column(c).to_pylist() for c in ORDER), strict=True)]
            at = np.array([i for i in once.tolist() if to[i] is not None], np.int64)
            if len(at):
                yield rows_at(b, at, np.array([to[i] for i in at.tolist()]), TAIL, one[at])

    dealt = rows.mapInArrow(common.freed(deal), "part int, kind int, hash long, doc_id long, text string, n long")
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "kind", F.col("doc_id").desc_nulls_last(), "hash").select("part", "kind", "doc_id", "text", "n")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame) -> DataFrame:
    """For every row its fingerprint, its edited text's, and its likeness to that and to the next document's."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple[int, int, int]]]]:
        """Documents (doc_id, text) of about a block's size with what to compare in them: a document, the next one, and for how many rows."""
        held, size, part = [], 0, None
        copies, n_copies, much = [], [], 0
        follow = lambda rows: (rows, [(k, k + 1, 1) for k in range(len(rows) - 1)])
        apart = lambda: (copies, [(k, k, n) for k, n in enumerate(n_copies)])
        for b in batches:
            for p, kind, doc, text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                if p != part:
                    held, size, part = [], 0, p
                if kind == COPIES:
                    copies.append((doc, text))
                    n_copies.append(n)
                    much += len(text)
                    if much > common.BLOCK_BYTES // 2:
                        yield apart()
                        copies, n_copies, much = [], [], 0
                elif kind == TAIL:
                    if held:
                        yield follow([*held, (doc, text)])
                    held = []
                else:
                    held.append((doc, text))
                    size += len(text)
                    if size > common.BLOCK_BYTES // 2 and len(held) > 1:
                        yield follow(held)
                        held, size = held[-1:], len(text)
        if copies:
            yield apart()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, asked in runs_of(batches):
            texts = [t for _, t in rows]
            changed = [edited(texts[a], texts[b]) for a, b, _ in asked]
            both = of_texts([*texts, *changed])
            left, right, n = np.array(asked).T
            own, new = both[left], both[len(texts) :]
            found = pa.RecordBatch.from_arrays([
                pa.array([rows[a][0] for a in left], pa.int64()), pa.array([len(texts[a]) for a in left], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(hexes(own)), pa.array(hexes(new)), pa.array(likeness(own, new)), pa.array(likeness(own, both[right])),
            ], names)
            if (n == 1).all():
                yield found
                continue
            end = np.cumsum(n)
            for at in range(0, int(end[-1]), OUT_ROWS):
                yield found.take(pa.array(np.searchsorted(end, np.arange(at, min(at + OUT_ROWS, int(end[-1]))), "right")))

    return with_next(docs).mapInArrow(common.freed(scan), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
