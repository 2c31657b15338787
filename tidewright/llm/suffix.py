"""Repeated byte strings across documents, by a sparse suffix array.

Every string of LENGTH bytes holds an anchor: the place where the smallest hash of GRAM bytes in it
begins. Equal strings have their anchor at the same place, so only suffixes that begin at anchors are
sorted. A suffix's sort key is its leading 8 bytes, then a digest of its leading GRAM bytes, then two digests of
the neighbourhood (all LENGTH-byte strings that have this anchor) of 64 bits each and independent, then doc_id and place. Strings
count as equal if the 8 bytes and all digests agree: by chance, two different ones do so with odds of 1 to 2^128. Splitters sampled
from a bounded number of documents range-partition the keys; because doc_id and place are part of
them, a suffix that a third of the corpus shares is split over many buckets. A bucket sorts by a multikey
quicksort over the key's words and compares neighbours, and its first rows with the splitter that
closes the bucket before it, which is itself a row there:

* the neighbourhood occurs before: all its strings are repeated;
* only the leading bytes occur elsewhere too: the neighbourhood is cut into runs of RUN strings at fixed distances
  from the anchor, and the runs go through the same partitioning, sorting and comparing, with the bytes that
  all strings of a run share as leading bytes; runs that are still open are compared string by string;
* neither: none of its strings is repeated.

Repeated strings become intervals, gathered for each document and removed from its text.

Null and empty texts have nothing to remove. Rows without doc_id come after all others. Rows that share a
doc_id count as one document for what starts earlier: places are compared, and equal places are not
earlier than each other. Texts of any length are whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import common

LENGTH, GRAM, RUN = 100, 24, 8
#: Rows of a bucket, about, and documents that splitters are sampled from, at most about.
BUCKET_ROWS, SAMPLE_DOCS = 600_000, 2000
#: Bytes that a task digests at a time. A longer text is cut into pieces that overlap; neighbourhoods cut apart are merely left open.
PIECE = 1 << 20
KEY = ["w", "g", "c", "e", "doc", "place"]
#: Rows without doc_id have a doc from here on.
NAMELESS = 1 << 62
TAG_BITS, OFF_BITS, N_BITS = 16, 7, 8
LOW_BITS = TAG_BITS + OFF_BITS + N_BITS
U = np.uint64


def odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64) * U(2) + U(1)


BYTES, BASES = (odd(11, 256), odd(13, 256)), (int(odd(12, 1)[0]), int(odd(14, 1)[0]))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Rolling:
    """Digests of any stretch of the bytes, from one running sum. Those of kind 1 are independent of those of kind 0."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        n = len(data) + 1
        self.up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, BASES[kind], U)]))
        down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, pow(BASES[kind], -1, 1 << 64), U)]))
        self.sum = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[kind][data] * down[: len(data)], dtype=U)])

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.up[start])


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a signed integer of the same order."""
    out = np.zeros(len(at), U)
    for k in range(8):
        out = (out << U(8)) | data[at + k].astype(U)
    return (out ^ U(1 << 63)).view(np.int64)


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: its text's number, leading bytes, digest of GRAM bytes, two digests of the neighbourhood, the first place of the strings it stands for, their number, and how far after that place the anchor is."""
    size = np.diff(starts)
    long = np.flatnonzero(size >= LENGTH)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    roll = Rolling(data)
    first = np.arange(len(data) - GRAM + 1)
    key = (roll.digest(first, first + GRAM) & ~U(0xFFFFFFFF)) | first.astype(U)
    least, reach, want = key, 1, LENGTH - GRAM + 1
    while 2 * reach <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if want > reach:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    n = size[long] - LENGTH + 1
    stop = np.cumsum(n)
    text = np.repeat(long, n)
    p = np.arange(int(stop[-1])) + np.repeat(starts[long] - (stop - n), n)
    at = (least[p] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(new, len(p)))
    begin, at, text = p[new], at[new], text[new]
    near = mix(roll.digest(begin, begin + count - 1 + LENGTH) + (at - begin).astype(U) * U(0x9E3779B97F4A7C15) + count.astype(U))
    return text, leading(data, at), roll.digest(at, at + GRAM).view(np.int64), near.view(np.int64), Rolling(data, 1).digest(begin, begin + count - 1 + LENGTH).view(np.int64), begin - starts[text], count, at - begin


def named(docs: DataFrame, doc: str = "doc", tag: str = "tag") -> DataFrame:
    """docs with doc and tag: what identifies a row by doc_id and text in this module. A row without doc_id has a doc of its own by its text, and comes last. Texts that share a doc_id and a tag's bits are numbered instead."""
    text = F.col("text").cast("string")
    own = F.xxhash64(text, F.lit(5)).bitwiseAND(NAMELESS - 1).bitwiseOR(NAMELESS)
    out = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), own), "_full": F.xxhash64(text)})
    short = F.col("_full").bitwiseAND((1 << TAG_BITS) - 1).cast("int")
    twins = out.groupBy(doc, short.alias("_short")).agg(F.min("_full").alias("low"), F.max("_full").alias("high")).where("low != high").select(F.col(doc).alias("_twin")).distinct()
    twins = common.kept(twins, "suffix-twins")
    if not twins.limit(1).count():
        return out.withColumn(tag, short).drop("_full")
    texts = out.select(F.col(doc).alias("_twin"), F.col("_full").alias("_of")).distinct().join(twins, "_twin")
    ranks = texts.withColumn("_rank", F.row_number().over(Window.partitionBy("_twin").orderBy("_of")) - 1)
    ranks = common.kept(ranks, "suffix-ranks")
    if ranks.where(F.col("_rank") >= 1 << TAG_BITS).limit(1).count():
        raise ValueError(f"a doc_id has more than {1 << TAG_BITS} different texts")
    out = out.join(ranks, (F.col(doc) == F.col("_twin")) & (F.col("_full") == F.col("_of")), "left")
    return out.withColumn(tag, F.coalesce("_rank", short)).drop("_full", "_twin", "_of", "_rank")


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tag and text of named()."""
    return named(common.texts_of(docs)).select("doc", "tag", "text", "doc_id")


def placed(place: np.ndarray, tag: np.ndarray, off: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    return (((place << TAG_BITS) | tag.astype(np.int64)) << (OFF_BITS + N_BITS)) | (np.asarray(off) << N_BITS) | n


def pieces(data: np.ndarray, starts: np.ndarray, more: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bytes in pieces, each with its offset: all texts at once, or a long one in stretches with so many bytes more of the next."""
    if len(starts) != 2 or len(data) <= 2 * PIECE:
        yield 0, data, starts
        return
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + more]
        yield at, part, np.array([0, len(part)])


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.blocks(batches, size=PIECE):
        for at, data, starts in pieces(*common.raw(part.column("text")), LENGTH - 1):
            text, w, g, c, e, place, n, off = anchors(data, starts)
            doc, tag = part.column("doc").to_numpy()[text], part.column("tag").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w, g, c, e, doc, placed(place + at, tag, off, n))], KEY)


ROWS = "w long, g long, c long, e long, doc long, place long"


def multikey(words: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by their words: a quicksort by the first word, then each run of equal rows by the next."""
    order = np.argsort(words[0], kind="stable")
    tied = words[0][order][1:] == words[0][order][:-1]
    for word in words[1:]:
        run = np.concatenate([[False], tied]) | np.concatenate([tied, [False]])  # rows of runs longer than one
        at = np.flatnonzero(run)
        if not len(at):
            break
        number = np.cumsum(np.concatenate([[True], ~tied]))[at]
        rows = order[at]
        order[at] = rows[np.lexsort((word[rows], number))]
        tied = tied & (word[order][1:] == word[order][:-1])
    return order


def bucket_of(rows: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """How many of the splitters lie before each row."""
    if not len(cuts):
        return np.zeros(len(rows[0]), np.int32)
    low, high = np.searchsorted(cuts[:, 0], rows[0], "left"), np.searchsorted(cuts[:, 0], rows[0], "right")
    close = np.flatnonzero(low < high)
    if len(close):
        both = [np.concatenate([r[close], cuts[:, k]]) for k, r in enumerate(rows)]
        is_cut = np.concatenate([np.zeros(len(close), bool), np.ones(len(cuts), bool)])
        order = np.lexsort((is_cut, *both[::-1]))
        before = np.cumsum(is_cut[order])
        rank = np.empty(len(order), np.int64)
        rank[order] = before
        low[close] = rank[: len(close)]
    return low.astype(np.int32)


def compared(w, g, c, e, doc, place, before: np.ndarray | None, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's rows in order: which repeat an earlier row, and which share leading bytes with a row of another neighbourhood."""
    n = len(w)
    spot = place >> LOW_BITS
    gram = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
    near = gram | np.concatenate([[True], (c[1:] != c[:-1]) | (e[1:] != e[:-1])])
    first = np.maximum.accumulate(np.where(near, np.arange(n), 0))
    repeats = (doc != doc[first]) | (spot != spot[first])
    sizes = np.bincount(np.cumsum(gram) - 1, near)
    shares = (sizes > 1)[np.cumsum(gram) - 1]
    if before is not None:  # the row that closes the bucket before this one
        same = (w == before[0]) & (g == before[1])
        equal = (c == before[2]) & (e == before[3])
        shares |= same & ~equal
        repeats |= same & equal & ((doc != before[4]) | (spot != before[5] >> LOW_BITS))
    if after is not None:  # the row that closes this one: its run may go on in the next
        shares |= (w == after[0]) & (g == after[1])
    return repeats, shares & ~repeats


def neighbours(rows: DataFrame, cuts: np.ndarray, make=None) -> DataFrame:
    """Of rows, or of what make makes of their batches. kind 0: the strings at place repeat earlier ones; kind 1: they may, and must be compared one by one."""
    n = len(cuts) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(batches) if make else batches:
            pid = bucket_of([batch.column(k).to_numpy() for k in KEY], cuts)
            yield pa.RecordBatch.from_arrays([pa.array(pid), *batch.columns], ["pid", *KEY])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        pids = every.column("pid").to_numpy()
        for pid in np.unique(pids).tolist():
            cols = [every.column(k).to_numpy()[pids == pid] for k in KEY]
            order = multikey(cols)
            cols = [c[order] for c in cols]
            repeats, shares = compared(*cols, cuts[pid - 1] if pid else None, cuts[pid] if pid < len(cuts) else None)
            for kind, mask in enumerate((repeats, shares)):
                at = np.flatnonzero(mask)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(cols[4][at]), pa.array(cols[5][at])], ["kind", "doc", "place"])

    return rows.mapInArrow(common.freed(deal), f"pid int, {ROWS}").repartitionById(n, F.col("pid")).mapInArrow(common.freed(decide), "kind int, doc long, place long")


def splitters(sample: DataFrame, n: int) -> np.ndarray:
    """n - 1 rows of a bounded sample that part it evenly."""
    if n < 2:
        return np.zeros((0, len(KEY)), np.int64)
    rows = sample.select(KEY).toArrow()
    got = np.stack([rows.column(c).to_numpy() for c in KEY], axis=1).astype(np.int64)
    if not len(got):
        return got
    got = got[np.lexsort(got.T[::-1])]
    return np.unique(got[np.linspace(0, len(got) - 1, n + 1).astype(int)[1:-1]], axis=0)  # in the rows' order


def runs(data: np.ndarray, starts: np.ndarray, text: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Open neighbourhoods cut into runs: the strings whose anchor is 8 j to 8 j + 7 bytes after their beginning. text: whose neighbourhood each is."""
    count = packed & ((1 << N_BITS) - 1)
    off = (packed >> N_BITS) & ((1 << OFF_BITS) - 1)
    stop = np.cumsum(count)
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - (stop - count)[row]
    j = (off[row] - step) // RUN
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (j[1:] != j[:-1])]))[: len(row)]
    n = np.diff(np.append(new, len(row)))
    row, j, step = row[new], j[new], step[new]
    base = starts[text[row]]
    begin = base + (packed >> LOW_BITS)[row] + step
    core = begin + off[row] - step - RUN * j  # the first byte that all strings of a full run share
    roll = Rolling(data)
    g = mix(roll.digest(core, core + LENGTH - RUN + 1) + j.astype(U))
    c = mix(roll.digest(begin, begin + n - 1 + LENGTH) + (off[row] - step).astype(U) * U(0x9E3779B97F4A7C15) + n.astype(U))
    return text[row], leading(data, core), g.view(np.int64), c.view(np.int64), Rolling(data, 1).digest(begin, begin + n - 1 + LENGTH).view(np.int64), begin - base, n


def strings(data: np.ndarray, starts: np.ndarray, text: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Open runs cut into single strings."""
    count = packed & ((1 << N_BITS) - 1)
    stop = np.cumsum(count)
    row = np.repeat(np.arange(len(count)), count)
    spot = (packed >> LOW_BITS)[row] + np.arange(len(row)) - (stop - count)[row]
    at = starts[text[row]] + spot
    g, e = (Rolling(data, kind).digest(at, at + LENGTH).view(np.int64) for kind in range(2))
    return text[row], leading(data, at), g, np.zeros(len(at), np.int64), e, spot, np.ones(len(at), np.int64)


def tag_of(place: str = "place"):
    return F.shiftright(place, OFF_BITS + N_BITS).bitwiseAND((1 << TAG_BITS) - 1).cast("int").alias("tag")


def reopened(base: DataFrame, found: DataFrame, cut) -> DataFrame:
    """Rows that cut makes of what found left open, kept."""
    open_ = found.where("kind = 1").select("doc", tag_of(), "place").groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches, size=PIECE):
            lists = part.column("places")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            packed = lists.flatten().to_numpy()
            whole, every = common.raw(part.column("text"))
            for at, data, starts in pieces(whole, every, 4 * LENGTH):
                spot = packed >> LOW_BITS
                mine = (spot >= at) & (spot < at + PIECE) if len(data) < len(whole) else np.ones(len(spot), bool)
                text, w, g, c, e, spot, n = cut(data, starts, owner[mine], packed[mine] - (at << LOW_BITS))
                cols = (w, g, c, e, part.column("doc").to_numpy()[text], placed(spot + at, part.column("tag").to_numpy()[text], 0, n))
                for k in range(0, len(text), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 17)]) for x in cols], KEY)

    return common.kept(base.join(open_, ["doc", "tag"]).select("doc", "tag", "text", "places").mapInArrow(common.freed(scan), ROWS), "suffix-rows")


def decided(rows: DataFrame) -> DataFrame:
    """neighbours() of kept rows, with splitters sampled from them."""
    n_rows = rows.count()
    n = max(common.width(rows.sparkSession), -(-n_rows // BUCKET_ROWS))
    sample = rows.where(F.pmod(F.xxhash64("doc", "place"), F.lit(max(1, n_rows // 100_000))) == 0)
    return common.kept(neighbours(rows, splitters(sample, n)), "suffix-found")


def spans(rows: DataFrame) -> DataFrame:
    """doc, tag and spots: for each of the keyed rows that has any, an array of place and number of its repeated strings."""
    spark = rows.sparkSession
    base = rows.select("doc", "tag", "text")
    step = max(1, base.count() // SAMPLE_DOCS)
    sample = common.kept(base.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(step)) == 0).mapInArrow(common.freed(suffixes), ROWS), "suffix-sample")
    n_sample = sample.count()
    n = max(common.width(spark), -(-n_sample * step // BUCKET_ROWS))
    cuts = splitters(sample.where(F.pmod(F.xxhash64("doc", "place"), F.lit(-(-max(1, n_sample) // 200_000))) == 0), n)
    near = common.kept(neighbours(base, cuts, suffixes), "suffix-found")
    common.release(spark)
    some = decided(reopened(base, near, runs))
    common.release(spark)
    single = decided(reopened(base, some, strings))
    common.release(spark)
    every = near.unionByName(some).unionByName(single).where("kind = 0")
    spot = F.struct(F.shiftright("place", LOW_BITS).alias("at"), F.col("place").bitwiseAND((1 << N_BITS) - 1).alias("n"))
    return every.select("doc", tag_of(), spot.alias("spot")).groupBy("doc", "tag").agg(F.collect_list("spot").alias("spots"))


def covered(n_bytes: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which bytes the strings at the places cover."""
    step = np.zeros(n_bytes + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n - 1 + LENGTH, -1)
    return np.cumsum(step)[:-1] > 0


def cut_rows(texts: pa.Array, lists: pa.Array, whole_characters: bool) -> list[tuple[int, int, int, bytes]]:
    """Bytes, removed bytes, removed runs and what is left, of each text."""
    out = []
    size = np.asarray(pc.list_value_length(lists).fill_null(0))
    ends = np.cumsum(size)
    flat = lists.flatten()
    at, n = (flat.field(k).to_numpy() for k in (0, 1))
    for text, a, b in zip(texts.to_pylist(), ends - size, ends, strict=True):
        raw = (text or "").encode()
        if a == b:
            out.append((len(raw), 0, 0, raw))
            continue
        body = np.frombuffer(raw, np.uint8)
        gone = covered(len(raw), at[a:b], n[a:b])
        if whole_characters:
            lead = np.flatnonzero((body & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(raw))))
        starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), starts, body[~gone].tobytes()))
    return out


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row."""
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            cols = zip(*cut_rows(part.column("text"), part.column("spots"), False), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.binary()), strict=True))], names)

    rows = keyed(docs)
    base = rows.join(spans(rows), ["doc", "tag"], "left").select(F.col("doc_id").alias("doc"), "text", "spots")
    done = base.mapInArrow(common.freed(scan), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.col("doc").alias("doc_id"), *names[1:])


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of text, but no part of a character; n_chars, if there, follows. Other columns stay, and a null text stays null."""
    own = docs.columns
    rows = named(docs, "_doc", "_tag")
    keys = rows.select(F.col("_doc").alias("doc"), F.col("_tag").alias("tag"), F.col("text").cast("string").alias("text"))
    spots = spans(keys).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("spots").alias("_spots"))
    laid = rows.join(spots, ["_doc", "_tag"], "left").select(*own, "_spots")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            old = part.column("text")
            left = [r[3].decode() for r in cut_rows(old, part.column("_spots"), True)]
            text = pc.if_else(old.is_null(), pa.scalar(None, pa.string()), pa.array(left, pa.string()))
            yield pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in own], own)

    out = laid.mapInArrow(common.freed(scan), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out
