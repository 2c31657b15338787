"""SimHash near-duplicates, exact within a Hamming radius.

Fingerprints are first reduced to distinct values. Two values within the radius agree on some
choice of blocks of bits (pigeonhole), so values are dealt by the bits of each choice and only
values dealt together are compared: in tiles, by exclusive-or and bit counts in numpy, passing over
tiles whose population counts differ by more than the radius. A task returns a spanning forest of its links,
never all pairs. Links are then contracted by alternating stars, each round written to the shared folder.

A group of values dealt together that is larger than a task's part is compared in two rounds. First it is salted into
parts, each with the group's leader, and compared part by part. Then whatever isn't connected to the group's largest
component is compared with all others. Inside that component nothing is left to find, so where a
group holds together around its leader, the work grows with its size and not with the square.

Near copies by five-word shingles need a radius too wide for blocks of bits. There, fingerprints of 256 bits are dealt by BANDS
digests of ROWS minimal hashes each: two sets of a Jaccard coefficient of 0.8 share a deal but for a chance of (1 - 0.8^5)^28, 1.5 in
100 000, and for less above. Fingerprints within the radius propose groups; within each, a link holds if the
Jaccard coefficient of the two sets of shingles, which is computed, is JACCARD or more.

Texts with no word (null and empty ones too) have fingerprint zero and are linked like any other.
Repeated rows get the same result each; a doc_id with several texts belongs to several components. Rows without doc_id get
the component of the others that have their fingerprint, or null; by themselves they connect nothing. Of near copies, the row with the
smallest doc_id stays (rows without one come last), and of a row repeated as it is, one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import common

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Values compared by one task at most, and rows of a tile.
PART, TILE = 8192, 512
#: Sets of five-word shingles of a Jaccard coefficient of 0.8 differ in 15 % of the bits on average: 39 of 256, with a deviation
#: of 6 (at worst, of four shingles against five, 48 and 6). The radius is four deviations over that.
NEAR = {"k": 5, "radius": 72, "width": 4}
#: Deals of a set of shingles, and minimal hashes that each is a digest of.
BANDS, ROWS = 28, 5
#: Least Jaccard coefficient of near copies, as a fraction. Sets of under LEAST shingles reach it by equality alone.
JACCARD, LEAST = (4, 5), 4
#: Sets of a proposed group that a task checks at most, twice.
GROUP_PART = 1024
#: Values that a task begins from one by one, before it compares what is left in tiles.
SEEDS = 8
U = np.uint64
TIMES = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * U(2) + U(1)


def shingles(text: bytes, k: int) -> list[bytes]:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if len(words) > k:
        return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    return [b" ".join(words)] if words else []


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    grams = set(shingles(text, k))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def set_fingerprint(hashes: np.ndarray, width: int) -> list[int]:
    """width signed 64-bit words of a set of shingles."""
    return [majority((mix(hashes + U(i)) if i else hashes).astype(">u8")) for i in range(width)]


def deals_of(hashes: np.ndarray) -> np.ndarray:
    """BANDS digests of the least values that ROWS multiples of the hashes have."""
    least = np.full(BANDS * ROWS, ~U(0))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096] * TIMES).min(axis=1))
    least = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * U(0xD1342543DE82EF95) + mix(least[:, k] + U(k + 1)))
    return out.view(np.int64)


def fingerprint(text: bytes, k: int = SHINGLE, width: int = 1) -> list[int]:
    """width signed 64-bit words of all shingles."""
    grams = shingles(text, k)
    if not grams:
        return [0] * width
    return [majority(np.fromiter((xxhash.xxh64_intdigest(g, SEED + i) for g in grams), ">u8", len(grams))) for i in range(width)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32768):
        part = hashes[at : at + 32768].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, width: int = 1) -> DataFrame:
    """doc_id and fp, an array of width 64-bit words, of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            fp = [fingerprint((t or "").encode(), k, width) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.list_(pa.int64()))], ["doc_id", "fp"])

    return common.texts_of(docs).mapInArrow(common.freed(scan), "doc_id long, fp array<long>")


def choices(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The choices of blocks, as (first bit, bits): more and longer keys for more values, so that deals stay small."""
    blocks = radius + 1 + (n > 1 << 22) + (n > 1 << 31)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = list(zip(edges, np.diff(edges).tolist(), strict=False))
    return [list(c) for c in combinations(spans, blocks - radius)]


def near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of words) within the radius: three words of all pairs, then the others of those still open."""
    d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    for w in range(1, min(3, x.shape[1])):
        d += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
    p, q = np.nonzero(d <= radius)
    if x.shape[1] > 3 and len(p):
        ok = d[p, q] + np.bitwise_count(x[p, 3:] ^ y[q, 3:]).sum(axis=1) <= radius
        p, q = p[ok], q[ok]
    return p, q


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted) have a Jaccard coefficient of JACCARD or more."""
    low, high = sorted((len(x), len(y)))
    if low * JACCARD[1] < high * JACCARD[0]:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common_ = int((both[1:] == both[:-1]).sum())
    return common_ * JACCARD[1] >= (low + high - common_) * JACCARD[0]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, sets: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within left, or between left and right (rows of words): indices into both end to end. With sets, links are those of sets alike."""
    value = left if right is None else np.concatenate([left, right])
    weight = np.bitwise_count(value).sum(axis=1).astype(int)
    order = np.argsort(weight, kind="stable")
    rest = [order] if right is None else [order[order < len(left)], order[order >= len(left)]]  # by weight
    a, b = [], []

    def reached(front: np.ndarray, side: int) -> np.ndarray:
        """What of a side's rest is linked to a tile of values; it leaves the rest."""
        known = weight[rest[side]]
        low, high = np.searchsorted(known, weight[front].min() - radius, "left"), np.searchsorted(known, weight[front].max() + radius, "right")
        gone = np.zeros(len(rest[side]), bool)
        for k in range(int(low), int(high), TILE):
            tile = rest[side][k : min(k + TILE, int(high))]
            p, q = near(value[front], value[tile], radius)
            if sets is None:
                q, first = np.unique(q, return_index=True)
                pairs = zip(front[p[first]].tolist(), q.tolist(), strict=True)
            else:
                pairs = zip(front[p].tolist(), q.tolist(), strict=True)
            for i, j in pairs:
                if not gone[k + j] and (sets is None or alike(sets[i], sets[tile[j]])):
                    gone[k + j] = True
                    a.append(i)
                    b.append(int(tile[j]))
        out, rest[side] = rest[side][gone], rest[side][~gone]
        return out

    for _ in range(SEEDS):  # whole components, from a few values
        if any(len(x) < (2 if right is None else 1) for x in rest):
            break
        at = len(rest[0]) // 2
        queue, rest[0] = [(rest[0][at : at + 1], 0)], np.delete(rest[0], at)
        while queue:
            front, side = queue.pop()
            other = 0 if right is None else 1 - side
            found = reached(front, other)
            queue += [(found[k : k + TILE], other) for k in range(0, len(found), TILE)]
    tiles = [[x[i : i + TILE] for i in range(0, len(x), TILE)] for x in (rest[0], rest[-1])]
    ones = [[weight[t[[0, -1]]] for t in ts] for ts in tiles]
    root = np.arange(len(value))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(tiles[0]):
        for j, y in enumerate(tiles[1]):
            if right is None and j < i or max(ones[1][j][0] - ones[0][i][1], ones[0][i][0] - ones[1][j][1]) > radius:
                continue
            p, q = near(value[x], value[y], radius)
            p, q = x[p], y[q]
            new = root[p] != root[q]
            if not new.any():
                continue
            ends = np.stack([p[new], q[new]], axis=1)
            for i_, j_ in (np.unique(root[ends], axis=0) if sets is None else ends).tolist():
                u, v = find(i_), find(j_)
                if u != v and (sets is None or alike(sets[i_], sets[j_])):
                    root[max(u, v)] = min(u, v)
                    a.append(u)
                    b.append(v)
            while (root[root] != root).any():
                root = root[root]
    return np.array(a, np.int64), np.array(b, np.int64)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with every node linked to its component's first, so that few rounds contract them."""
    low = np.arange(n)
    while len(a):
        both = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, both)
        np.minimum.at(new, b, both)
        np.minimum.at(new, low[a], both)
        np.minimum.at(new, low[b], both)
        new = new[new]
        if (new == low).all():
            break
        low = new
    to = np.flatnonzero(low != np.arange(n))
    return to, low[to]


TASK = ["g", "kind", "i", "j"]


def compared(tasks: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of node found by the tasks: rows (TASK, mine, node, fp and maybe grams). A task of kind 0 or with i = j compares its rows with each other, else those that are mine with the others."""
    some = "grams" in tasks.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            both = pa.Table.from_batches(rows)
            order = np.argsort(~np.asarray(both.column("mine")), kind="stable")
            cut = int(np.asarray(both.column("mine")).sum())
            node = both.column("node").to_numpy()[order]
            fp = pc.list_flatten(both.column("fp")).to_numpy().view(np.uint64).reshape(len(node), -1)[order]
            sets = None
            if some:
                held = both.column("grams").to_pylist()
                sets = [np.frombuffer(held[k], np.uint64) for k in order.tolist()]
            alone = at[1] == 0 or at[1] == 1 and at[2] == at[3]
            a, b = stars(len(node), *(forest(fp, None, radius, sets) if alone else forest(fp[:cut], fp[cut:], radius, sets)))
            return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])

        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in TASK], axis=1)
            cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist(), len(cols)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if at is not None and at != tuple(cols[s]):
                    if (found := flush(held)).num_rows:
                        yield found
                    held = []
                at = tuple(cols[s].tolist())
                held.append(batch.slice(s, e - s))
        if held:
            yield flush(held)

    dealt = tasks.repartition(common.width(tasks.sparkSession), *TASK).sortWithinPartitions(*TASK)
    return dealt.mapInArrow(common.freed(compare), "a long, b long").distinct()


def within(members: DataFrame, radius: int, most: int) -> DataFrame:
    """Pairs (a, b) of node that connect the members (g, node, fp and maybe grams) of each group g as all their links do. A group of over most members takes two rounds."""
    body = [c for c in members.columns if c not in ("g", "node")]
    size = members.groupBy("g").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    size = size.withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    whole = members.join(size, "g")
    salt = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    parts = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(salt(F.col("parts"))))
    first = whole.select("g", F.lit(0).alias("kind"), F.explode(parts).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("mine"), "node", *body)
    near_ = common.kept(compared(first, radius), "links")
    large = common.kept(size.where("parts > 1").select("g"), "large")
    if not large.limit(1).count():
        return near_
    labels = members.join(large, "g").join(components(near_), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    labels = common.kept(labels, "labels")
    main = labels.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("all"))
    main = main.select("g", F.col("x.label").alias("main"), F.ceil(F.col("x.n") / most).cast("int").alias("inside"), F.ceil((F.col("all") - F.col("x.n")) / most).cast("int").alias("outside")).where("outside > 0")
    open_ = labels.join(main, "g").withColumn("out", F.col("label") != F.col("main"))
    open_ = open_.withColumn("own", F.when(F.col("out"), salt(F.col("outside"))).otherwise(salt(F.col("inside"))))
    task = lambda kind, i, j, mine: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), mine.alias("mine"))
    own, until = F.col("own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outer = F.concat(F.transform(until("outside"), lambda j: task(1, F.least(own, j), F.greatest(own, j), own <= j)), F.transform(until("inside"), lambda j: task(2, own, j, F.lit(True))))
    inner = F.transform(until("outside"), lambda i: task(2, i, own, F.lit(False)))
    second = open_.select("g", F.explode(F.when(F.col("out"), outer).otherwise(inner)).alias("t"), "node", *body).select("g", "t.*", "node", *body)
    return near_.unionByName(compared(second, radius)).distinct()


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of node that connect all values (node, fp; fp distinct) within the radius of each other."""
    n = values.count()
    keys = []
    for t, spans in enumerate(choices(n, radius)):
        key: Column = F.lit(0).cast("long")
        for first, bits in spans:
            key = key.bitwiseXOR(F.shiftleft(F.shiftrightunsigned(F.col("fp")[0], first).bitwiseAND((1 << bits) - 1), first))
        keys.append(F.xxhash64(F.lit(t), key))
    dealt = common.kept(values.select(F.explode(F.array(*keys)).alias("g"), "node", "fp"), "deals")
    return within(dealt, radius, PART)


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that can be reached, for every node of an edge but the roots."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        low = pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined = pairs.join(low, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        moved = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("low")), F.struct(F.col("b").alias("a"), F.col("low")))).alias("x")).select(F.col("x.a").alias("a"), F.col("x.low").alias("b"))
        return moved.where("a != b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    down = common.kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    was = state(down)
    while was[0]:
        both = down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = star(both, True)
        down = common.kept(star(up.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), False), "edges")
        now = state(down)
        if now == was:
            break
        was = now
    return down.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, width: int = 1) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = common.kept(fingerprints(docs, k, width), "prints")
    values = common.kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", "first"), "values")
    # a node is the smallest doc_id of its fingerprint, so that the smallest node of a component is its id
    nodes = values.where("first is not null")
    ids = nodes.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if ids:  # a doc_id with several fingerprints: nodes can't be named by it
        named = nodes.select(F.xxhash64("fp").alias("node") if width > 1 else F.col("fp")[0].alias("node"), "fp", "first")
    else:
        named = nodes.select(F.col("first").alias("node"), "fp", "first")
    named = common.kept(named, "nodes")
    roots = components(links(named.select("node", "fp"), radius))
    of = named.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"), "first")
    low = of.groupBy("root").agg(F.min("first").alias("low"))
    component = of.join(low, "root").select("fp", F.col("low").alias("component_id"))
    return prints.join(component, "fp", "left").select("doc_id", "fp", "component_id")


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    return grouped(docs).select("doc_id", shown(F.col("fp")[0]).alias("fingerprint"), "component_id")


def copies(docs: DataFrame, k: int, radius: int, width: int) -> DataFrame:
    """doc_id, hash (of the text) and component (id and hash of the row that stays; a null id comes last) of every distinct doc_id and text."""
    base = common.texts_of(docs).withColumn("hash", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            fp, of, n, deals = [], [], [], []
            for t in part.column("text").to_pylist():
                grams = shingle_set((t or "").encode(), k)
                fp.append(set_fingerprint(grams, width))
                of.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63))
                n.append(len(grams))
                deals.append(deals_of(grams) if len(grams) >= LEAST else [])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(fp, pa.list_(pa.int64())), pa.array(of, pa.int64()), pa.array(n, pa.int32()), pa.array(deals, pa.list_(pa.int64()))], ["doc_id", "hash", "fp", "set", "n", "deals"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            grams = [shingle_set((t or "").encode(), k).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("g", "node", "fp")), pa.array(grams, pa.binary())], ["g", "node", "fp", "grams"])

    prints = common.kept(base.mapInArrow(common.freed(scan), "doc_id long, hash long, fp array<long>, set long, n int, deals array<long>"), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    values = prints.groupBy("fp", "set", "n").agg(F.min(row).alias("first"), F.first("deals").alias("deals"))
    values = common.kept(values.select(F.monotonically_increasing_id().alias("node"), "fp", "set", "first", "deals"), "values")
    dealt = values.select(F.explode("deals").alias("g"), "node")
    shared = dealt.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    dealt = common.kept(dealt.join(shared, "g").join(values.select("node", "fp"), "node"), "deals")
    reached = components(within(dealt, radius, PART))
    proposed = reached.union(reached.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "g")
    picked = values.join(proposed, "node").select("g", "node", "fp", F.col("first.doc_id").alias("doc"), F.col("first.hash").alias("hash"))
    texts = base.join(picked, base["doc_id"].eqNullSafe(picked["doc"]) & (base["hash"] == picked["hash"])).dropDuplicates(["node"]).select("g", "node", "fp", "text")
    members = common.kept(texts.mapInArrow(common.freed(sets), "g long, node long, fp array<long>, grams binary"), "sets")
    roots = components(within(members, radius, GROUP_PART))
    of = values.join(roots, "node", "left").select("fp", "set", "first", F.coalesce("root", "node").alias("root"))
    low = of.groupBy("root").agg(F.min("first").alias("component"))
    return prints.select("doc_id", "hash", "fp", "set").distinct().join(of.join(low, "root"), ["fp", "set"]).select("doc_id", "hash", "component")


def near_copies(docs: DataFrame, k: int = NEAR["k"], radius: int = NEAR["radius"], width: int = NEAR["width"]) -> DataFrame:
    """doc_id and component_id of every distinct row with a doc_id; rows whose sets of shingles are alike are linked."""
    return copies(docs, k, radius, width).where("doc_id is not null").select("doc_id", F.col("component.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = NEAR["k"], radius: int = NEAR["radius"], width: int = NEAR["width"]) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (nulls last, then by a hash of the text), and of such a row's repetitions one."""
    stay = copies(docs, k, radius, width).where("doc_id <=> component.doc_id and hash = component.hash")
    stay = common.kept(stay.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_text")), "groups")
    row = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    many = docs.groupBy(*(c.alias(n) for c, n in zip(row, "ab", strict=True))).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    out = docs.join(stay, row[0].eqNullSafe(F.col("_id")) & (row[1] == F.col("_text")), "left_semi")
    if not many:
        return out
    return out.withColumns({"_id": row[0], "_text": row[1]}).dropDuplicates(["_id", "_text"]).select(*docs.columns)
