"""SimHash, suffix-array dedup and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import parsing, queries, simhash, suffix

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, base = prose(rng, 60), prose(rng, 80)
    out = [None, "", " \n", "one", "two words", base, base, base[:-1], base + "x", base.replace("a", "b", 1), shared, "AB cd EF", "ab CD ef"]
    out += [prose(rng, 10) + shared[: rng.randint(50, 300)] + prose(rng, 10) for _ in range(25)]
    out += ["ab" * 400, "z" * 999, "é" * 300, prose(rng, 3000), shared + shared]
    out += [prose(rng, 5) + " " + shared[k : k + 120] for k in range(0, 40, 3)]
    return [(i * 3, t, "s", i) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, tag int").repartition(5)


def brute_fingerprint(text):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(list(prints), prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_chains_and_parts(spark, monkeypatch):
    """Links that only a chain connects, values that share a deal and are compared in parts, and the widest ids."""
    monkeypatch.setattr(simhash, "PART", 16)
    rng = random.Random(1)
    chain = [(1 << k) - 1 for k in range(0, 40, 2)]
    near = [0xFFFF << 48 | sum(1 << rng.randrange(0, 40) for _ in range(4)) for _ in range(150)]
    values = sorted(set(chain + near))
    df = spark.createDataFrame([(n, [v - (1 << 64) if v >> 63 else v]) for n, v in enumerate(values)], "node long, fp array<long>")
    want = brute_components(list(range(len(values))), dict(enumerate(values)), 3)
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_rows_without_ids(spark):
    rows = [(None, "a b c"), (4, "a b c"), (2, "a b c"), (None, "else where we are"), (2, "another text of this id"), (None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 2), (2, 2), (2, 2), (4, 2)]


def test_near_copies_for_the_pipeline(spark):
    rng = random.Random(2)
    base = prose(rng, 200).split()
    near = list(base)
    near[50] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, prose(rng, 200)), (4, " ".join(base)), (None, "a"), (None, "a"), (3, prose(rng, 50))]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # different texts of one doc_id stay, and one of the copies without doc_id
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 3, 3]


def test_near_copies_by_jaccard(spark, monkeypatch):
    """Pairs around 0.6 to 0.9, short texts, lines that repeat, and groups checked in parts, against all pairs by brute force."""
    monkeypatch.setattr(simhash, "GROUP_PART", 7)
    rng = random.Random(8)
    texts = []
    for n in (9, 12, 30, 60, 120, 300):
        for _ in range(12):
            words = prose(rng, n).split()
            texts.append(" ".join(words))
            for cut in (0.01, 0.02, 0.03, 0.04, 0.06, 0.08):
                other = list(words)
                for at in rng.sample(range(n), max(1, round(cut * n))):
                    other[at] = prose(rng, 1) + "x"
                texts.append(" ".join(other))
            texts += [" ".join(words[: round(n * f)]) for f in (0.78, 0.8, 0.82, 0.9)]
    line = "the same old line again "
    texts += [prose(rng, 40) + " " + line * 300, prose(rng, 40) + " " + line * 300, "a b c d e f", "a b c d e f g", "", None]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shares = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            shares.append(both / max(1, len(a | b)))
            if 5 * both >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sum(0.6 < s < 0.8 for s in shares) > 100 and sum(0.8 <= s < 0.9 for s in shares) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(map(tuple, simhash.near_copies(df).collect()))
    assert got == {i: find(i) for i in range(len(texts))}
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {find(i) for i in range(len(texts))}


def test_groups_larger_than_a_part(spark, monkeypatch):
    """Groups compared in two rounds: around a leader, in chains, and in several components, with and without sets."""
    monkeypatch.setattr(simhash, "SEEDS", 2)
    rng = random.Random(6)
    value = []
    for g in range(3):
        hub = rng.getrandbits(64)
        value += [(g, hub ^ (1 << k)) for k in range(30)] + [(g, hub ^ sum(1 << k for k in rng.sample(range(64), rng.choice((4, 5, 30))))) for _ in range(30)]
        value += [(g, ~hub & ((1 << 64) - 1) ^ ((1 << k) - 1)) for k in range(0, 20, 2)]
    rows = [(g, n, [v - (1 << 64) if v >> 63 else v]) for n, (g, v) in enumerate(value)]
    df = spark.createDataFrame(rows, "g long, node long, fp array<long>").repartition(3)
    far = {n: v | ((1 << 20) - 1) << (64 + 20 * g) for n, (g, v) in enumerate(value)}  # no links between groups
    want = brute_components(list(far), far, 3)
    for most in (7, 1000):
        got = {r.node: r.root for r in simhash.components(simhash.within(df, 3, most)).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_deals_of_alike_sets():
    """Sets of a Jaccard coefficient of 0.8 share a deal."""
    rng = np.random.default_rng(4)
    for n in (4, 20, 400):
        for _ in range(300):
            both = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 63, n // 8, np.uint64) * np.uint64(2)])) for _ in range(2))
            assert set(simhash.deals_of(a).tolist()) & set(simhash.deals_of(b).tolist())


def brute_repeats(rows):
    """doc_id, text of rows with ids in order to bytes, removed, spans, kept."""
    seen: dict[bytes, tuple] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            seen.setdefault(b[p : p + 100], (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffixes(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 150)  # many buckets: strings are compared across their boundaries
    got = [tuple(r) for r in suffix.digests(suffix.removed(docs)).orderBy("doc_id").collect()]
    assert got == brute_repeats([(r[0], r[1]) for r in rows])
    assert sum(r[2] for r in got) > 3000


def test_rows_without_ids_keep_their_own_text(spark):
    """Texts of any number that share no identity: only what they repeat goes, and no row's spots meet another's text."""
    rng = random.Random(3)
    same = prose(rng, 40)
    held = [f"{prose(rng, 3)} {same}" for _ in range(4)]
    alone = [prose(rng, rng.randint(1, 40)) for _ in range(900)]
    for doc_id in (None, 7):
        rows = [(doc_id, t) for t in alone] + [(doc_id, same * 3)] + [(1, t) for t in held]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert suffix.keyed(df).select("doc", "tag").distinct().count() == len(set(rows))
        left = [r.text for r in suffix.without_repeats(df).where("doc_id is null or doc_id = 7").collect()]
        assert not set(alone) - set(left) and len(left) == len(alone) + 1


def test_suffixes_of_long_texts(spark, monkeypatch):
    """Texts far longer than what is digested at a time. The tasks read the bound from the module, so pieces are cut here."""
    monkeypatch.setattr(suffix, "PIECE", 500)
    rng = random.Random(9)
    same = prose(rng, 300)
    texts = [prose(rng, 200) + same, same, prose(rng, 37) + same[400:1500] + prose(rng, 100) + same[:900]]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    for d in data:
        whole = suffix.anchors(d, np.array([0, len(d)]))
        cut = [(at, suffix.anchors(p, s)) for at, p, s in suffix.pieces(d, np.array([0, len(d)]), suffix.LENGTH - 1)]
        windows = sorted((at + int(b) + k) for at, x in cut for b, n in zip(x[5], x[6], strict=True) for k in range(n))
        assert windows == list(range(len(d) - 99)) and sum(whole[6]) == len(windows)
    monkeypatch.undo()
    rows = list(enumerate([texts[0] * 60, texts[2] + "q", texts[1]]))
    rows = [(i, t + prose(rng, 270_000 if i == 0 else 5)) for i, t in rows]  # the first is longer than two pieces
    assert len(rows[0][1].encode()) > 2 * suffix.PIECE
    got = [tuple(r) for r in suffix.digests(suffix.removed(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert got == brute_repeats(rows)


def test_suffix_pieces_agree():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 3, 500) for _ in range(4)]
    order = suffix.multikey(words)
    assert [tuple(w[i] for w in words) for i in order] == sorted(zip(*words, strict=True))
    rows = [*words, np.arange(500)]
    cuts = np.unique(np.stack(rows, axis=1)[::50], axis=0)
    want = [sum(tuple(c) < t for c in cuts.tolist()) for t in zip(*[r.tolist() for r in rows], strict=True)]
    assert suffix.bucket_of(rows, cuts).tolist() == want


def test_passages_leave_whole_characters(spark):
    a = "é" * 80
    df = spark.createDataFrame([(1, "x" + a, 7), (2, a + "yy", 7), (3, None, 7), (4, "", 7)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix.without_repeats(df).collect()}
    assert {k: got[k] for k in (2, 3, 4)} == {2: ("yy", 2), 3: (None, None), 4: ("", 0)}
    assert got[1][0].startswith("x") and set(got[1][0]) <= {"x", "é"}


def test_fingerprints(docs, rows):
    order = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    got = {r.doc_id: r for r in parsing.compared(docs).collect()}
    prints = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        changed = parsing.edited(t, after)
        assert len(changed) == len(t) or len(after) < len(t) // 2
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        own, new, nxt = parsing.of_texts([t, changed, after])
        assert [r.fingerprint, r.edited_fingerprint] == parsing.hexes(np.array([own, new]))
        assert r.near_edited == pytest.approx(float(parsing.likeness(own[None], new[None])[0])) and r.near_next == pytest.approx(float(parsing.likeness(own[None], nxt[None])[0]))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    plain = {r.doc_id: r.fingerprint for r in parsing.fingerprints(docs).collect()}
    assert plain == {i: got[i].fingerprint for i in plain}


def slow_parse(data):
    """Names that count for a fingerprint, symbol by symbol as the module's docstring says."""
    M = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
        return x ^ (x >> 31)

    step, out = 0x9E3779B97F4A7C15, []
    names, level = [mix(b + 1) for b in data], 0
    while names:
        level += 1
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix((x + n * step) & M) for x, n in runs]
        label, bits = names, 64
        for _ in range(4):
            left = [~label[0] & ((1 << bits) - 1), *label]
            bit = [((x ^ y) & -(x ^ y)).bit_length() - 1 for x, y in zip(label, left, strict=False)]
            label, bits = [2 * k + (x >> k & 1) for x, k in zip(label, bit, strict=True)], 8
        inside = [-1, *label, -1]
        opens = [k for k in range(len(names)) if k != 1 and (k == 0 or inside[k] < inside[k + 1] > inside[k + 2])]
        groups = [names[a:b] for a, b in zip(opens, [*opens[1:], len(names)], strict=True)]
        names = [mix((sum(mix((x + (k + 1) * step) & M) for k, x in enumerate(g)) + len(g) * 0xD1342543DE82EF95 + level) & M) for g in groups]
        if level >= parsing.FIRST or len(names) == 1:
            out += names
        if len(names) == 1:
            break
    return out


def slow_print(text):
    """A fingerprint from slow_parse(): the least hash of each slot, empty slots borrowing from the next full one."""
    M, n = (1 << 64) - 1, parsing.SLOTS

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
        return x ^ (x >> 31)

    least = {}
    for x in slow_parse(text.encode()):
        h = mix((x + 0x9E3779B97F4A7C15) & M)
        least[h % n] = min(h, least.get(h % n, M))
    value = []
    for k in range(n):
        hop = next((j for j in range(n) if (k + j) % n in least), None)
        value.append(M if hop is None else least[k] if hop == 0 else mix((least[(k + hop) % n] + hop) & M))
    return "".join(f"{mix(v) >> 48:04x}" for v in value)


def test_fingerprints_by_a_slow_parser(docs, rows):
    got = {r.doc_id: r.fingerprint for r in parsing.fingerprints(docs).collect()}
    assert got == {i: slow_print(t or "") for i, t, *_ in rows}


def test_rows_of_one_id_are_dealt(spark):
    """Rows without doc_id, of one doc_id, and equal rows, in many parts: every row has the next one's text."""
    rng = random.Random(12)
    rows = [(i, t) for i in (None, 7) for t in [prose(rng, 3) for _ in range(200)] + ["same"] * 300]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = parsing.with_next(df).groupBy(F.spark_partition_id()).count().collect()
        got = parsing.compared(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(parts) == 16 and max(r["count"] for r in parts) < 130
    assert len(got) == 1000 and sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    changed = sorted((r.edited_sha256, r.doc_id or 0) for r in got)
    by = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), "h").collect()
    want = sorted((hashlib.sha256(parsing.edited(a.text, b.text).encode()).hexdigest(), a.doc_id or 0) for a, b in zip(by, [*by[1:], by[0]], strict=True))
    assert changed == want


def test_rows_that_come_in_another_order_each_time(spark):
    """A source that mixes its rows anew with each reading loses none, equal rows and rows without doc_id included."""
    rng = random.Random(21)
    rows = [(rng.choice([None, i]), prose(rng, 4)) for i in range(250)] + [(3, "twice")] * 25 + [(None, None)] * 25

    def mixed(frames):
        for f in frames:
            yield f.sample(frac=1)

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = parsing.compared(df).collect()
    got = parsing.compared(df.mapInPandas(mixed, df.schema)).collect()
    assert len(got) == 300 and sorted(map(str, got)) == sorted(map(str, plain))


def test_equal_substrings_share_names():
    rng = random.Random(4)
    inner = prose(rng, 300)
    names = []
    for head in ("", "q", prose(rng, 7), prose(rng, 50)):
        b = (head + inner + prose(rng, 20)).encode()
        names.append(set(parsing.phrases(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist()))
    assert all(len(names[0] & n) > 0.7 * len(names[0]) for n in names)


def test_no_next_and_no_rows(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    r = parsing.compared(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1
    same = spark.createDataFrame([(5, "abc"), (5, "abc"), (None, None), (None, "z")], "doc_id long, text string")
    assert parsing.compared(same).count() == 4
    none = one.limit(0)
    assert parsing.compared(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert suffix.removed(none).count() == 0
    assert suffix.without_repeats(none).count() == 0


def test_queries_cover_the_table(spark):
    for name in ("op6_simhash", "op7_suffix_dedup", "op10_fingerprints"):
        assert queries.QUERIES[name](spark, DATA).select(F.count_distinct("doc_id")).first()[0] == 200
