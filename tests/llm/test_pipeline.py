"""Decontamination, and the pipeline as a whole."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidewright.llm import common, decontam, queries

DATA = "/root/testdata/sf0.01"
ITEM = "A train leaves at 10 from Berlin and runs 300 km to Munich in 4 hours so how fast is the train from Berlin overall"
OTHER = ITEM.replace("10", "7").replace("Berlin", "Lyon").replace("300", "120").replace("Munich", "Paris").replace("4 hours", "2 hours")


def bench(spark):
    return spark.createDataFrame([(9, ITEM, "x"), (10, None, "x"), (11, "", "x"), (12, "1 2 3 4 5 6", "x")], "item_id long, text string, doc_id string")


def test_templates(spark):
    texts = [f"Before that. {ITEM} and after", f"x y. {OTHER}!", OTHER.replace("the train from Lyon", "the train from Nice"), None, "", "other words that go on and on and on", ITEM.upper(), "1 2 3 4 5 6 7 8"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench(spark)).collect()}
    assert {(0, 9), (1, 9)} <= got <= {(0, 9), (1, 9), (6, 9)}
    left = {r.doc_id for r in decontam.clean(docs, bench(spark)).collect()}
    assert {2, 3, 4, 5, 7} <= left and not left & {0, 1}
    assert decontam.clean(docs, bench(spark)).columns == docs.columns


def test_copies_in_other_case(spark):
    """Names are words where nothing is capitalised, or everything. Other numbers, or another word near the end (6), leave enough windows; other words for a name in two places (4) don't."""
    low, high = ITEM.lower(), ITEM.upper()
    texts = [low, high, f"Then we read {low} and went on", f"THEN WE READ {high} AND WENT ON", low.replace("berlin", "lyon"), low.replace("10", "7"), low.replace("the train from berlin", "the train from lyon"), ITEM.replace("Munich", "munich"), low.replace("10", "7").replace("4 hours", "5 hours").replace("train", "bus")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in decontam.contaminated(docs, bench(spark)).collect()}
    assert got == {0, 1, 2, 3, 5, 6, 7}
    assert {r.doc_id for r in decontam.clean(docs, bench(spark)).collect()} == {4, 8}


def test_names_are_read_alike_on_both_sides_of_the_broadcast(spark, monkeypatch):
    """Reading words as names only next to an item's names leaves out nothing that is found without."""
    anna = OTHER.replace("Lyon", "Oslo")
    texts = [f"Said. {ITEM}", f"Berlin is far. {OTHER}!", f'"{anna}"', ITEM.lower(), "Berlin and Munich and Berlin, 10 of 300", f"Anna said that {OTHER}", ITEM.replace("from Berlin", "from\nBerlin")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = sorted(map(str, decontam.contaminated(docs, bench(spark)).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert len(small) == 6 and sorted(map(str, decontam.contaminated(docs, bench(spark)).collect())) == small


def test_each_copy_is_judged(spark):
    """Copies behind one that isn't consistent, and copies with words put in, whose halves lie at different shifts."""
    bad = OTHER.replace("the train from Lyon", "the train from Nice")
    longer = OTHER.replace("to Paris", "to Paris quite")
    texts = [f"{bad}. Then more came. {OTHER}", f"{bad}. Then more came. {ITEM}", longer, longer.replace("the train from Lyon", "the train from Nice"), f"{bad}. Then more came. {longer}", f"{bad}. Then more came. {bad}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, bench(spark)).collect()} == {0, 1, 2, 4}


def test_names_short_items_and_bare_slots(spark):
    """Names where a sentence starts, items under five words inside longer texts, and items of slots alone by their values."""
    tom = "Tom has 5 apples. Tom buys 3 more. How many does Tom have?"
    anna = tom.replace("Tom", "Anna").replace("5", "8").replace("3", "2")
    items = spark.createDataFrame([(1, tom), (2, "What is 2 + 2?"), (3, "1 2 3 4 5 6"), (4, "How old are they? How old were they then?")], "item_id long, text string")
    texts = [f"Here it is.\n{anna}", f"The man met The crowd. {tom}", anna.replace("does Anna", "does Maria"), f"Question: {tom} An answer.", "Now tell me. What is 7 + 7? Quick.", "Now tell me. What is 7 + 8? Quick.", "Numbers: 1 2 3 4 5 6, all of them", "Numbers: 1 2 3 4 5 7, all of them", "1 2 3 4 5 6", "Question: How old are they? How old were they then?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(0, 1), (1, 1), (3, 1), (4, 2), (6, 3), (8, 3), (9, 4)}


def test_rows_are_judged_by_themselves(spark):
    half = len(ITEM) // 2
    rows = [(i, t) for i in (None, 5) for t in (ITEM, "clean words that hold nothing at all", ITEM[:half], ITEM[half - 20 :])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, decontam.clean(docs, bench(spark)).collect())) == sorted(str(r) for r in docs.collect() if r.text != ITEM)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench(spark)).collect()} == {(None, 9), (5, 9)}
    apart = docs.where(F.length("text") < len(ITEM))
    assert decontam.clean(apart, bench(spark)).count() == 6


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, ITEM), (None, ITEM), (1, ITEM)], "doc_id long, text string")
    assert decontam.contaminated(docs, bench(spark).limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), bench(spark)).count() == 0
    assert decontam.contaminated(docs, bench(spark)).count() == 2
    assert decontam.clean(docs, bench(spark)).count() == 0


def test_against_brute_force(spark):
    """Items that a document holds word for word are found, and no document without four fifths of an item's five-word windows."""
    def grams(text):
        w = re.findall(r"\w+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = {r.item_id: grams(r.text) for r in common.table(spark, DATA, "benchmark").collect()}
    docs = {r.doc_id: grams(r.text) for r in common.table(spark, DATA, "documents").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, DATA).collect()}
    share = {(d, i): len(g & w) / len(g) for d, w in docs.items() for i, g in items.items() if g & w}
    assert {k for k, s in share.items() if s == 1} <= got
    assert all(share.get(k, 0) > 0.6 for k in got)


def test_native():
    source = open(decontam.__file__).read()
    assert not re.search(r"pandas|Arrow|udf|rdd|mapIn", source)


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = common.table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.kept(stage(spark, docs, DATA), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_rows(staged):
    assert [n for n, _, _ in staged] == ["quality", "near_duplicates", "repeats", "decontamination", "encoding"]
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert staged[2][1].count() == staged[2][2].count()
    assert staged[4][1].count() == staged[4][2].count()


def test_decisions_take_effect(spark, staged):
    labels = common.table(spark, DATA, "labels")
    _, before, after = staged[0]
    good = labels.where("quality = 1").join(before, "doc_id").count()
    assert labels.where("quality = 1").join(after, "doc_id").count() >= 0.98 * good
    _, before, after = staged[1]
    assert after.select("text").distinct().count() == before.select("text").distinct().count() or after.count() < before.count()
    assert after.groupBy("text").count().where("count > 1").count() == 0
    _, before, after = staged[2]
    assert after.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum("n_chars")).first()[0]
    _, before, after = staged[3]
    held = {r.doc_id for r in decontam.contaminated(before, common.table(spark, DATA, "benchmark")).collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == held
    _, before, after = staged[4]
    assert before.select("doc_id", "text").exceptAll(after.select("doc_id", "text")).count() == 0


def test_run_is_its_stages(spark, staged):
    """run() gives the rows that the stages give one after the other."""
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == staged[-1][2].columns
    assert sorted(got.select("doc_id", "text", "n_tokens").collect()) == sorted(staged[-1][2].select("doc_id", "text", "n_tokens").collect())


def brute_template(text):
    """A text's template words and values, by a plain reading of the module's docstring; texts here have no units and no names where a sentence starts."""
    words, kinds = [], []
    for k, w in enumerate(text.split(" ")):
        bare = w.strip(".,!?")
        if bare.isdigit():
            words.append(bare)
            kinds.append("#n")
        elif bare[:1].isupper() and k:
            words.append(bare.lower())
            kinds.append("#m")
        else:
            words.append(bare.lower())
            kinds.append(bare.lower())
    return words, kinds


def test_templates_against_brute_force(spark):
    """Re-parameterised copies in random texts: windows, shares and slots at every shift, recomputed word by word."""
    rng = random.Random(11)
    plain = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)]
    name = lambda: "N" + "".join(rng.choices("abcdefgh", k=5))
    items = []
    for _ in range(6):
        words = rng.choices(plain, k=rng.randint(8, 14))
        for at in rng.sample(range(1, len(words)), 4):
            words[at] = rng.choice([name(), str(rng.randint(1, 99))])
        again = rng.sample(range(1, len(words)), 2)
        words[again[1]] = words[again[0]]
        items.append(" ".join(words))
    docs = []
    for _ in range(120):
        words = rng.choice(items).split(" ")
        swap = {}
        for k, w in enumerate(words):
            if w.isdigit() or w[0] == "N":
                if w not in swap or rng.random() < 0.2:
                    swap[w] = str(rng.randint(1, 99)) if w.isdigit() else name()
                words[k] = swap[w]
        for _ in range(rng.choice((0, 0, 0, 1, 3))):
            words[rng.randrange(1, len(words))] = rng.choice(plain)
        docs.append(" ".join([*rng.choices(plain, k=rng.randint(1, 6)), *words, *rng.choices(plain, k=rng.randint(0, 6))]))
    want = set()
    for d, doc in enumerate(docs):
        w, k = brute_template(doc)
        for i, item in enumerate(items):
            iw, ik = brute_template(item)
            windows = [a for a in range(len(ik) - 4) if any(x[0] != "#" for x in ik[a : a + 5])]
            for shift in range(-len(ik), len(k)):
                fit = [a for a in windows if 0 <= a + shift <= len(k) - 5 and k[a + shift : a + shift + 5] == ik[a : a + 5]]
                both = {(iw[a + j], w[a + j + shift]) for a in fit for j in range(5) if ik[a + j][0] == "#"}
                if fit and len(fit) >= 0.8 * len(windows) and len(both) == len({x for x, _ in both}):
                    want.add((d, i))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert 20 < len(want) < 110 and got == want
