"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed slots; everything
else is lower-cased and stripped of punctuation. What is left is a text's template. Whether a capitalised word elsewhere (at the start
of a text, a sentence, a line or a quotation) is a name, an item tells by itself: it is one if it is capitalised inside a sentence of the item
too. A document's windows are read both ways, with such a word as a name and as itself, in all combinations; so is an item's first word if it isn't known as
a name, because in a document it may stand inside a sentence. Each window of an item with names is also looked for with these as plain words, as a copy in lower
or upper case has them; other values are recognised only where names are capitalised. Templates are cut into windows of
WINDOW words, and the windows of documents are joined by hash with those of the benchmark. A document
holds an item if at least SHARE of the item's windows occur in it and its slots are consistent: where these windows are
laid over each other, each value of the item stands for one value in the document throughout, as in a
re-parameterised question. An exact copy is consistent.

A document may hold a template many times. Slots are checked for each way to lay the item over it: at one shift with enough
windows; at shifts less than the item's length from one of them, as where words were put in or left out; or, for a copy in
pieces, all over the document, near the commonest shift. A window that occurs more than once counts at its nearest place. One way that fits is enough.

An item of fewer than WINDOW words is one window, which is looked for among windows of its own length. Windows that consist of
slots alone say nothing and are left out of the benchmark's; an item that has no others is found by its values, where a
document has just these slots between other words (or its ends). Null and empty texts hold nothing. Each row is judged by itself, also where rows share a doc_id or have none.
An item that occurs twice in the benchmark is reported under each item_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import common

WINDOW, SHARE = 5, 0.8
#: Benchmark windows that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Units that make a word after a number a slot.
UNITS = "km|kilometres?|kilometers?|m|metres?|meters?|cm|mm|miles?|feet|foot|ft|inch|inches|kg|kilograms?|g|grams?|mg|lbs?|pounds?|tons?|tonnes?|litres?|liters?|ml|seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?|usd|eur|degrees?|mph|kmh|volts?|watts?|joules?"
SLOT, NAME = "#", "#m"


#: What parts words; # and _ are ours.
GAP = r"[^\p{L}\p{N}#_]+"


def numbered(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?<=\d)[.,:/](?=\d)", "_")
    t = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\p{{N}}_])(\d[\d_]*)\s?({UNITS})(?![\p{{L}}\p{{N}}_])", " #n$1 #u$2 ")
    return F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(\d)", " #n$1")


def marked(text: Column) -> Column:
    """The text in lower case; a slot is #n, #u or #m with its value behind, and a capitalised word that may be a name #s with the word behind. Texts without a digit skip what numbers need."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("#"), F.lit(" "))
    t = F.when(text.rlike("[0-9]"), numbered(t)).otherwise(t)
    t = F.regexp_replace(t, r"(\p{Lu})(?<=[\p{L}\p{N},;:\-'’)] \p{Lu})(?=\p{Ll})", "#m$1")
    return F.lower(F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(\p{Lu})(?=\p{Ll})", "#s$1"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(marked(text), GAP), "")


def itself(kinds: Column) -> Column:
    """Template words, where what may be a name isn't."""
    return F.transform(kinds, lambda w: F.when(w.startswith("#s"), F.substring(w, 3, 1 << 30)).otherwise(w))


def kinds_of(marks: Column) -> Column:
    """Template words of a marked text: slots without their values, and #s with the word behind."""
    return F.array_remove(F.split(F.regexp_replace(marks, r"(#[nmu])[\p{L}\p{N}_]+", "$1"), GAP), "")


def gram(words: Column, at: Column, length: int = WINDOW) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(length)))


def value(word: Column) -> Column:
    """A word without its mark."""
    return F.when(word.startswith(SLOT), F.substring(word, 3, 1 << 30)).otherwise(word)


def further(x: Column, y: Column) -> Callable[[Column], Column]:
    """Readings with one more word, which may be x or y."""
    return lambda e: F.when(x == y, F.array(F.concat(e, x))).otherwise(F.array(F.concat(e, x), F.concat(e, y)))


def readings(kinds: Column, plain: Column, at: Column, length: int) -> Column:
    """Hashes of the window with what may be a name as one; of all combinations, if there is more than one such word."""
    word = lambda k: F.get(kinds, at + k)
    name = F.xxhash64(*(F.when(word(k).startswith("#s"), F.lit(NAME)).otherwise(word(k)) for k in range(length)))
    two = F.size(F.filter(F.slice(kinds, at + 1, length), lambda w: w.startswith("#s"))) > 1
    every = F.array(F.slice(plain, 1, 0))
    for k in range(length):
        x = F.slice(plain, at + 1 + k, 1)
        every = F.flatten(F.transform(every, further(x, F.when(word(k).startswith("#s"), F.array(F.lit(NAME))).otherwise(x))))
    return F.when(two, F.transform(every, lambda e: gram(e, F.lit(0), length))).otherwise(F.array(name))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, item_words, item_kinds, length (of its windows), bare (whether it has slots alone), and windows (structs of item_at and gram)."""
    w = items.withColumn("item_words", words_of(F.col("text")))
    name = lambda x: F.concat(F.lit(NAME), F.substring(x, 3, 1 << 30))
    known = F.transform("item_words", lambda x: F.when(x.startswith("#s") & F.array_contains("item_words", name(x)), name(x)).otherwise(x))
    w = w.withColumn("item_words", known).where(F.size("item_words") > 0).withColumn("item_kinds", itself(F.transform("item_words", lambda x: F.regexp_replace(x, "^(#[nmu]).*", "$1"))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("item_kinds") - WINDOW))
    seen = lambda kinds, i: F.struct(i.alias("item_at"), gram(kinds, i).alias("gram"))
    says = lambda i: F.exists(F.slice("item_kinds", i + 1, WINDOW), lambda k: ~k.startswith(SLOT))
    own = F.transform(F.filter(starts, says), lambda i: seen(F.col("item_kinds"), i))
    # a copy in other case has words where the item has names
    folded = F.transform("item_words", lambda x: F.when(x.startswith("#m") | x.startswith("#s"), F.substring(x, 3, 1 << 30)).otherwise(F.regexp_replace(x, "^(#[nu]).*", "$1")))
    named = lambda i: F.exists(F.slice("item_kinds", i + 1, WINDOW), lambda k: k == NAME)
    cased = F.transform(F.filter(starts, lambda i: says(i) & named(i)), lambda i: seen(folded, i))
    # not where that leaves slots alone
    open_first = F.get("item_words", F.lit(0)).startswith("#s") & F.exists(F.slice("item_kinds", 2, WINDOW - 1), lambda k: ~k.startswith(SLOT))
    first = F.array(seen(F.concat(F.array(F.lit(NAME)), F.slice("item_kinds", 2, WINDOW)), F.lit(0)))
    w = w.withColumn("bare", F.size(own) == 0).withColumn("windows", F.when(F.col("bare"), F.array(F.struct(F.lit(0).alias("item_at"), bare_gram(F.col("item_words")).alias("gram")))).otherwise(F.array_union(F.array_union(own, cased), F.when(open_first, first).otherwise(F.slice(own, 1, 0)))))
    return w.select("item_id", "item_words", "item_kinds", F.when(F.col("bare"), F.size("item_words")).otherwise(F.least(F.lit(WINDOW), F.size("item_words"))).alias("length"), "bare", "windows")


def bare_gram(words: Column) -> Column:
    return F.xxhash64(F.concat(F.array(F.lit("=")), words))


def beside_names(items: DataFrame) -> tuple[list[str], list[str]]:
    """The words that come before a name in an item (of item_windows()), and those that come after one; its first word may be one."""
    name = lambda i: (F.get("item_kinds", i) == NAME) | ((i == 0) & F.get("item_words", i).startswith("#s"))
    beside = lambda step: F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.size("item_kinds") - 1), name), lambda i: F.get("item_kinds", i + step)))
    both = [items.select(F.explode(beside(step)).alias("w")).where("w is not null").distinct().collect() for step in (-1, 1)]
    return [r.w for r in both[0]], [r.w for r in both[1]]


def held(docs: DataFrame, lengths: list[int], bare: list[int], beside: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """row, doc_id, at (the window's first word, from 0) and gram for every reading of every window of the lengths, and of those of slots alone between other words. With beside, words are read as names only next to the words they have next to them in an item, or to what may be a name."""
    base = docs.select("row", "doc_id", marked(F.col("text")).alias("marks"))
    base = base.select("row", "doc_id", kinds_of(F.col("marks")).alias("kinds"), *([F.array_remove(F.split("marks", GAP), "").alias("words")] if bare else []))
    base = base.withColumn("plain", itself(F.col("kinds")))
    # starts of words that may be names
    base = base.withColumn("maybe", F.filter(F.transform("kinds", lambda w, i: F.when(w.startswith("#s"), i)), lambda i: i.isNotNull()))
    if beside is not None:
        fits = lambda i, known: F.coalesce(F.get("plain", i).isin(known) | (F.lit(NAME in known) & F.get("kinds", i).startswith("#s")), F.lit(False))
        base = base.withColumn("maybe", F.filter("maybe", lambda i: fits(i - 1, beside[0]) | fits(i + 1, beside[1])))
    none = F.slice(F.array(F.lit(0)), 1, 0)
    seen = lambda i, g: F.struct(i.alias("at"), g.alias("gram"))
    starts = lambda n: F.when(F.size("plain") >= n, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("plain") - n))).otherwise(none)
    slot = lambda i: F.coalesce(F.get("plain", i).startswith(SLOT), F.lit(False))

    def plainly(n: int) -> Column:
        return F.transform(starts(n), lambda i: gram(F.col("plain"), i, n))

    def read(n: int) -> Column:
        around = F.array_distinct(F.flatten(F.transform("maybe", lambda p: F.sequence(F.greatest(F.lit(0), p - n + 1), p))))
        around = F.filter(around, lambda i: i <= F.size("kinds") - n)
        return F.flatten(F.transform(around, lambda i: F.transform(readings(F.col("kinds"), F.col("plain"), i, n), lambda g: seen(i, g))))

    def alone(n: int) -> Column:
        full = lambda i: slot(i) & ~slot(i - 1) & ~slot(i + n) & ~F.exists(F.slice("plain", i + 1, n), lambda k: ~k.startswith(SLOT))
        return F.transform(F.filter(starts(n), full), lambda i: seen(i, bare_gram(F.slice("words", i + 1, n))))

    no = F.slice(F.array(seen(F.lit(0), F.lit(0).cast("long"))), 1, 0)
    short = [F.zip_with(starts(n), plainly(n), seen) for n in lengths if n < WINDOW]
    base = base.withColumn("more", F.concat(no, *short, *(alone(n) for n in bare), *(F.when(F.size("maybe") > 0, read(n)).otherwise(no) for n in lengths)))
    # the windows of WINDOW words as they are come first, so that their number is their place
    base = base.withColumn("own", plainly(WINDOW) if WINDOW in lengths else F.slice(F.array(F.lit(0).cast("long")), 1, 0))
    rows = base.select("row", "doc_id", F.size("own").alias("n"), F.col("more.at").alias("ats"), F.posexplode(F.concat("own", F.col("more.gram"))).alias("pos", "gram"))
    return rows.select("row", "doc_id", F.when(F.col("pos") < F.col("n"), F.col("pos")).otherwise(F.get("ats", F.col("pos") - F.col("n"))).alias("at"), "gram")


def ways(hits: DataFrame, open_: DataFrame, share: float) -> DataFrame:
    """row, item_id and chosen (structs of item_at and shift) for each way to lay an item over a row, besides those at one shift."""
    spots = hits.join(open_.select("row", "item_id", "n_windows"), ["row", "item_id"]).withColumn("length", F.col("n_windows") + WINDOW - 1)
    band = F.floor(F.col("shift") / F.col("length"))
    # shifts less than the length apart share a band of twice the length
    banded = spots.withColumn("band", F.explode(F.array(band, band - 1))).groupBy("row", "item_id", "n_windows", "length", "band").agg(F.collect_list(F.struct("item_at", "shift")).alias("hits"))
    banded = banded.withColumn("every", F.array_distinct("hits.item_at")).where(F.size("every") / F.col("n_windows") >= share)
    based = banded.withColumn("base", F.explode(F.array_distinct("hits.shift")))
    far = lambda h: F.abs(h["shift"] - F.col("base"))
    nearest = lambda a: F.array_min(F.transform(F.filter("hits", lambda h: (h["item_at"] == a) & (far(h) < F.col("length"))), lambda h: F.struct(far(h).alias("far"), h["shift"].alias("shift"))))
    chosen = F.filter(F.transform("every", lambda a: F.struct(a.alias("item_at"), nearest(a)["shift"].alias("shift"))), lambda c: c["shift"].isNotNull())
    close = based.withColumn("chosen", chosen).where(F.size("chosen") / F.col("n_windows") >= share).select("row", "item_id", "chosen").distinct()
    common_ = spots.groupBy("row", "item_id").agg(F.mode("shift", True).alias("base"))
    at = spots.join(common_, ["row", "item_id"]).groupBy("row", "item_id", "item_at").agg(F.min(F.struct(F.abs(F.col("shift") - F.col("base")), "shift")).alias("x"))
    return close.unionByName(at.groupBy("row", "item_id").agg(F.collect_list(F.struct("item_at", "x.shift")).alias("chosen")))


def judged(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """row, doc_id, item_id, n_matched, n_windows, share, n_slots: what each row holds."""
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = common.kept(item_windows(items), "items")
    asked = items.select("item_id", F.explode("windows").alias("x")).select("item_id", "x.item_at", "x.gram").distinct()
    cut = items.select("length", "bare").distinct().collect()
    lengths, bare = (sorted(r.length for r in cut if r.bare == b) for b in (False, True))
    n_asked = asked.count()
    small = F.broadcast if n_asked <= BROADCAST_ROWS else lambda df: df
    size = asked.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_windows"))
    hits = held(docs, lengths, bare, beside_names(items) if n_asked <= BROADCAST_ROWS else None).join(small(asked), "gram")
    hits = common.kept(hits.select("row", "doc_id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    matched = hits.select("row", "doc_id", "item_id", "item_at").distinct().groupBy("row", "doc_id", "item_id").agg(F.count("*").alias("n_matched"))
    pairs = matched.join(small(size), "item_id").withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= share)

    # items of slots alone were found by their values
    item_words = items.withColumn("n_slots", F.when(F.col("bare"), 0).otherwise(F.size(F.filter("item_kinds", lambda k: k.startswith(SLOT))))).drop("windows")
    # slots are compared only for items that have any: other pairs are done
    pairs = common.kept(pairs.join(small(item_words.groupBy("item_id").agg(F.max("n_slots").alias("n_slots"))), "item_id"), "pairs")
    some = pairs.where("n_slots > 0")
    texts = docs.join(some.select("row").distinct(), "row", "left_semi").dropDuplicates(["row", "text"])
    texts = common.kept(texts.select("row", words_of(F.col("text")).alias("words")), "words")

    def fitting(laid: DataFrame) -> DataFrame:
        """row and item_id of the ways whose slots are consistent."""
        slot = lambda i, shift: F.when(F.get("item_kinds", i).startswith(SLOT), F.struct(F.get("item_words", i).alias("a"), value(F.get("words", i + shift)).alias("b")))
        window = lambda c: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: slot((c["item_at"] + k).cast("int"), c["shift"].cast("int")))
        both = F.array_distinct(F.filter(F.flatten(F.transform("chosen", window)), lambda v: v.isNotNull()))
        open_ = laid.join(small(item_words), "item_id").join(texts, "row").select("row", "item_id", both.alias("both"))
        return open_.where(F.size("both") == F.size(F.array_distinct("both.a"))).select("row", "item_id").distinct()

    straight = hits.join(some.select("row", "item_id", "n_windows"), ["row", "item_id"]).groupBy("row", "item_id", "n_windows", "shift").agg(F.collect_list(F.struct("item_at", "shift")).alias("chosen"))
    first = common.kept(fitting(straight.where(F.size("chosen") / F.col("n_windows") >= share).select("row", "item_id", "chosen")), "fit")
    left = some.join(first, ["row", "item_id"], "left_anti")
    fit = first.unionByName(fitting(ways(hits, left, share)))
    columns = ["row", "doc_id", "item_id", "n_matched", "n_windows", "share", "n_slots"]
    return pairs.where("n_slots = 0").select(columns).unionByName(some.join(fit, ["row", "item_id"], "left_semi").select(columns))


def row_of() -> Column:
    """What identifies a row: a hash of doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.col("text").cast("string"))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", row_of().alias("row"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, share, n_slots: a row for each document and item it holds."""
    found = judged(rows_of(docs), benchmark, share)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_windows", "share", "n_slots")).alias("x"))
    return best.select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs that hold no item."""
    found = judged(rows_of(docs), benchmark, share).select(F.col("row").alias("_row")).distinct()
    return docs.join(found, row_of() == found["_row"], "left_anti")
