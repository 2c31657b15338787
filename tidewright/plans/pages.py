"""Queries of page features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import strings as S
from tidewright.operators import boosting as B
from tidewright.operators import control as C
from tidewright.operators import lemmas as L
from tidewright.operators import pages as P
from tidewright.plans.registry import query
from tidewright.sources.tables import table

FREQUENT = ["the", "of", "and", "to", "in", "de", "la", "que", "der", "und"]
STRIP = r"trim(regexp_replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
NOCODE = r"regexp_replace(regexp_replace({}, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g')"
TEXT = STRIP.format(NOCODE.format("html"))
VISIBLE = STRIP.format(NOCODE.format(r"regexp_replace(html, '(?is)<head\b.*?</head>', ' ', 'g')"))
BODY = STRIP.format(NOCODE.format(r"regexp_replace(regexp_replace(html, '(?is)<title[^>]*>.*?</title>', ' ', 'g'), '(?is)<h[1-6][^>]*>.*?</h[1-6]>', ' ', 'g')"))


@query(f"SELECT page_id, md5({TEXT}) AS text_md5, md5({VISIBLE}) AS visible_md5, length({VISIBLE}) AS n_visible FROM pages")
def page_text(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.md5(S.text_of(h).cast("binary")).alias("text_md5"), F.md5(S.visible_text(h).cast("binary")).alias("visible_md5"), F.length(S.visible_text(h)).cast("long").alias("n_visible"))


@query(rf"SELECT page_id, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(array_to_string(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), ' ')) AS headers, md5(lower({BODY})) AS body_md5 FROM pages")
def page_zones(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.lower(S.title_of(h)).alias("title"), F.lower(S.headers_of(h)).alias("headers"), F.md5(F.lower(S.body_of(h)).cast("binary")).alias("body_md5"))


@query("SELECT page_id, length(url) - length(replace(url, '/', '')) - 2 AS slashes, length(url) - length(replace(url, '.', '')) AS dots, CAST(string_split(url, '.')[-1] IN ('html', 'htm') AS BIGINT) AS is_html, " + ", ".join(f"CAST(string_split(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.')[-1] = '{x}' AS BIGINT) AS tld_{x}" for x in S.DOMAINS) + " FROM pages")
def url_features(spark, d):
    return table(spark, d, "pages").select("page_id", *(c.alias(k) for k, c in P.url_features(F.col("url")).items()))


_WORDS = rf"regexp_extract_all(lower({VISIBLE}), '[\p{{L}}\p{{N}}]+')"
_KNOWN = "[" + ", ".join(f"'{w}'" for w in FREQUENT) + "]"


@query(rf"""WITH w AS (SELECT page_id, html, {VISIBLE} AS vis, {_WORDS} AS w FROM pages)
SELECT page_id, len(w) AS n_words, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) ELSE 0 END AS mean_word,
len(regexp_extract_all(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\p{{L}}\p{{N}}_'']+')) AS title_words,
len(regexp_extract_all(html, '(?i)<script\b')) AS scripts, len(regexp_extract_all(html, '(?i)<img\b')) AS images,
CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: length(regexp_replace(x, '(?s)<[^>]*>', '', 'g')))), 0) AS BIGINT) AS anchor_chars,
coalesce(round(length(html)::double / nullif(length(vis), 0), 6), 0) AS visible_ratio,
CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains({_KNOWN}, x)))::double / len(w), 6) ELSE 0 END AS frequent_share,
round(len(list_intersect({_KNOWN}, w))::double / {len(FREQUENT)}, 6) AS frequent_cover FROM w""")
def page_features(spark, d):
    columns = P.html_features(F.col("html"), FREQUENT, F.col("text"), F.col("words"))
    return P.read_once(table(spark, d, "pages")).select("page_id", *(c.alias(k) for k, c in columns.items()))


def _lines(sql: str) -> str:
    for pattern, by in P.LINES:
        if pattern.startswith("(?<="):  # the pattern language of SQL looks behind by a group
            pattern, by = r"([^ \n])\n", r"\1" + by
        sql = f"regexp_replace({sql}, '{pattern}', '" + by.replace("\n", "' || chr(10) || '") + "', 'g')"
    for reference, by in P.REFERENCES.items():
        sql = f"replace({sql}, '{reference.replace(chr(39), chr(39) * 2)}', '{by.replace(chr(39), chr(39) * 2)}')"
    return sql


@query(f"SELECT page_id, {_lines('html')} AS text FROM pages")
def page_text_parsed(spark, d):
    return table(spark, d, "pages").select("page_id", P.parsed_text(F.col("html")).alias("text"))


@query()
def page_compression(spark, d):
    """Bytes of text over compressed bytes."""
    n = F.octet_length("html")
    return table(spark, d, "pages").select("page_id", F.round(n / P.compressed_size(F.col("html")), 6).alias("ratio"))


@query(f"WITH o AS (SELECT unnest({_WORDS}) AS word FROM pages), u AS (SELECT DISTINCT word FROM o) SELECT coalesce(l.word, o.word) AS lemma, count(*) AS n FROM o LEFT JOIN u l ON length(o.word) > 3 AND o.word LIKE '%s' AND l.word = left(o.word, length(o.word) - 1) GROUP BY ALL")
def page_lemmas(spark, d):
    """Words by lemma, with a dictionary of plurals that the pages themselves show."""
    words = table(spark, d, "pages").select(F.explode(P.words_of(F.col("html"))).alias("word"))
    return P.lemmatised(words, "word", P.plurals(words)).groupBy("lemma").agg(F.count("*").alias("n"))


ENDINGS = ("s", "es", "ed", "ing", "er", "en", "ly")
_DICTIONARY = f"""o AS (SELECT unnest({_WORDS}) AS word FROM pages), u AS (SELECT word, count(*) AS n_pages FROM o GROUP BY word),
f AS (SELECT word, length(e) AS k, left(word, length(word) - length(e)) AS stem FROM u, (SELECT unnest({list(ENDINGS)}) AS e) WHERE ends_with(word, e) AND length(word) >= 3 + length(e)),
g AS (SELECT word, max(k) AS k FROM f WHERE stem IN (SELECT word FROM u) GROUP BY word),
d AS (SELECT word, n_pages, left(word, length(word) - coalesce(k, 0)) AS lemma, ('0x' || left(md5(word), 4))::int % 100 < 67 AS known FROM u LEFT JOIN g USING (word)),
p AS (SELECT word, lemma, list_max(list_filter(range(0, least(length(word), length(lemma)) + 1), lambda i: left(word, i) = left(lemma, i))) AS same FROM d WHERE known),
c AS (SELECT right(word, k) AS suffix, CASE WHEN length(word) - k <= same THEN substr(lemma, length(word) - k + 1) END AS replacement, count(*) AS n FROM p, (SELECT unnest(range(1, {L.LONGEST + 1})) AS k) WHERE k <= length(word) GROUP BY ALL),
r AS (SELECT suffix, replacement, n, CAST(sum(n) OVER (PARTITION BY suffix) AS BIGINT) AS n_words FROM c QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY replacement IS NULL, n DESC, replacement) = 1),
rules AS (SELECT * FROM r WHERE replacement IS NOT NULL AND n >= {L.SUPPORT})"""
_RULED = f"""{_DICTIONARY}, a AS (SELECT d.word, arg_max(replacement, k) AS ending, max(k) AS k FROM d, (SELECT unnest(range(1, {L.LONGEST + 1})) AS k), rules WHERE k <= length(word) AND suffix = right(word, k) GROUP BY d.word),
ruled AS (SELECT d.*, coalesce(nullif(left(d.word, length(d.word) - a.k) || a.ending, ''), d.word) AS guess FROM d LEFT JOIN a USING (word))"""


def page_dictionary(spark, d):
    """word, n_pages (how often the pages have it), lemma as the pages attest it, and known: whether rules may learn from it (two words in three)."""
    words = table(spark, d, "pages").select(F.explode(P.words_of(F.col("html"))).alias("word")).groupBy("word").agg(F.count("*").alias("n_pages"))
    words = C.saved(words)  # the pages are taken apart once
    part = F.conv(F.left(F.md5(F.col("word").cast("binary")), F.lit(4)), 16, 10).cast("int") % 100
    return words.join(L.attested(words, ENDINGS), "word").withColumn("known", part < 67)


@query(f"WITH {_DICTIONARY} SELECT suffix, replacement, n, n_words FROM rules")
def lemma_rules(spark, d):
    """Suffix rules that two thirds of the pages' dictionary teach."""
    return L.learned(page_dictionary(spark, d).where("known"))


def ruled(spark, d):
    words = C.saved(page_dictionary(spark, d))
    return words.join(L.applied(words, L.learned(words.where("known"))).withColumnRenamed("lemma", "guess"), "word")


@query(f"WITH {_RULED} SELECT known, count(*) AS n, count(*) FILTER (guess = lemma) AS n_right, count(*) FILTER (word = lemma) AS n_unchanged, round(count(*) FILTER (guess = lemma)::double / count(*), 6) AS accuracy FROM ruled GROUP BY known")
def lemma_accuracy(spark, d):
    """How often the rules give a word's lemma, for the words they learned from and for the others; beside it, how many words are their own."""
    right = F.count_if(F.col("guess") == F.col("lemma"))
    return ruled(spark, d).groupBy("known").agg(F.count("*").alias("n"), right.alias("n_right"), F.count_if(F.col("word") == F.col("lemma")).alias("n_unchanged"), F.round(right / F.count("*"), 6).alias("accuracy"))


@query(f"WITH {_RULED} SELECT CASE WHEN known THEN lemma ELSE guess END AS lemma, CAST(sum(n_pages) AS BIGINT) AS n FROM ruled GROUP BY 1")
def page_lemmas_learned(spark, d):
    """Words by lemma: known words by the dictionary, the others by the rules it teaches."""
    lemma = F.when(F.col("known"), F.col("lemma")).otherwise(F.col("guess"))
    return ruled(spark, d).groupBy(lemma.alias("lemma")).agg(F.sum("n_pages").alias("n"))


def marked(spark, d):
    """page_id, features, label: pages by URL and markup; 1 where the visible text has a run of three marks for every four words. No feature counts marks."""
    pages = P.read_once(table(spark, d, "pages"))
    columns = P.html_features(F.col("html"), FREQUENT, F.col("text"), F.col("words")) | P.url_features(F.col("url"))
    runs = F.regexp_count("text", F.lit(r"([%*#$])\1\1"))
    x = pages.select("page_id", runs.alias("runs"), *(c.alias(k) for k, c in columns.items()))
    return x.select("page_id", F.array(*(F.col(k).cast("double") for k in columns)).alias("features"), (F.col("runs") * 4 > F.col("n_words")).cast("int").alias("label"))


def spam_split(spark, d):
    """Training pages, the first two thirds by page_id, and the others."""
    rows = C.saved(marked(spark, d))  # the pages are taken apart once
    cut = rows.agg(F.percentile("page_id", 0.67)).first()[0]
    return rows.where(F.col("page_id") <= cut), rows.where(F.col("page_id") > cut)


def spam_scored(spark, d):
    known, new = spam_split(spark, d)
    model = B.train(known.withColumnRenamed("page_id", "key"), trees=1000, depth=3, rate=0.1)
    return B.scored(new, model)


@query()
def page_spam(spark, d):
    """1000 boosted trees learn junk pages from the first two thirds and score the others."""
    return spam_scored(spark, d).select("page_id", "label", F.round("score", 6).alias("score"), "prediction")


@query()
def page_spam_quality(spark, d):
    """Accuracy and F1 of page_spam on the pages it never saw."""
    hit = lambda a, b: F.count_if((F.col("prediction") == a) & (F.col("label") == b))
    tp, fp, fn = hit(1, 1), hit(1, 0), hit(0, 1)
    return spam_scored(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"), F.round(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 6).alias("f1"))
