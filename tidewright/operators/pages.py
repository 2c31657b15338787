"""Features of web pages."""

from __future__ import annotations

import zlib

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import strings as S


def url_features(url: Column) -> dict[str, Column]:
    tld = S.domain(url)
    return {
        "slashes": (F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit(""))) - 2).cast("long"),
        "dots": (F.length(url) - F.length(F.replace(url, F.lit("."), F.lit("")))).cast("long"),
        "is_html": F.substring_index(url, ".", -1).isin("html", "htm").cast("long"),
        **{f"tld_{x}": F.coalesce((tld == x).cast("long"), F.lit(0).cast("long")) for x in S.DOMAINS},
    }


def anchor_length(html: Column) -> Column:
    """Characters of text inside links."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    return F.aggregate(F.transform(anchors, lambda a: F.length(F.regexp_replace(a, "(?s)<[^>]*>", ""))), F.lit(0), lambda a, n: a + n).cast("long")


def read_once(pages: DataFrame) -> DataFrame:
    """pages (with html) with text and words, each computed once for all that is made of them."""
    return pages.withColumn("text", S.visible_text(F.col("html"))).withColumn("words", S.alnum_tokens(F.col("text")))


def html_features(html: Column, frequent: list[str], text: Column | None = None, words: Column | None = None) -> dict[str, Column]:
    """Of columns of read_once(), if given: else the text is made anew for most of them."""
    text = S.visible_text(html) if text is None else text
    words = S.alnum_tokens(text) if words is None else words
    known = F.array(*map(F.lit, frequent))
    n = F.size(words)
    share = F.size(F.filter(words, lambda w: F.array_contains(known, w))) / n
    return {
        "n_words": n.cast("long"),
        "mean_word": F.when(n > 0, F.round(F.aggregate(words, F.lit(0.0), lambda a, w: a + F.length(w)) / n, 6)).otherwise(0.0),
        "title_words": F.size(S.word_tokens(S.title_of(html))).cast("long"),
        "scripts": F.regexp_count(html, F.lit(r"(?i)<script\b")).cast("long"),
        "images": F.regexp_count(html, F.lit(r"(?i)<img\b")).cast("long"),
        "anchor_chars": anchor_length(html),
        "visible_ratio": F.round(F.coalesce(F.try_divide(F.length(html), F.length(text)), F.lit(0.0)), 6),
        "frequent_share": F.when(n > 0, F.round(share, 6)).otherwise(0.0),
        "frequent_cover": F.round(F.size(F.array_intersect(known, words)) / len(frequent), 6),
    }


#: Rewritings of a page, in order, to text with lines: white space collapses, a paragraph begins after a blank line, a break is a line.
LINES = [
    (r"(?s)<!--.*?-->|<[!?][^>]*>", " "),
    (r"[ \t\r\n]+", " "),
    (r"(?i)<p(?: [^>]*)?/?>|<br(?: [^>]*)?/>", "\n\n"),
    (r"(?i)<br(?: [^>]*)?>", "\n"),
    (r"<[^>]*>", " "),
    (r" +", " "),
    (r"\n ", "\n"),
    (r"(?<=[^ \n])\n", " \n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
#: Character references that are replaced.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def parsed_text(html: Column) -> Column:
    for pattern, by in LINES:
        html = F.regexp_replace(html, pattern, by)
    for reference, by in REFERENCES.items():
        html = F.replace(html, F.lit(reference), F.lit(by))
    return html


def read_html(html: str) -> str:
    """parsed_text() of one string."""
    for pattern, by in LINES:
        html = regex.sub(pattern, by, html)
    for reference, by in REFERENCES.items():
        html = html.replace(reference, by)
    return html


def per_value(f, kind: str):
    """f over single values as a pandas function of a column."""

    def apply(values: pd.Series) -> pd.Series:
        return values.map(f)

    return F.pandas_udf(apply, kind)


def compressed_size(text: Column) -> Column:
    return per_value(lambda x: len(zlib.compress((x or "").encode())), "long")(text)


def lemmatised(words: DataFrame, column: str, lemmas: DataFrame) -> DataFrame:
    """words with lemma, from a dictionary (word, lemma) that has each word once; what it lacks is its own lemma. Distinct words are joined with it, and joined back."""
    known = words.select(column).distinct().join(lemmas.select(F.col("word").alias(column), "lemma"), column, "left")
    return words.join(known.withColumn("lemma", F.coalesce("lemma", column)), column)


def plurals(words: DataFrame) -> DataFrame:
    """A dictionary (word, lemma) from words (word) alone: a word of four letters or more with an s at its end is a form of the word without, if that occurs."""
    every = words.select("word").distinct()
    return every.where("length(word) > 3 and word like '%s'").withColumn("lemma", F.expr("substring(word, 1, length(word) - 1)")).join(every.select(F.col("word").alias("lemma")), "lemma", "left_semi").select("word", "lemma")


def words_of(html: Column, to_text=S.visible_text, tokenise=S.alnum_tokens) -> Column:
    """Words of a page by any text extractor and tokeniser over columns."""
    return tokenise(to_text(html))
