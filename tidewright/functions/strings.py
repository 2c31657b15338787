"""Column functions over strings, URLs and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern of ranking and language models, and the keys of two keyboard layouts.
TOKEN = "[A-Za-zА-Яа-я0-9]+"
LATIN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,./QWERTYUIOP{}ASDFGHJKL:\"ZXCVBNM<>?|@#$^&`~"
CYRILLIC_KEYS = "йцукенгшщзхъфывапролджэячсмитьбю.ЙЦУКЕНГШЩЗХЪФЫВАПРОЛДЖЭЯЧСМИТЬБЮ,/\"№;:?ёЁ"
#: Domains that have an indicator.
DOMAINS = ("ru", "ms", "com", "org", "cc", "cz", "ir", "info", "me", "kz", "net", "ua", "tk", "pl", "nu", "su", "by", "biz", "tv")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(a / b)


def to_cyrillic(text: Column) -> Column:
    return F.translate(text, LATIN_KEYS, CYRILLIC_KEYS)


def to_latin(text: Column) -> Column:
    return F.translate(text, CYRILLIC_KEYS, LATIN_KEYS)


def insert_at(text: Column, i: Column, piece: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), i), piece, F.substring(text, i + 1, F.length(text)))


def without_markup(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " "))


def text_of(html: Column) -> Column:
    """Text without scripts and styles."""
    return without_markup(F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " "))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and the head."""
    return text_of(F.regexp_replace(html, r"(?is)<head\b.*?</head>", " "))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def headers_of(html: Column) -> Column:
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), " ")


def body_of(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<title[^>]*>.*?</title>", " ")
    return text_of(F.regexp_replace(t, r"(?is)<h[1-6][^>]*>.*?</h[1-6]>", " "))


def domain(url: Column) -> Column:
    return F.element_at(F.split(F.parse_url(url, F.lit("HOST")), r"\."), -1)


def split_variants(text: Column) -> Column:
    """A space put at every inner position."""
    return F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: insert_at(text, i, F.lit(" ")))).otherwise(F.array().cast("array<string>"))


def join_variants(text: Column) -> Column:
    """One space taken out at a time."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)) == " ")
    return F.transform(at, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def layout_variants(text: Column) -> Column:
    """One word at a time typed in the other layout, both ways."""
    words = F.split(text, " ")

    def swapped(switch) -> Column:
        return F.transform(words, lambda _, i: F.array_join(F.transform(words, lambda w, j: F.when(i == j, switch(w)).otherwise(w)), " "))

    return F.concat(swapped(to_cyrillic), swapped(to_latin))
