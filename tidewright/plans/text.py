"""Queries over tokens, characters and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import strings as S
from tidewright.plans.registry import query
from tidewright.sources.tables import table

TOK = "regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+')"


@query(f"SELECT doc_id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) - 1 AS pos FROM documents")
def tokens_ir(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.tokens(F.col("text"))).alias("pos", "term")).select("doc_id", "term", F.col("pos").cast("long").alias("pos"))


@query(r"SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS n_letters, w[1] AS first_word, w[-1] AS last_word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) WHERE len(w) > 0")
def tokens_alnum(spark, d):
    w = F.col("w")
    rows = table(spark, d, "documents").select("doc_id", S.alnum_tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_letters"), F.element_at(w, 1).alias("first_word"), F.element_at(w, -1).alias("last_word"))


@query("SELECT doc_id, len(w) AS n_words FROM (SELECT doc_id, " + TOK + " AS w FROM documents) WHERE len(w) > 0")
def nonempty_queries(spark, d):
    rows = table(spark, d, "documents").select("doc_id", S.tokens(F.col("text")).alias("w"))
    return rows.where(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("n_words"))


@query(r"SELECT conv_id, turn, len(w) AS n_words FROM (SELECT conv_id, turn, string_split_regex(trim(text), '\s+') AS w FROM conversations) WHERE len(w) <= 50")
def short_lines(spark, d):
    w = F.split(F.trim("text"), r"\s+")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(w).cast("long").alias("n_words")).where("n_words <= 50")


@query("SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def character_set(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c != ''").groupBy("c").agg(F.count("*").alias("n"))


@query("""
WITH ch AS (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS place FROM benchmark),
vocab AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT c FROM ch))
SELECT item_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY place) AS codes, string_agg(c, '' ORDER BY place) AS decoded FROM ch JOIN vocab USING (c) GROUP BY item_id""")
def character_codes(spark, d):
    """Texts as character numbers and back; the alphabet is small, so its numbering is one small sort and its join a lookup."""
    from tidewright.operators import vocabulary

    items = table(spark, d, "benchmark")
    alphabet = vocabulary.characters(items, "text")
    coded = vocabulary.encode(items.select("item_id", "text"), "item_id", "text", alphabet)
    return vocabulary.decode(coded, "item_id", alphabet).select("item_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), " ").alias("codes"), "decoded")


@query("SELECT doc_id, octet_length(from_base64(base64(encode(text)))) AS n_bytes, md5(decode(from_base64(base64(encode(text))))) AS digest FROM documents")
def base64_round_trip(spark, d):
    coded = F.base64(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", F.octet_length(F.unbase64(coded)).cast("long").alias("n_bytes"), F.md5(F.decode(F.unbase64(coded), "UTF-8").cast("binary")).alias("digest"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"SELECT doc_id, md5(translate(text, {_quoted(S.LATIN_KEYS)}, {_quoted(S.CYRILLIC_KEYS)})) AS switched, md5(translate(translate(text, {_quoted(S.LATIN_KEYS)}, {_quoted(S.CYRILLIC_KEYS)}), {_quoted(S.CYRILLIC_KEYS)}, {_quoted(S.LATIN_KEYS)})) AS back FROM documents")
def layout_switch(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(S.to_cyrillic(t).cast("binary")).alias("switched"), F.md5(S.to_latin(S.to_cyrillic(t)).cast("binary")).alias("back"))


@query("SELECT item_id, left(text, 5) || '_' || substr(text, 6) AS inserted FROM benchmark")
def insert_character(spark, d):
    return table(spark, d, "benchmark").select("item_id", S.insert_at(F.col("text"), F.lit(5), F.lit("_")).alias("inserted"))


QUERY_SQL = "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+'), ' ') AS q FROM benchmark"


def whole_queries(spark, d):
    """item_id and q: benchmark texts as queries, words parted by single spaces."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(S.tokens(F.col("text")), " ").alias("q"))


@query(f"SELECT item_id, left(q, i) || ' ' || substr(q, i + 1) AS variant FROM (SELECT *, unnest(range(1, length(q))) AS i FROM ({QUERY_SQL}))")
def split_variants(spark, d):
    return whole_queries(spark, d).select("item_id", F.explode(S.split_variants(F.col("q"))).alias("variant"))


@query(f"SELECT item_id, left(q, i - 1) || substr(q, i + 1) AS variant FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM ({QUERY_SQL})) WHERE substr(q, i, 1) = ' '")
def join_variants(spark, d):
    return whole_queries(spark, d).select("item_id", F.explode(S.join_variants(F.col("q"))).alias("variant"))


@query(f"""
WITH q AS ({QUERY_SQL}), w AS (SELECT item_id, string_split(q, ' ') AS w FROM q),
m AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT item_id, array_to_string(list_transform(w, lambda x, j: CASE WHEN j = i THEN translate(x, {_quoted(S.LATIN_KEYS)}, {_quoted(S.CYRILLIC_KEYS)}) ELSE x END), ' ') AS variant FROM m
UNION ALL
SELECT item_id, array_to_string(list_transform(w, lambda x, j: CASE WHEN j = i THEN translate(x, {_quoted(S.CYRILLIC_KEYS)}, {_quoted(S.LATIN_KEYS)}) ELSE x END), ' ') AS variant FROM m""")
def layout_variants(spark, d):
    return whole_queries(spark, d).select("item_id", F.explode(S.layout_variants(F.col("q"))).alias("variant"))


@query(f"SELECT item_id, array_to_string(string_split(q, ' '), ' ') AS chained, length(trim('  ' || q || ' ')) AS n FROM ({QUERY_SQL})")
def word_chain(spark, d):
    return whole_queries(spark, d).select("item_id", F.array_join(F.split("q", " "), " ").alias("chained"), F.length(F.trim(F.concat(F.lit("  "), F.col("q"), F.lit(" ")))).cast("long").alias("n"))


@query("SELECT conv_id, turn, string_split(role || chr(9) || text, chr(9))[-1] AS fixed, trim(string_split(role || chr(9) || text, chr(9))[1]) AS quote FROM conversations")
def last_field(spark, d):
    f = F.split(F.concat_ws("\t", "role", "text"), "\t")
    return table(spark, d, "conversations").select("conv_id", "turn", F.element_at(f, -1).alias("fixed"), F.trim(F.element_at(f, 1)).alias("quote"))


@query("SELECT w, min(place) AS first_at FROM (SELECT unnest(w) AS w, item_id * 100000 + generate_subscripts(w, 1) AS place FROM (SELECT item_id, regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+') AS w FROM benchmark)) GROUP BY w ORDER BY first_at LIMIT 300")
def frequent_word_list(spark, d):
    """Order-preserving distinct words, the first 300: the list is what the operator is."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(S.tokens(F.col("text"))).alias("pos", "w"))
    return words.groupBy("w").agg(F.min(F.col("item_id") * 100000 + F.col("pos") + 1).alias("first_at")).orderBy("first_at").limit(300)


@query("SELECT doc_id, len(a) AS n_all, len(list_distinct(a)) AS n_distinct, len(list_intersect(list_distinct(a), ['the', 'of', 'de', 'und', 'que'])) AS n_common FROM (SELECT doc_id, " + TOK + " AS a FROM documents)")
def set_operations(spark, d):
    a = F.col("a")
    common = F.array(*map(F.lit, ("the", "of", "de", "und", "que")))
    return table(spark, d, "documents").select("doc_id", S.tokens(F.col("text")).alias("a")).select("doc_id", F.size(a).cast("long").alias("n_all"), F.size(F.array_distinct(a)).cast("long").alias("n_distinct"), F.size(F.array_intersect(a, common)).cast("long").alias("n_common"))
