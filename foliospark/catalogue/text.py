"""Tokens, splitters, predicates, cleaners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import ORACLES, QUERIES, register
from foliospark.functions import clean as C
from foliospark.functions import text as X
from foliospark.functions.tokens import count_tokens
from foliospark.sources import read_table

WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"


@register(oracle=f"SELECT doc_id, {WORDS.format('text')}::INTEGER AS tokens FROM documents")
def q_tokens_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text"), "words").alias("tokens"))


@register(oracle=r"SELECT doc_id, CASE WHEN trim(text, E' \t\r\n') = '' THEN 0 ELSE ceil(length(text) / 4.0) END::INTEGER AS tokens FROM documents")
def q_tokens_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text"), "chars").alias("tokens"))


@register()
def q_tokens_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens"))


@register(oracle=rf"""
    WITH t AS (SELECT lang, {WORDS.format('text')} AS n FROM documents)
    SELECT lang, count(*) AS n, sum(n)::BIGINT AS total, min(n)::INTEGER AS min_tokens, median(n)::DOUBLE AS median_tokens,
           round(avg(n), 1) AS mean_tokens, max(n)::INTEGER AS max_tokens, sum(CASE WHEN n > 400 THEN 1 ELSE 0 END)::BIGINT AS over_cap
    FROM t GROUP BY lang""")
def q_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.operators.segment import chunk_stats

    docs = read_table(spark, sf_dir, "documents").select("lang", X.count_words(F.col("text")).alias("tokens"))
    return chunk_stats(docs, 400, "lang")


@register(oracle=r"""
    SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(
        lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}\s]', ' ', 'g')), '\s+'), lambda w: length(w) >= 2))), ' ')) AS terms FROM documents""")
def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_sort(F.array_distinct(X.lexical_terms(F.col("text"))))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(terms, " ")).alias("terms"))


_ABBREVIATED = "|".join(sorted((a.replace(".", r"\.") for a in X.ABBREVIATIONS), key=len, reverse=True))
#: RE2 looks neither ahead nor behind, so what stands around a cut is captured and put back; points inside numbers are
#: marked twice, for "1.2.3".
_GUARDED = r"""regexp_replace(regexp_replace(regexp_replace(text, '\b(""" + _ABBREVIATED + r""")\.', '\1' || chr(1), 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g')"""
_OPENING = r"""["''(\[«“„‘¿¡「『]?"""


@register(oracle=rf"""
    WITH g AS (SELECT doc_id, regexp_replace({_GUARDED}, '([.!?؟۔।॥])[ \t]+({_OPENING}[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}])', '\1' || chr(2) || '\2', 'g') AS t FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, chr(2) || '|\n{{2,}}'), lambda x: trim(regexp_replace(replace(x, chr(1), '.'), '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS ss FROM g),
    u AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS k FROM p)
    SELECT doc_id, k::INTEGER AS sentence_no, md5(sentence) AS sentence_md5, length(sentence)::INTEGER AS chars FROM u""")
def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(X.sentences_of(F.col("text"))).alias("sentence_no", "sentence"))
    return parts.select("doc_id", "sentence_no", F.md5("sentence").alias("sentence_md5"), F.length("sentence").alias("chars"))


@register(oracle=r"""
    SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\n([ \t]*\n)+'), lambda p: trim(p, E' \t\n\r') <> ''))::INTEGER AS paragraphs
    FROM conversations""")
def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.size(X.paragraphs_of(F.col("text"))).alias("paragraphs"))


#: Replies made from events, to run the answer predicates over.
REPLIES = """CASE CAST(event_id % 8 AS INTEGER) WHEN 0 THEN 'NOT_IN_DOCUMENT' WHEN 1 THEN '**NOT_IN_DOCUMENT.**' WHEN 2 THEN ''
    WHEN 3 THEN 'The log said NOT_IN_DOCUMENT, but revenue rose.' WHEN 4 THEN 'NONE' WHEN 5 THEN 'NOT_IN_DOCUMENT. The excerpt only covers costs.'
    WHEN 6 THEN 'FALSE_PREMISE: it was 2019' ELSE 'Not in document form; it was a table' END"""


@register(oracle=f"""
    WITH r AS (SELECT event_id, {REPLIES} AS reply FROM events)
    SELECT event_id, event_id % 8 IN (0, 1, 2, 5) AS not_found, event_id % 8 IN (0, 1, 2, 4, 5) AS none_reply, event_id % 8 = 6 AS premise FROM r""")
def q_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = read_table(spark, sf_dir, "events").select("event_id", F.expr(REPLIES).alias("reply"))
    reply = F.col("reply")
    return replies.select(
        "event_id", X.is_not_found(reply).alias("not_found"), X.is_none_reply(reply).alias("none_reply"), X.premise_split(reply)["flagged"].alias("premise")
    )


@register(oracle=rf"""
    WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
    SELECT doc_id, md5(CASE WHEN len(ws) <= 50 THEN text ELSE array_to_string(ws[1:49], ' ') || ' [...]' END) AS cut FROM w""")
def q_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(X.truncate_words(F.col("text"), 50)).alias("cut"))


@register(oracle=r"SELECT doc_id, text <> '' AND regexp_replace(text, '\s', '', 'g') <> '' AS visible FROM documents")
def q_has_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", X.has_content(F.col("text")).alias("visible"))


#: name -> DuckDB expression of what the cleaner leaves of {0}
_CLEAN = {
    "urls": r"regexp_replace({0}, '(?i)\b(?:https?://|www\.)\S+', '', 'g')",
    "emails": r"regexp_replace({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '', 'g')",
    "remove_numbers": r"regexp_replace({0}, '[0-9]+', ' ', 'g')",
    "remove_punctuation": r"regexp_replace({0}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')",
    "control_chars": r"regexp_replace(regexp_replace({0}, '[\x{{200b}}\x{{200e}}\x{{200f}}\x{{feff}}\x{{00ad}}]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')",
    "ligatures": "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '“', '\"'), '”', '\"'), '‘', ''''), '’', ''''), '…', '...')",
    "collapse_whitespace": r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?m)^[ \t]+$', '', 'g'), '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \t\r\n')",
    "lowercase": "lower({0})",
    "captions": r"regexp_replace({0}, '(?m)^[ \t]*(?i:figure|fig\.|table|tbl\.|exhibit|chart)[ \t]*S?\d+[A-Za-z]?(?:[ \t]*$|[ \t]*[.:|)–—].*$|[ \t]+-[ \t].*$|[ \t]+\p{{Lu}}.*$)', '', 'g')",
}
#: Turns with lines that the cleaners look for.
_NOISY = "concat(text, chr(10), 'Table 2. Results', chr(10), 'see https://example.com/a?b=1 or mail a.b@c.org, ﬁne “quoted”…', chr(10), 'Figure 3 shows more', chr(10), '  x   y', chr(9), chr(10), chr(10), chr(10), chr(10), 'z')"


def _cleaner_query(cleaner: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_NOISY).alias("noisy"))
        return turns.select("conv_id", "turn", F.md5(C.CLEANERS[cleaner].run(F.col("noisy"))).alias("cleaned"))

    return query


for _name, _sql in _CLEAN.items():
    register(f"q_clean_{_name}", f"WITH n AS (SELECT conv_id, turn, {_NOISY} AS noisy FROM conversations) SELECT conv_id, turn, md5({_sql.format('noisy')}) AS cleaned FROM n")(_cleaner_query(_name))

_PAGED = "concat('Page ', turn, ' of 9', chr(10), text, chr(10), '- 12 -', chr(10), 'total enrolled', chr(10), '1200.', chr(10), 'It ended.', chr(10), '13.', chr(10), '[7]')"


@register(oracle=f"""
    SELECT conv_id, turn, md5(concat('', chr(10), text, chr(10), '', chr(10), 'total enrolled', chr(10), '1200.', chr(10), 'It ended.', chr(10), '', chr(10), '')) AS cleaned
    FROM conversations""")
def q_clean_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_PAGED).alias("noisy"))
    return turns.select("conv_id", "turn", F.md5(C.CLEANERS["page_numbers"].run(F.col("noisy"))).alias("cleaned"))


@register(oracle="SELECT conv_id, turn, md5(concat(text, chr(10), text, chr(10))) AS cleaned FROM conversations")
def q_clean_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = "concat(text, chr(10), text, chr(10), 'References', chr(10), 'A. Author. Some title.')"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(noisy).alias("noisy"))
    return turns.select("conv_id", "turn", F.md5(C.CLEANERS["references"].run(F.col("noisy"))).alias("cleaned"))


@register(oracle="""SELECT conv_id, turn, md5(concat(text, ' mitochondria LIABLE follow-up 18-', chr(10), '65 a follow-up Anglo-', chr(10), 'Saxon')) AS cleaned FROM conversations""")
def q_hyphen_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = "concat(text, ' mito-', chr(10), 'chondria LIA-', chr(10), 'BLE follow-', chr(10), 'up 18-', chr(10), '65 a follow-up Anglo-', chr(10), 'Saxon')"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(noisy).alias("noisy"))
    return turns.select("conv_id", "turn", F.md5(C.CLEANERS["hyphenation"].run(F.col("noisy"))).alias("cleaned"))


@register(oracle=rf"""
    WITH a AS (SELECT doc_id, text AS t0 FROM documents),
    b AS (SELECT *, {_CLEAN['urls'].format('t0')} AS t1 FROM a), c AS (SELECT *, {_CLEAN['remove_numbers'].format('t1')} AS t2 FROM b),
    d AS (SELECT *, {_CLEAN['collapse_whitespace'].format('t2')} AS t3 FROM c)
    SELECT doc_id, 1 AS step_no, 'urls' AS step, (length(t0) - length(t1))::INTEGER AS chars_removed FROM d
    UNION ALL SELECT doc_id, 2, 'remove_numbers', (length(t1) - length(t2))::INTEGER FROM d
    UNION ALL SELECT doc_id, 3, 'collapse_whitespace', (length(t2) - length(t3))::INTEGER FROM d""")
def q_clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ["remove_numbers", "collapse_whitespace", "urls"]
    return C.clean_log(read_table(spark, sf_dir, "documents"), "doc_id", "text", steps).select("doc_id", "step_no", "step", "chars_removed")


@register(oracle="""
    WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
    h AS (SELECT source, line FROM l WHERE (i = 1 OR i = n) AND trim(line) <> '' AND length(line) <= 80 GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3),
    k AS (SELECT l.*, h.line IS NOT NULL AND (i = 1 OR i = n) AS gone FROM l LEFT JOIN h USING (source, line))
    SELECT source, doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS cleaned FROM k GROUP BY source, doc_id""")
def q_clean_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.drop_running_heads(read_table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")
    return out.select("source", "doc_id", F.md5("text").alias("cleaned"))


_EDGES = "string_split_regex(t, '\\n{2,}')"


@register(oracle=f"""
    WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
    b AS (SELECT doc_id, t, flatten(list_transform({_EDGES}, lambda x: list_distinct([string_split(x, chr(10))[1], string_split(x, chr(10))[-1]]))) AS ls FROM d),
    r AS (SELECT doc_id, t, list_filter(list_distinct(ls), lambda x: trim(x) <> '' AND length(x) <= 80 AND len(list_filter(ls, lambda y: y = x)) >= 3) AS again FROM b)
    SELECT doc_id, md5(CASE WHEN len(again) = 0 THEN t ELSE array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(again, x)), chr(10)) END) AS cleaned FROM r""")
def q_clean_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a paragraph of its own."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return docs.select("doc_id", F.md5(C.CLEANERS["headers_footers"].run(F.col("t"))).alias("cleaned"))


@register(oracle=r"""
    WITH d AS (SELECT doc_id, replace(replace(replace(nfc_normalize(text), 'ß', ' '), 'æ', ' '), 'œ', ' ') AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(strip_accents(t), '[^\x00-\x7F]', ' ', 'g')) AS cleaned FROM d""")
def q_clean_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(C.CLEANERS["ascii_only"].run(F.col("text"))).alias("cleaned"))


@register()
def q_clean_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_NOISY).alias("noisy"))
    return turns.select("conv_id", "turn", *[F.length(C.clean(F.col("noisy"), p)).alias(f"chars_{p}") for p in C.PRESETS])


__all__ = ["ORACLES", "QUERIES"]
