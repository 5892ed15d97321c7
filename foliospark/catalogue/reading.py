"""Readers over conversations with a deterministic stand-in for the model; costs, routing, recipes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.catalogue.segments import _pack_sql, blocks_of
from foliospark.functions.text import count_words
from foliospark.operators import extract as E
from foliospark.operators import model as M
from foliospark.operators import segment as S
from foliospark.operators.model import Client, mock_client
from foliospark.plans import readers as P
from foliospark.plans import runs as U
from foliospark.session import ensure_checkpoint_dir
from foliospark.sources import read_table

QUESTION = "What does the text say about thanedble?"


def stand_in(prompt: str) -> str:
    """The lines of a prompt's body that hold "the", the first three of them; NOT_IN_DOCUMENT without one. Marks,
    plans, steps, decisions and records are made from the body in ways that SQL can follow."""
    head, _, body = prompt.partition("\n\n")
    kind = head.split(":", 1)[0]
    if kind == P.MARK:
        return str(len(body) % 11)
    if kind == P.PLAN:
        return "1, 4"
    if kind == P.SCREEN:
        words = body.partition("\n\n")[2].split()
        said = [("exclude", "1. OFF topic"), ("Exclude", "I felt so"), ("maybe", None)]
        decision, criterion = said[words.count("the")] if words.count("the") < 3 else ("include", None)
        return json.dumps({"decision": decision, "criterion": criterion, "reason": "r", "quote": " ".join(words[:5])})
    if kind == P.FILL:
        text = body.partition("\n\n")[2].partition("]\n")[2]
        words, lines = text.split(), [line for line in text.split("\n") if "the" in line.split()]
        return json.dumps({"the_count": str(words.count("the")) if lines else None, "the_count__quote": lines[0] if lines else None, "opening": words[0], "opening__quote": "zzzz said nowhere", "numbered": "n/a"})
    lines = [line for line in body.split("\n") if "the" in line.split()]
    if kind == P.STEP:
        query = body.partition("\n")[0]
        return json.dumps({"can_answer": len(lines) > 1, "answer": "\n".join(lines[:3]), "next_query": f"{query.removeprefix('QUERY: ')} and", "quotes": lines[:1]})
    if kind == P.EVIDENCE and not lines:
        return "NONE"
    return "\n".join(lines[:3]) if lines else "NOT_IN_DOCUMENT"


CLIENT: Client = mock_client(stand_in)
CAP = 60


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment(blocks_of(spark, sf_dir), S.SegmentSpec("paragraph", CAP)).select("document", "chunk_id", "text", "tokens")


def _shown(answers: DataFrame, calls: bool = True) -> DataFrame:
    out = answers.select("document", "reader", "answer", "not_found", "partial", F.array_join("chunks_used", ",").alias("chunks_used"), "calls")
    return out if calls else out.drop("calls")


def _reader_query(name: str, spec: P.ReadSpec):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(P.read(chunks_of(spark, sf_dir), QUESTION, CLIENT, spec), name not in UNCOUNTED)

    query.__name__ = f"q_reader_{name}"
    return query


SPECS = {
    "stuff": P.ReadSpec("stuff"), "map_reduce": P.ReadSpec("map_reduce", budget=120), "map_reduce_merged": P.ReadSpec("map_reduce", budget=400), "refine": P.ReadSpec("refine"), "skim": P.ReadSpec("skim"),
    "retrieve": P.ReadSpec("retrieve", top_k=3, arrange="edges", embedder=None), "retrieve_hybrid": P.ReadSpec("retrieve", top_k=3, arrange="edges", weight=0.7), "rerank": P.ReadSpec("rerank", prefilter=8, top_k=3),
    "hierarchical": P.ReadSpec("hierarchical", budget=120, fan_in=3), "iterative": P.ReadSpec("iterative", top_k=2), "preview": P.ReadSpec("preview"), "ensemble": P.ReadSpec("ensemble", members=("stuff", "skim", "refine")),
}
#: Calls of a merge tree follow the words of what was merged; a test counts them, their SQL does not.
UNCOUNTED = {"map_reduce_merged", "hierarchical"}

#: The chunks with their lines that hold "the", and a document's lines, chunk ids and hits.
CHUNKS_SQL = _pack_sql(CAP).replace("SELECT document, chunk_id::INTEGER AS chunk_id, tokens, md5(body) AS text_md5 FROM o", "")
_LINES = rf"""{CHUNKS_SQL}, z_l AS (SELECT document, chunk_id, tokens, body, list_filter(string_split(body, chr(10)), lambda x: list_contains(string_split_regex(x, '\s+'), 'the')) AS ls FROM o),
    z_d AS (SELECT document, flatten(list(ls ORDER BY chunk_id)) AS ls, list(chunk_id ORDER BY chunk_id) AS ids, count(*) AS n, coalesce(list(chunk_id ORDER BY chunk_id) FILTER (len(ls) > 0), []) AS hit FROM z_l GROUP BY document)"""
_SAID = "CASE WHEN len({0}) = 0 THEN 'NOT_IN_DOCUMENT' ELSE trim(array_to_string(({0})[1:3], chr(10))) END"


def _answer_sql(reader: str, ids: str, calls: str | None, lines: str = "ls", source: str = "z_d") -> str:
    counted = f", ({calls})::BIGINT AS calls" if calls else ""
    return f"SELECT document, '{reader}' AS reader, {_SAID.format(lines)} AS answer, len({lines}) = 0 AS not_found, FALSE AS partial, array_to_string({ids}, ',') AS chunks_used{counted} FROM {source}"


def _scores_sql() -> str:
    """BM25 of the question's terms inside each document."""
    terms = sorted({"what", "does", "the", "text", "say", "about", "thanedble"})
    f = ", ".join(f"len(list_filter(ts, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
    total = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * (f{i} * 2.5) / (f{i} + 1.5 * (0.25 + 0.75 * len / avg))" for i in range(len(terms)))
    return rf"""z_t AS (SELECT document, chunk_id, list_filter(string_split_regex(lower(regexp_replace(body, '[^\p{{L}}\p{{M}}\p{{N}}\s]', ' ', 'g')), '\s+'), lambda w: length(w) >= 2) AS ts FROM z_l),
    z_r AS (SELECT document, chunk_id, len(ts) AS len, {f} FROM z_t), z_st AS (SELECT document, count(*) AS n, coalesce(avg(CASE WHEN len > 0 THEN len END), 1.0) AS avg, {df} FROM z_r GROUP BY document),
    z_b AS (SELECT z_r.document, z_r.chunk_id, row_number() OVER (PARTITION BY z_r.document ORDER BY round({total}, 9) DESC, z_r.chunk_id) AS rank FROM z_r JOIN z_st USING (document))"""


_TOLD = "trim(array_to_string(ls[1:3], chr(10)))"
READER_SQL = {
    "stuff": f"{_LINES} {_answer_sql('stuff', 'ids', '1')}",
    "map_reduce_merged": f"{_LINES} {_answer_sql('map_reduce', 'hit', None)}",
    "hierarchical": f"{_LINES} {_answer_sql('hierarchical', 'ids', None)}",
    "skim": f"{_LINES} {_answer_sql('skim', 'hit', 'n + CASE WHEN len(hit) > 0 THEN 1 ELSE 0 END')}",
    "refine": f"{_LINES} {_answer_sql('refine', 'list_filter(ids, lambda i: len(hit) > 0 AND i >= hit[1])', 'n')}",
    "ensemble": rf"""{_LINES}, z_e AS (SELECT * REPLACE (CASE WHEN len(ls) = 0 THEN ls ELSE list_filter(string_split('[refine] ' || {_TOLD} || chr(10) || '[skim] ' || {_TOLD} || chr(10) || '[stuff] ' || {_TOLD}, chr(10)),
        lambda x: list_contains(string_split_regex(x, '\s+'), 'the')) END AS ls) FROM z_d) {_answer_sql('ensemble', 'ids', '2 * n + 2 + CASE WHEN len(hit) > 0 THEN 1 ELSE 0 END', source='z_e')}""",
    "preview": f"""{_LINES}, z_u AS (SELECT *, floor((row_number() OVER w - 1) * least(count(*) OVER (PARTITION BY document), {P.GROUPS}) / count(*) OVER (PARTITION BY document)) + 1 AS unit, count(*) OVER (PARTITION BY document) AS n
        FROM z_l WINDOW w AS (PARTITION BY document ORDER BY chunk_id)), z_p AS (SELECT document, flatten(list(ls ORDER BY chunk_id)) AS ls, list(chunk_id ORDER BY chunk_id) AS ids, any_value(n) AS n FROM z_u WHERE unit IN (1, 4) GROUP BY document)
        {_answer_sql('preview', 'ids', 'CASE WHEN n > 1 THEN 2 ELSE 1 END', source='z_p')}""",
    "retrieve": f"""{_LINES}, {_scores_sql()}, z_k AS (SELECT *, count(*) OVER (PARTITION BY document) AS m FROM z_b JOIN z_l USING (document, chunk_id) WHERE rank <= 3),
        z_p AS (SELECT document, flatten(list(ls ORDER BY CASE WHEN m < 3 OR rank % 2 = 1 THEN rank ELSE 2 * m + 2 - rank END)) AS ls, list(chunk_id ORDER BY chunk_id) AS ids FROM z_k GROUP BY document) {_answer_sql('retrieve', 'ids', '1', source='z_p')}""",
    "rerank": f"""{_LINES}, {_scores_sql()}, z_m AS (SELECT *, length('[chunk ' || chunk_id || ']' || chr(10) || body) % 11 AS mark FROM z_b JOIN z_l USING (document, chunk_id) WHERE rank <= 8),
        z_k AS (SELECT * FROM z_m WHERE mark >= 4 QUALIFY row_number() OVER (PARTITION BY document ORDER BY mark DESC, chunk_id) <= 3),
        z_q AS (SELECT document, flatten(list(ls ORDER BY chunk_id)) AS ls, list(chunk_id ORDER BY chunk_id) AS ids FROM z_k GROUP BY document),
        z_p AS (SELECT document, coalesce(ls, []) AS ls, coalesce(ids, []) AS ids, n, ids IS NOT NULL AS final FROM (SELECT document, count(*) AS n FROM z_m GROUP BY document) LEFT JOIN z_q USING (document))
        {_answer_sql('rerank', 'ids', 'n + CASE WHEN final THEN 1 ELSE 0 END', source='z_p')}""",
}
for _name, _spec in SPECS.items():
    register(f"q_reader_{_name}", READER_SQL.get(_name))(_reader_query(_name, _spec))

_SIZES = r"s AS (SELECT conv_id::VARCHAR AS document, count(*) AS n, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS words FROM conversations GROUP BY conv_id)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.sum(count_words(F.col("text"))).alias("words"))


@register(oracle=f"""WITH {_SIZES}
    SELECT document, 1::BIGINT AS stuff, (n + ceil(n / 5.0))::BIGINT AS map_reduce, n AS refine, n + 1 AS skim, 1::BIGINT AS retrieve, least(20, n) + 1 AS rerank,
           (n + ceil(n / 5.0) + 1)::BIGINT AS hierarchical, 5::BIGINT AS iterative, n AS extract, 1::BIGINT AS screen, n AS preview,
           (1 + n + ceil(n / 5.0) + n + 1)::BIGINT AS ensemble FROM s""")
def q_reader_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["stuff", "map_reduce", "refine", "skim", "retrieve", "rerank", "hierarchical", "iterative", "extract", "screen", "preview", "ensemble"]
    return _sizes(spark, sf_dir).select("document", *[P.expected_calls(n, "n").alias(n) for n in names])


@register(oracle="""
    WITH RECURSIVE g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), w AS (
        SELECT user_id, n, 0 AS levels FROM g UNION ALL SELECT user_id, (n + 4) // 5, levels + 1 FROM w WHERE n > 1)
    SELECT user_id, max(levels)::INTEGER AS levels FROM w GROUP BY user_id""")
def q_tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a tree of fan-in five over each user's events, as a fold with a bound (5**27 leaves)."""
    counts = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    levels = F.expr("aggregate(sequence(1, 27), named_struct('n', n, 'k', 0), (s, i) -> if(s.n > 1, named_struct('n', (s.n + 4) div 5, 'k', s.k + 1), s), s -> s.k)")
    return counts.select("user_id", levels.alias("levels"))


@register(oracle=f"WITH {_SIZES} SELECT document, CASE WHEN words <= 150 THEN 'fast' ELSE 'thorough' END AS recipe FROM s")
def q_auto_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("document", P.auto_route(F.col("words"), 300).alias("recipe"))


@register()
def q_answer_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under the recipe that its size routes it to."""
    return _shown(P.answer_documents(blocks_of(spark, sf_dir), QUESTION, CLIENT, "auto", 300))


@register(oracle="SELECT * FROM (VALUES ('fast'), ('precise'), ('needle'), ('thorough'), ('survey'), ('narrative'), ('scanned'), ('research'), ('consensus'), ('legacy')) v(recipe)")
def q_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in P.RECIPES], "recipe string")


@register(oracle=f"""{CHUNKS_SQL}, k AS (SELECT document, count(*) AS n, sum(tokens) AS words FROM o GROUP BY document)
    SELECT document, (2 * n - 1)::BIGINT AS map_reduce, (2 * n)::BIGINT AS skim, n + 2 AS preview, least(4, n) AS iterative, (least(words, 4000) + 7)::BIGINT AS stuff_tokens, (words + n * 7)::BIGINT AS extract_tokens FROM k""")
def q_reader_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens that readers take at most."""
    sizes = chunks_of(spark, sf_dir).groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("words"))
    most = [P.most_calls(r, "n").alias(r) for r in ("map_reduce", "skim", "preview", "iterative")]
    return sizes.select("document", *most, P.most_tokens("stuff", "n", "words", 7).alias("stuff_tokens"), P.most_tokens("extract", "n", "words", 7).alias("extract_tokens"))


# ---------------------------------------------------------------- runs
_ROOTS = "z_b0 AS (SELECT conv_id::VARCHAR AS document, list(text ORDER BY turn) AS ts FROM conversations GROUP BY ALL), roots AS (SELECT document, min(document) OVER (PARTITION BY ts) AS root FROM z_b0)"
_SCREEN_CAP = 100


@register(oracle=rf"""{CHUNKS_SQL}, {_ROOTS}, z_run AS (SELECT *, sum(tokens) OVER (PARTITION BY document ORDER BY chunk_id) AS upto, sum(tokens) OVER (PARTITION BY document) AS whole FROM o),
    z_p AS (SELECT document, sum(tokens)::BIGINT AS seen_tokens, any_value(whole)::BIGINT AS document_tokens, list_filter(string_split_regex(string_agg(body, ' ' ORDER BY chunk_id), '\s+'), lambda x: x <> '') AS ws FROM z_run WHERE upto <= {_SCREEN_CAP} OR chunk_id = 1 GROUP BY document),
    z_k AS (SELECT *, len(list_filter(ws, lambda x: x = 'the')) AS n FROM z_p)
    SELECT roots.document, CASE WHEN n = 0 THEN 'exclude' WHEN n = 1 THEN 'unclear' WHEN n > 2 THEN 'include' END AS decision, CASE WHEN n = 1 THEN 'exclusion without a listed criterion: r' ELSE 'r' END AS reason,
           CASE n WHEN 0 THEN '1. OFF topic' WHEN 1 THEN 'I felt so' END AS criterion, CASE n WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS criterion_valid, array_to_string(ws[1:5], ' ') AS quote, TRUE AS verified,
           seen_tokens, document_tokens, seen_tokens < document_tokens AS truncated, CASE WHEN roots.document = root THEN 'ok' ELSE 'duplicate' END AS status, nullif(root, roots.document) AS duplicate_of
    FROM roots JOIN z_k ON z_k.document = root""")
def q_screen_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the openings of all conversations."""
    return U.screen_documents(blocks_of(spark, sf_dir), QUESTION, CLIENT, ["On topic"], ["Off topic", "Wrong language"], _SCREEN_CAP, chunks=chunks_of(spark, sf_dir)).drop("error")


EXTRACTED = [E.Field("the_count", "integer"), E.Field("opening", "string"), E.Field("numbered", "boolean")]
_FILLED = rf"""{CHUNKS_SQL}, {_ROOTS}, z_w AS (SELECT document, chunk_id, body, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS ws FROM o),
    z_f AS (SELECT document, chunk_id, nullif(len(list_filter(ws, lambda x: x = 'the')), 0) AS c, ws[1] AS first FROM z_w),
    z_g AS (SELECT document, count(*) AS calls, min_by(c, chunk_id) FILTER (c IS NOT NULL) AS the_count, min_by(first, chunk_id) AS opening, count(DISTINCT c) AS nc, count(DISTINCT lower(first)) AS nf FROM z_f GROUP BY document)"""


@register(oracle=rf"""{_FILLED} SELECT roots.document, the_count::BIGINT AS the_count, opening, NULL::BOOLEAN AS numbered, (CASE WHEN the_count IS NULL THEN 1 ELSE 2 END)::INTEGER AS n_filled, 2::BIGINT AS n_unverified,
           array_to_string(list_filter([CASE WHEN nf > 1 THEN 'opening' END, CASE WHEN nc > 1 THEN 'the_count' END], lambda x: x IS NOT NULL), ', ') AS conflicts, calls, CASE WHEN roots.document = root THEN 'ok' ELSE 'duplicate' END AS status, nullif(root, roots.document) AS duplicate_of
    FROM roots JOIN z_g ON z_g.document = root""")
def q_extract_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields filled from every chunk of all conversations."""
    return U.extract_documents(blocks_of(spark, sf_dir), EXTRACTED, QUESTION, CLIENT, chunks=chunks_of(spark, sf_dir))[0]


@register(oracle=rf"""{_FILLED}, firsts AS (SELECT DISTINCT root FROM roots)
    SELECT document, 'opening' AS field, chunk_id::INTEGER AS chunk_id, first AS value, FALSE AS verified FROM z_f JOIN firsts ON document = root UNION ALL SELECT document, 'numbered', chunk_id, 'n/a', FALSE FROM z_f JOIN firsts ON document = root
    UNION ALL SELECT document, 'the_count', chunk_id, c::VARCHAR, TRUE FROM z_f JOIN firsts ON document = root WHERE c IS NOT NULL""")
def q_extract_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chunk said, and whether it holds the quotation."""
    evidence = U.extract_documents(blocks_of(spark, sf_dir), EXTRACTED, QUESTION, CLIENT, chunks=chunks_of(spark, sf_dir))[1]
    return evidence.select("document", "field", "chunk_id", "value", "verified")


@register(oracle=rf"""{_FILLED} SELECT row_number() OVER (ORDER BY roots.document)::BIGINT AS study, roots.document FROM roots JOIN z_g ON z_g.document = root WHERE roots.document = root""")
def q_usable_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = U.extract_documents(blocks_of(spark, sf_dir), EXTRACTED, QUESTION, CLIENT, chunks=chunks_of(spark, sf_dir))[0]
    return U.usable_studies(table).select("study", "document")


@register(oracle=f"{_LINES} SELECT (SELECT count(*) FROM (SELECT DISTINCT body, chunk_id FROM z_l)) AS n_distinct, 40 AS sent, 0 AS beyond")
def q_desk_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader at a desk with a ceiling of 40 calls: distinct requests, calls that were sent, calls beyond it."""
    ensure_checkpoint_dir(spark)
    desk = M.Desk(CLIENT, f"{spark.sparkContext.getCheckpointDir()}/desk-{uuid.uuid4().hex}", M.Governor(max_calls=40))
    P.read(chunks_of(spark, sf_dir), QUESTION, desk, P.ReadSpec("map_reduce", budget=120)).write.format("noop").mode("overwrite").save()
    told = desk.ledger(spark).filter("turn = 0")
    sent = F.sum(F.when(F.col("refused").isNull(), 1).otherwise(0))
    later = desk.ledger(spark).filter("turn > 0 and refused is null and not cached").agg(F.count(F.lit(1)).cast("int").alias("beyond"))
    return told.agg(F.count(F.lit(1)).alias("n_distinct"), sent.cast("int").alias("sent")).crossJoin(F.broadcast(later))  # one row each


@register(oracle=f"{_LINES} {_answer_sql('stuff', 'ids', '1')}")
def q_desk_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's answers the second time, all from the cache of the first."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/desk-{uuid.uuid4().hex}"
    P.read(chunks_of(spark, sf_dir), QUESTION, M.Desk(CLIENT, folder), P.ReadSpec("stuff")).write.format("noop").mode("overwrite").save()
    return _shown(P.read(chunks_of(spark, sf_dir), QUESTION, M.Desk(M.mock_client(_silent), folder, M.Governor(max_calls=0)), P.ReadSpec("stuff")))


def _silent(prompt: str) -> str:
    raise OSError("nothing may be sent")
