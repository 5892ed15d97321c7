"""Claims, gaps, outlines, weights, keys, figures and guards, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.operators import review as R
from foliospark.sources import read_table

#: Orders back the claim "customers' nation n": by status O supporting, F contradicting; studies are customers.
_SUPPORT = """s AS (SELECT DISTINCT o_orderkey % 200 AS claim_id, o_custkey AS study, CASE WHEN o_orderstatus = 'F' THEN 'contradict' ELSE 'support' END AS role FROM orders)"""
_VERIFIED = f"""{_SUPPORT}, k AS (SELECT claim_id, study, CASE WHEN bool_or(role = 'support') THEN 'support' ELSE 'contradict' END AS role FROM s WHERE study % 5 <> 0 GROUP BY 1, 2),
    n AS (SELECT claim_id, count(*) FILTER (role = 'support') AS n_support, count(*) FILTER (role = 'contradict') AS n_contradict FROM k GROUP BY 1 HAVING count(*) FILTER (role = 'support') > 0),
    c AS (SELECT claim_id, CASE claim_id % 4 WHEN 0 THEN 'gap' ELSE 'finding' END AS kind, CASE claim_id % 3 WHEN 0 THEN 'balance' END AS moderator, n_support, n_contradict FROM n)"""


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read_table(spark, sf_dir, "orders")
    support = orders.select((F.col("o_orderkey") % 200).alias("claim_id"), F.col("o_custkey").alias("study"), F.when(F.col("o_orderstatus") == "F", "contradict").otherwise("support").alias("role")).distinct()
    base = support.select("claim_id").distinct().select(
        "claim_id", F.when(F.col("claim_id") % 4 == 0, "gap").otherwise("finding").alias("kind"), F.expr("CASE claim_id % 3 WHEN 0 THEN 'balance' WHEN 1 THEN 'unheard of' END").alias("moderator"),
    )
    studies = orders.select(F.col("o_custkey").alias("study")).distinct().filter("study % 5 != 0")
    return R.verify_claims(base, support, studies, ["balance"])


@register(oracle=f"WITH {_VERIFIED} SELECT * FROM c")
def q_claims_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir)[0].select("claim_id", "kind", "moderator", "n_support", "n_contradict")


@register(oracle=f"WITH {_VERIFIED} SELECT k.claim_id, k.study, k.role FROM k JOIN n USING (claim_id)")
def q_claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir)[1].select("claim_id", "study", "role")


@register(oracle=f"""
    WITH {_VERIFIED}, j AS (SELECT k.claim_id, k.role, c_acctbal AS v FROM k JOIN n USING (claim_id) JOIN customer ON c_custkey = study),
    m AS (SELECT claim_id, min(v) FILTER (role = 'support') AS a, max(v) FILTER (role = 'support') AS b, min(v) FILTER (role = 'contradict') AS c, max(v) FILTER (role = 'contradict') AS d FROM j GROUP BY 1)
    SELECT n.claim_id, coalesce(b < c OR d < a, FALSE) AS splits FROM n LEFT JOIN m USING (claim_id)""")
def q_moderators(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study"), F.col("c_acctbal").alias("value"))
    return R.moderator_splits(claims(spark, sf_dir)[1], values, True)


@register(oracle=f"""
    WITH {_VERIFIED}, j AS (SELECT k.claim_id, k.role, lower(c_mktsegment) AS v FROM k JOIN n USING (claim_id) JOIN customer ON c_custkey = study),
    a AS (SELECT claim_id, list(DISTINCT v) FILTER (role = 'support') AS x, list(DISTINCT v) FILTER (role = 'contradict') AS y FROM j GROUP BY 1)
    SELECT n.claim_id, coalesce(len(x) > 0 AND len(y) > 0 AND NOT list_has_any(x, y), FALSE) AS splits FROM n LEFT JOIN a USING (claim_id)""")
def q_moderators_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study"), F.col("c_mktsegment").alias("value"))
    return R.moderator_splits(claims(spark, sf_dir)[1], values, False)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("study"), F.col("c_mktsegment").alias("segment"), F.expr("cast(c_nationkey as string)").alias("nation"), F.lit("trial").alias("design"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'yes' END").alias("blinded"),
    )


@register(oracle="""
    SELECT 'no variation' AS kind, 'design' AS subject, '' AS detail UNION ALL SELECT 'no variation', 'blinded', '' UNION ALL SELECT 'mostly not reported', 'blinded', '' UNION ALL SELECT 'declared but unstudied', 'segment', 'SPACE'""")
def q_gaps_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SPACE"]
    return R.field_gaps(studies(spark, sf_dir), ["segment", "nation", "design", "blinded"], {"segment": segments})


@register(oracle="""
    WITH g AS (SELECT a.x, b.y FROM (VALUES ('AUTOMOBILE'), ('SPACE')) a(x), (VALUES ('1'), ('99')) b(y))
    SELECT 'combination unstudied' AS kind, 'segment x nation' AS subject, x || ' / ' || y AS detail FROM g WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = x AND c_nationkey::VARCHAR = y)""")
def q_gaps_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.combination_gaps(studies(spark, sf_dir), "segment", "nation", ["AUTOMOBILE", "SPACE"], ["1", "99"])


@register(oracle=f"""
    WITH {_VERIFIED} SELECT 'unreplicated' AS kind, claim_id FROM c WHERE n_support = 1 AND n_contradict = 0 UNION ALL SELECT 'disagreement unexplained', claim_id FROM c WHERE n_contradict > 0 AND moderator IS NULL
    UNION ALL SELECT 'stated as a gap', claim_id FROM c WHERE kind = 'gap'""")
def q_gaps_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.claim_gaps(claims(spark, sf_dir)[0])


@register(oracle=f"""
    WITH {_VERIFIED}, o AS (SELECT claim_id % 7 + 1 AS section_no, claim_id FROM c WHERE claim_id % 10 <> 9 UNION SELECT claim_id % 5 + 2, claim_id FROM c WHERE claim_id % 10 <> 9),
    p AS (SELECT claim_id, min(section_no) AS section_no FROM o JOIN c USING (claim_id) WHERE kind <> 'gap' GROUP BY 1)
    SELECT coalesce(section_no, 0)::BIGINT AS section_no, c.claim_id FROM c LEFT JOIN p USING (claim_id)""")
def q_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = claims(spark, sf_dir)[0]
    some = kept.filter("claim_id % 10 != 9")
    outline = some.select((F.col("claim_id") % 7 + 1).alias("section_no"), "claim_id").union(some.select(F.col("claim_id") % 5 + 2, "claim_id"))
    return R.place_claims(outline, kept).select(F.col("section_no").cast("bigint").alias("section_no"), "claim_id")


@register(oracle="""
    WITH u AS (SELECT p_partkey AS c, CASE WHEN p_partkey % 11 = 0 THEN -p_partkey ELSE p_size % 6 END AS a, CASE WHEN p_partkey % 13 = 0 THEN -p_partkey ELSE p_size % 4 END AS b FROM part WHERE p_partkey % 11 <> 0 OR p_partkey % 13 <> 0),
    n AS (SELECT a, b, count(*) AS n FROM u GROUP BY ALL), x AS (SELECT a, sum(n) AS n FROM n GROUP BY a), y AS (SELECT b, sum(n) AS n FROM n GROUP BY b)
    SELECT round(((SELECT sum(n * (n - 1) / 2) FROM x) + (SELECT sum(n * (n - 1) / 2) FROM y) - 2 * (SELECT sum(n * (n - 1) / 2) FROM n)) / (SELECT sum(n) * (sum(n) - 1) / 2 FROM n), 9) AS distance""")
def q_outline_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all parts; a test counts the pairs themselves on a small table."""
    return _outlines(read_table(spark, sf_dir, "part"))


def _outlines(part: DataFrame) -> DataFrame:
    a = part.filter("p_partkey % 11 != 0").select((F.col("p_size") % 6).alias("section"), F.col("p_partkey").alias("claim_id"))
    b = part.filter("p_partkey % 13 != 0").select((F.col("p_size") % 4).alias("section"), F.col("p_partkey").alias("claim_id"))
    return R.outline_distance(a, b).select(F.round("distance", 9).alias("distance"))


_WEIGHED = """w AS (SELECT c_custkey AS study, CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END AS s, c_custkey % 6 AS filled, c_custkey % 4 AS unverified FROM customer),
    x AS (SELECT study, round(0.5 + 0.5 * coalesce(s, (SELECT avg(s) FROM w)) / (SELECT max(s) FROM w) + 0.5 * CASE WHEN filled > 0 THEN greatest(filled - unverified, 0) / filled::DOUBLE ELSE 0.5 END, 6) AS weight FROM w)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study"), "c_acctbal", (F.col("c_custkey") % 6).alias("filled"), (F.col("c_custkey") % 4).alias("unverified"))
    return R.study_weight(rows, "c_acctbal", "filled", "unverified").select("study", F.round("weight", 6).alias("weight"))


@register(oracle=f"WITH {_WEIGHED} SELECT * FROM x")
def q_study_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir)


@register(oracle=f"""
    WITH {_VERIFIED}, {_WEIGHED}, o AS (SELECT k.claim_id, count(DISTINCT study) AS breadth, round(sum(weight), 6) AS mass FROM k JOIN n USING (claim_id) JOIN x USING (study) WHERE role = 'support' GROUP BY 1)
    SELECT claim_id, breadth, mass, row_number() OVER (ORDER BY breadth DESC, mass DESC, claim_id)::INTEGER AS position FROM o""")
def q_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.claim_order(claims(spark, sf_dir)[1], weights(spark, sf_dir))
    return out.select("claim_id", "breadth", F.round("mass", 6).alias("mass"), "position")


_LETTER = "CASE WHEN k <= 26 THEN chr((96 + k)::INTEGER) ELSE chr((96 + (k - 1) // 26)::INTEGER) || chr((97 + (k - 1) % 26)::INTEGER) END"


@register(oracle=f"""
    WITH b AS (SELECT p_partkey, p_brand || CASE p_partkey % 3 WHEN 1 THEN ' & Doe' WHEN 2 THEN ' et al.' ELSE '' END || ', ' || (2000 + p_size % 10) AS key, lower(p_name) AS t FROM part),
    r AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY t, p_partkey) AS k FROM b)
    SELECT p_partkey, CASE WHEN n > 1 THEN key || {_LETTER} ELSE key END AS cite FROM r""")
def q_bib_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = F.concat(F.col("p_brand"), F.expr("CASE p_partkey % 3 WHEN 1 THEN ', A; Doe, J' WHEN 2 THEN ', A; Doe, J; Roe, R' ELSE ', A' END"))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", R.author_year(authors, (2000 + F.col("p_size") % 10).cast("string")).alias("key"))
    return R.lettered_keys(rows, "key", "p_name", "p_partkey").select("p_partkey", "cite")


@register(oracle="""
    SELECT row_number() OVER (ORDER BY lower(s_name), 2000 + s_nationkey, s_suppkey)::INTEGER AS n, s_suppkey,
           s_name || '.' || CASE WHEN s_suppkey % 3 <> 0 THEN ' (' || (2000 + s_nationkey) || ').' ELSE '' END || ' Report ' || s_suppkey || '.' AS entry FROM supplier""")
def q_reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as references; every third has no year."""
    year = F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN cast(2000 + s_nationkey as string) END")
    title = F.concat(F.lit("Report "), F.col("s_suppkey").cast("string"), F.lit("."))
    return R.reference_list(read_table(spark, sf_dir, "supplier"), F.col("s_name"), year, title, "s_suppkey")


@register(oracle="""
    WITH s AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS total, min(l_quantity)::BIGINT AS low FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey AS sentence_id, 'total' AS number, TRUE AS backed FROM s UNION ALL SELECT l_orderkey, 'invented', FALSE FROM s""")
def q_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence an order that states its total quantity and a number nothing backs."""
    sums = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("total"))
    sentences = sums.select(F.col("l_orderkey").alias("sentence_id"), F.concat(F.lit("Together "), F.col("total").cast("string"), F.lit(" were shipped [study 3], and 987654 lost.")).alias("text"))
    targets = sums.select(F.col("l_orderkey").alias("sentence_id"), F.lit("total").alias("basis"), F.col("total").cast("double").alias("value"))
    out = R.check_figures(sentences, targets)
    return out.select("sentence_id", F.when(F.col("value") == 987654, "invented").otherwise("total").alias("number"), "backed")


#: Said behind each turn, one of them by its number.
_SAID = [
    "This may suggest a small effect.", "All trials prove it, and always did.", "Evidence is limited; further research could help, but none confirms.", "It was shown.", "Possibly few, seemingly many: no studies demonstrate it conclusively.",
    "Clear evidence shows that every arm gained.", "Consistently, invariably, it appears unproven.",
]
_SAID_SQL = "(['" + "', '".join(_SAID) + "'])[(conv_id + turn) % 7 + 1]"
_stems = lambda words, whole=False: r"'\b(?:" + "|".join(words) + (r")\b" if whole else ")") + "'"


@register(oracle=f"""
    WITH t AS (SELECT conv_id, turn, lower(text || ' ' || {_SAID_SQL}) AS t FROM conversations)
    SELECT conv_id, turn, len(regexp_extract_all(t, {_stems(R.HEDGES)}))::INTEGER AS hedges, len(regexp_extract_all(t, {_stems(R.BOOSTERS)}))::INTEGER AS boosters, len(regexp_extract_all(t, {_stems(R.UNIVERSALS, True)}))::INTEGER AS universals FROM t""")
def q_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as it is, with one of seven sentences behind it."""
    said = F.array(*[F.lit(x) for x in _SAID])[((F.col("conv_id") + F.col("turn")) % 7).cast("int")]
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), said).alias("t"))
    return R.strength(turns, "t").select("conv_id", "turn", "hedges", "boosters", "universals")


@register(oracle="""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN TRUE ELSE FALSE END AS holds FROM events""")
def q_strength_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lit("The trials may suggest a small effect [study 1].")
    after = F.expr("CASE event_id % 3 WHEN 0 THEN 'Trials may suggest a small effect [study 1].' WHEN 1 THEN 'All trials prove an effect [study 1].' ELSE 'The trials show that the effect is there [study 1].' END")
    pairs = read_table(spark, sf_dir, "events").select("event_id", before.alias("before"), after.alias("after"))
    return R.strength_guard(pairs).select("event_id", "holds")
