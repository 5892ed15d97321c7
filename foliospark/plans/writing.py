"""The model passes that write: claims drawn in batches and merged, outlines, sections with checked citations, revisions.

Texts travel as rows; what is decided in one place (which claims merge, which sections there are) is a list of ids that
one prompt can hold, and its size is checked before the prompt is built.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import count_words, has_content, sentences_of, squeeze, text_or_empty
from foliospark.operators import review as R
from foliospark.operators import verify as V
from foliospark.operators.graph import connected_components
from foliospark.operators.model import Client, call, read_json
from foliospark.operators.rank import global_rank
from foliospark.session import cut

#: Tokens a claims reply takes by itself and for each study, kinds of claims, passes of a revision.
REPLY_BASE, REPLY_PER_STUDY = 400, 40
KINDS = ("finding", "method", "gap")
PASSES = ("structure", "cut", "register")
#: Studies are batched inside ranges of so many ids, so no task folds more than a range.
RANGE = 2000
#: Claims that one prompt may list.
MOST = 1000
CLAIMS, MERGE_CLAIMS, OUTLINE, WRITE, JOIN, REVISE = "CLAIMS", "SAME", "OUTLINE", "WRITE", "JOIN", "REVISE"
_CLAIMS = "claims array<struct<claim: string, kind: string, moderator: string, scope: string, studies: array<string>, contradicts: array<string>>>"
_GROUPS = "groups array<array<string>>"
_SECTIONS = "sections array<struct<heading: string, brief: string, claims: array<string>>>"


def _ids(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def _prompt(kind: str, question: str, body: Column) -> Column:
    return F.concat(F.lit(f"{kind}: {question}\n\n"), body)


# ---------------------------------------------------------------- batches
def studies_per_batch(reply_tokens: int) -> int:
    """How many studies a call may show and still have room to answer."""
    return max(1, (reply_tokens - REPLY_BASE) // REPLY_PER_STUDY)


def study_batches(studies: DataFrame, budget: int, most: int | None = None) -> DataFrame:
    """(study, batch) of studies(study, tokens): in order of id, a batch is full when the next study would pass the
    budget or it holds ``most``. A study beyond the budget has a batch of its own; a range of RANGE ids ends one too."""
    full = f"s.t + x.tokens > {budget}" + (f" or s.n >= {most}" if most else "")
    fold = F.expr(
        "aggregate(u, named_struct('g', 0, 't', 0L, 'n', 0, 'o', cast(array() as array<int>)),"
        f" (s, x) -> if(s.n > 0 and ({full}), named_struct('g', s.g + 1, 't', x.tokens, 'n', 1, 'o', concat(s.o, array(s.g + 1))),"
        " named_struct('g', s.g, 't', s.t + x.tokens, 'n', s.n + 1, 'o', concat(s.o, array(s.g)))), s -> s.o)"
    )
    ranged = studies.select(F.floor(F.col("study") / RANGE).alias("r"), F.struct("study", F.col("tokens").cast("bigint").alias("tokens")).alias("x"))
    lists = ranged.groupBy("r").agg(F.array_sort(F.collect_list("x")).alias("u")).withColumn("o", fold)
    return lists.select("r", F.explode(F.arrays_zip("u", "o")).alias("z")).select("z.u.study", (F.col("r") * RANGE + F.col("z.o")).cast("bigint").alias("batch"))


def render_studies(studies: DataFrame, fields: list[str]) -> DataFrame:
    """(study, text): a line for the id and one for each field; null fields are "not reported"."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("not reported"))) for f in fields]
    return studies.select("study", F.array_join(F.array(F.concat(F.lit("[study "), F.col("study").cast("string"), F.lit("]")), *lines), "\n").alias("text"))


# ---------------------------------------------------------------- claims
def draw_claims(studies: DataFrame, question: str, client: Client, moderators: list[str], budget: int = 6000, reply_tokens: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, support, batches) of studies(study, text): a call a batch, each claim held to the studies it was shown.

    batches(batch, n_studies, status) tells a batch without claims (ok) from one whose reply was lost (failed) or
    stopped at its limit (cut_off). Claims without a study they were shown are dropped.
    """
    sized = studies.select(F.col("study").cast("bigint").alias("study"), "text")
    placed = study_batches(sized.select("study", (count_words(F.col("text")) + 2).alias("tokens")), budget, studies_per_batch(reply_tokens))
    shown = sized.join(placed, "study").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("study", "text"))).alias("u"))
    shown = shown.select("batch", F.transform("u", lambda x: x["study"]).alias("shown"), _prompt(CLAIMS, question, F.array_join(F.transform("u", lambda x: x["text"]), "\n\n")).alias("prompt"))
    asked = call(shown, client).withColumn("said", F.when(F.col("ok"), read_json(F.col("reply"), _CLAIMS)["claims"]))
    cut_off = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    asked = cut(asked.select("batch", "shown", "said", F.when(cut_off & F.col("said").isNull(), "cut_off").when(F.col("said").isNull(), "failed").otherwise("ok").alias("status")))
    rows = asked.select("batch", "shown", F.posexplode("said").alias("n", "c")).filter(has_content(F.col("c.claim")))
    rows = rows.withColumn("claim_id", F.col("batch") * 10_000 + F.col("n"))  # more claims than a reply can hold
    kind = F.lower(F.trim(text_or_empty(F.col("c.kind"))))
    claims = rows.select("claim_id", F.trim("c.claim").alias("claim"), F.when(kind.isin(*KINDS), kind).otherwise(KINDS[0]).alias("kind"), "c.moderator", "c.scope", F.lit(None).cast("string").alias("note"))
    side = lambda c, role: F.transform(F.array_intersect(_ids(F.col(c)), F.col("shown")), lambda s: F.struct(s.alias("study"), F.lit(role).alias("role")))
    support = rows.select("claim_id", F.explode_outer(F.concat(side("c.studies", "support"), side("c.contradicts", "contradict"))).alias("x"))
    kept, checked = R.verify_claims(claims, support.filter("x is not null").select("claim_id", "x.study", "x.role"), sized.select("study"), moderators)
    return kept, checked, asked.select("batch", F.size("shown").alias("n_studies"), "status")


def reconcile_claims(claims: DataFrame, support: DataFrame, question: str, client: Client, most: int = MOST) -> tuple[DataFrame, DataFrame, str | None]:
    """(claims, support, reason) with claims that one reply calls the same merged into the first one's id.

    The prompt lists wordings only, so no study can be invented. A group keeps its longest wording, its first
    moderator, its longest scope and all studies; ``note`` names the wordings it absorbed and the studies that stood
    on both sides. A claim in two groups of a reply stays in the first; one in none keeps its own. More than ``most``
    claims are dealt out in halves of a prompt, and each two halves meet in one, so any two claims are seen together;
    groups that share a claim are one then. ``reason`` says why nothing was merged, or that some replies were lost.
    """
    n = claims.count()
    if n < 2:
        return claims, support, None
    half = max(1, most // 2)
    last = 0 if n <= most else (n - 1) // half
    numbered = cut(global_rank(claims, "no", "claim_id").withColumn("part", F.when(F.lit(last == 0), F.lit(0)).otherwise(F.floor((F.col("no") - 1) / half)).cast("int")))
    if last == 0:
        placed = numbered.select("no", "claim", F.lit(0).alias("x"), F.lit(0).alias("y"))
    else:
        meets = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(last)))).filter("part != other")
        placed = meets.select("no", "claim", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    listed = placed.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("no", "claim"))).alias("u"))  # at most ``most`` claims each
    body = F.array_join(F.transform("u", lambda x: F.concat(x["no"].cast("string"), F.lit(". "), x["claim"])), "\n")
    shown = F.transform("u", lambda x: x["no"])
    asked = cut(call(listed.select("x", "y", shown.alias("shown"), _prompt(MERGE_CLAIMS, question, body).alias("prompt")), client).select("x", "y", "shown", F.when(F.col("ok"), read_json(F.col("reply"), _GROUPS)["groups"]).alias("groups")))
    lost = asked.filter("groups is null").count()
    if lost == (last * (last + 1) // 2 or 1):
        return claims, support, "the reply was lost or is no list of groups"
    reason = f"{lost} of {last * (last + 1) // 2} replies were lost" if lost else None
    said = asked.select("x", "y", "shown", F.posexplode("groups").alias("g", "members")).select("x", "y", "g", F.explode(F.array_intersect(_ids(F.col("members")), "shown")).alias("no"))
    place = said.groupBy("x", "y", "no").agg(F.min("g").alias("g"))
    heads_of = place.groupBy("x", "y", "g").agg(F.min("no").alias("head"))
    joined = connected_components(place.join(heads_of, ["x", "y", "g"]).select(F.col("no").alias("a"), F.col("head").alias("b")))
    grouped = numbered.drop("part").join(joined.withColumnRenamed("node", "no"), "no", "left").withColumn("g", F.coalesce("label", "no")).drop("label")
    heads = grouped.groupBy("g").agg(F.min("claim_id").alias("head"))
    moved = support.join(grouped.select("claim_id", "g").join(heads, "g"), "claim_id").groupBy(F.col("head").alias("claim_id"), "study").agg(
        F.max(F.col("role") == "support").alias("s"), F.max(F.col("role") == "contradict").alias("c"),
    )
    moved = cut(moved)
    tally = moved.groupBy("claim_id").agg(
        F.sum(F.col("s").cast("int")).alias("n_support"), F.sum((~F.col("s")).cast("int")).alias("n_contradict"),
        F.array_sort(F.collect_list(F.when(F.col("s") & F.col("c"), F.col("study")))).alias("flipped"),
    )
    merged = grouped.groupBy("g").agg(
        F.min("claim_id").alias("claim_id"), F.max_by("claim", F.struct(F.length("claim"), -F.col("no"))).alias("claim"), F.min_by("kind", "no").alias("kind"),
        F.min_by("moderator", F.when(F.col("moderator").isNotNull(), F.col("no"))).alias("moderator"),
        F.max_by("scope", F.when(F.col("scope").isNotNull(), F.struct(F.length("scope"), -F.col("no")))).alias("scope"),
        F.array_sort(F.collect_list(F.struct("no", "claim", "note"))).alias("m"),
    )
    others = F.array_distinct(F.filter(F.transform("m", lambda x: x["claim"]), lambda w: squeeze(w) != squeeze(F.col("claim"))))
    absorbed = F.when(F.size(others) > 0, F.concat(F.lit("also worded as "), F.array_join(F.transform(others, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), "; ")))
    flipped = F.when(F.size("flipped") > 0, F.concat(F.lit("on both sides before merging, counted as support: study "), F.array_join(F.transform("flipped", lambda s: s.cast("string")), ", ")))
    earlier = F.filter(F.transform("m", lambda x: x["note"]), lambda w: w.isNotNull())
    notes = F.array_distinct(F.concat(earlier, F.filter(F.array(absorbed, flipped), lambda w: w.isNotNull())))
    out = merged.join(tally, "claim_id").select(
        "claim_id", "claim", "kind", "moderator", "scope", F.when(F.size(notes) > 0, F.array_join(notes, "; ")).alias("note"), "n_support", "n_contradict",
    )
    return out, moved.select("claim_id", "study", F.when(F.col("s"), "support").otherwise("contradict").alias("role")), reason


# ---------------------------------------------------------------- outline
def draw_outline(claims: DataFrame, question: str, client: Client, max_sections: int = 8, closing: str = "What is not known", draw: int = 0, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(sections(section_no, heading, brief), placement(section_no, claim_id)) from one call over the claims' wordings.

    A claim goes where it is named first; equal headings are one section; sections left without a claim go. Gap
    claims and claims that no section names are in the closing section, the last one. Without a readable reply all
    claims but gaps are in one section.
    """
    if claims.count() > most:
        raise ValueError(f"more claims than one prompt may list ({most}); merge them first")
    listed = claims.agg(F.array_sort(F.collect_list(F.struct("claim_id", "claim"))).alias("u"))  # at most ``most`` rows
    body = F.array_join(F.transform("u", lambda x: F.concat(x["claim_id"].cast("string"), F.lit(". "), x["claim"])), "\n")
    asked = call(listed.select(_prompt(OUTLINE, question, body).alias("prompt"), F.lit(draw).alias("draw")), client)
    said = asked.select(F.posexplode(F.when(F.col("ok"), read_json(F.col("reply"), _SECTIONS)["sections"])).alias("p", "s")).filter((F.col("p") < max_sections) & has_content(F.col("s.heading")))
    said = cut(said.select("p", F.trim("s.heading").alias("heading"), F.trim(text_or_empty(F.col("s.brief"))).alias("brief"), _ids(F.col("s.claims")).alias("ids"), squeeze(F.col("s.heading")).alias("key")))
    first = said.groupBy("key").agg(F.min("p").alias("section_no"), F.min_by("heading", "p").alias("heading"), F.min_by("brief", "p").alias("brief"))
    named = said.join(first.select("key", "section_no"), "key").select((F.col("section_no") + 1).alias("section_no"), "p", F.explode("ids").alias("claim_id"))
    # the first place that names a claim, also when its heading was merged into an earlier one
    once = named.groupBy("claim_id").agg(F.min_by("section_no", "p").alias("section_no"))
    if once.join(claims.filter("kind != 'gap'"), "claim_id", "left_semi").isEmpty():
        once = claims.filter("kind != 'gap'").select("claim_id", F.lit(1).alias("section_no"))
        first = claims.sparkSession.createDataFrame([(0, "Findings", "Every claim, since no sections were drawn")], "section_no int, heading string, brief string")
    placed = cut(R.place_claims(once.select("section_no", "claim_id"), claims))
    heads = first.select((F.col("section_no") + 1).alias("section_no"), "heading", "brief").unionByName(
        claims.sparkSession.createDataFrame([(0, closing, "Open points, with the reason each is open")], "section_no int, heading string, brief string")
    )
    used = heads.join(placed.select("section_no").distinct(), "section_no", "left_semi")
    order = Window.orderBy(F.col("section_no") == 0, "section_no")  # at most max_sections + 1 rows
    numbered = cut(used.withColumn("no", F.row_number().over(order)))
    sections = numbered.select(F.col("no").alias("section_no"), "heading", "brief")
    return sections, placed.join(numbered.select("section_no", "no"), "section_no").select(F.col("no").alias("section_no"), "claim_id")


def outline_alternatives(claims: DataFrame, question: str, client: Client, n: int = 3, **settings) -> list[tuple[DataFrame, DataFrame, float]]:
    """(sections, placement, distance to the first) of up to ``n`` draws; a draw that groups the claims as an earlier
    one does is left out. n is a handful, so the loop is over outlines, never over claims."""
    out: list[tuple[DataFrame, DataFrame, float]] = []
    for k in range(n):
        sections, placement = draw_outline(claims, question, client, draw=k, **settings)
        mine = placement.withColumnRenamed("section_no", "section")
        apart = [R.outline_distance(p.withColumnRenamed("section_no", "section"), mine).first()[0] for _, p, _ in out]
        if all(d > 0 for d in apart):
            out.append((sections, placement, apart[0] if apart else 0.0))
    return out


# ---------------------------------------------------------------- sections
def claim_batches(claims: list[tuple[int, int, list[tuple[int, int]]]], budget: int) -> tuple[list[tuple[list[int], list[int]]], list[int]]:
    """(batches of (claim ids, study ids), unwritable claim ids) of claims (id, tokens, [(study, tokens)]) in rank order.

    A claim joins the batch while it and the studies it adds fit; a study behind several claims of a batch counts
    once. A claim too large by itself goes out with its studies split; one that leaves no room for any is unwritable.
    """
    out: list[tuple[list[int], list[int]]] = []
    lost: list[int] = []
    ids: list[int] = []
    held: dict[int, int] = {}
    spent = 0
    for claim, tokens, studies in claims:
        new = {s: t for s, t in studies if s not in held}
        if ids and spent + tokens + sum(new.values()) > budget:
            out.append((ids, sorted(held)))
            ids, held, spent, new = [], {}, 0, dict(studies)
        if ids or tokens + sum(new.values()) <= budget:
            ids, held, spent = [*ids, claim], held | new, spent + tokens + sum(new.values())
            continue
        room = budget - tokens
        if room <= 0:
            lost.append(claim)
            continue
        part: list[int] = []
        used = 0
        for s, t in sorted(new.items()):
            if part and used + t > room:
                out.append(([claim], part))
                part, used = [], 0
            part, used = [*part, s], used + t
        out.append(([claim], part))
    if ids:
        out.append((ids, sorted(held)))
    return out, lost


_BATCH = "section_no int, batch int, claims array<bigint>, studies array<bigint>, lost int"


def synthesise(sections: DataFrame, placement: DataFrame, claims: DataFrame, support: DataFrame, studies: DataFrame, question: str, client: Client, budget: int = 6000) -> DataFrame:
    """section_no, heading, text, calls, n_cited, n_unknown, n_unsupplied, n_unparsed, partial of every section.

    studies(study, text). A section's claims go out in batches with the studies behind them, widest support first;
    several drafts are joined by one more call. Citations are held to the studies there are (unknown) and to those
    the section was given (unsupplied). The fold that makes batches sees ids and sizes of one section; texts join it
    afterwards. A section whose calls all failed has a null text and is partial.
    """
    sized = studies.select(F.col("study").cast("bigint").alias("study"), "text", (count_words(F.col("text")) + 2).alias("tokens"))
    behind = support.join(sized.select("study", "tokens"), "study").groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("study", F.col("tokens").cast("bigint").alias("tokens")))).alias("behind"),
        F.array_sort(F.collect_list(F.struct("role", "study"))).alias("roles"),
    )
    told = lambda role: F.array_join(F.transform(F.filter("roles", lambda x: x["role"] == role), lambda x: x["study"].cast("string")), ", ")
    block = F.concat(F.lit("claim "), F.col("claim_id").cast("string"), F.lit(": "), F.col("claim"), F.lit("\nsupporting: "), told("support"), F.lit("\ncontradicting: "), told("contradict"))
    blocks = cut(placement.join(claims.select("claim_id", "claim", "n_support"), "claim_id").join(behind, "claim_id").withColumn("block", block))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_support", "claim_id"], ascending=[False, True])
        rows = [(c, int(t), [(x["study"], int(x["tokens"])) for x in b]) for c, t, b in zip(pdf.claim_id, pdf.tokens, pdf.behind, strict=True)]
        found, lost = claim_batches(rows, budget)
        no = int(pdf.section_no.iloc[0])
        out = [(no, k, ids, held, len(lost)) for k, (ids, held) in enumerate(found)] or [(no, -1, [], [], len(lost))]
        return pd.DataFrame(out, columns=["section_no", "batch", "claims", "studies", "lost"])

    folded = blocks.select(F.col("section_no").cast("int").alias("section_no"), F.col("claim_id").cast("bigint").alias("claim_id"), "n_support", (count_words(F.col("block")) + 2).alias("tokens"), "behind")
    batches = cut(folded.groupBy("section_no").applyInPandas(fold, _BATCH))
    own = batches.filter("batch >= 0")
    texts = own.select("section_no", "batch", F.posexplode("claims").alias("n", "claim_id")).join(blocks.select("section_no", "claim_id", "block"), ["section_no", "claim_id"])
    texts = texts.groupBy("section_no", "batch").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("c"))
    rows = own.select("section_no", "batch", F.explode("studies").alias("study")).join(sized.select("study", "text"), "study")
    rows = rows.groupBy("section_no", "batch").agg(F.array_sort(F.collect_list(F.struct("study", "text"))).alias("s"))
    head = F.concat(F.col("heading"), F.lit("\n"), F.col("brief"), F.lit("\n\n"))
    given = texts.join(rows, ["section_no", "batch"], "left").join(sections, "section_no")
    body = F.concat(head, F.array_join(F.transform("c", lambda x: x["block"]), "\n\n"), F.lit("\n\n"), F.coalesce(F.array_join(F.transform("s", lambda x: x["text"]), "\n\n"), F.lit("")))
    drafts = cut(call(given.select("section_no", "batch", "heading", _prompt(WRITE, question, body).alias("prompt")), client).select("section_no", "batch", "ok", F.when(F.col("ok") & has_content(F.col("reply")), F.col("reply")).alias("draft")))
    packed = drafts.groupBy("section_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("draft").isNotNull(), F.struct("batch", "draft")))).alias("d"), F.count(F.lit(1)).alias("calls"), F.max(F.col("draft").isNull()).alias("failed"),
    ).withColumn("body", F.array_join(F.transform("d", lambda x: x["draft"]), "\n\n"))
    many = packed.filter(F.size("d") > 1).withColumn("prompt", _prompt(JOIN, question, F.col("body")))
    joined = call(many, client).select("section_no", F.coalesce(F.when(F.col("ok") & has_content(F.col("reply")), F.col("reply")), F.col("body")).alias("text"), (F.col("calls") + 1).alias("calls"), (F.col("failed") | ~F.col("ok")).alias("failed"))
    single = packed.filter(F.size("d") <= 1).select("section_no", F.when(F.size("d") == 1, F.col("body")).alias("text"), "calls", "failed")
    written = cut(single.unionByName(joined))
    state = batches.groupBy("section_no").agg(F.array_distinct(F.flatten(F.collect_list("studies"))).alias("given"), F.max("lost").alias("lost"))
    cites = written.withColumn("cited", F.coalesce(V.cited_ids(F.col("text"), "study"), F.expr("cast(array() as array<int>)")))
    known = cites.select("section_no", F.explode("cited").alias("study")).join(sized.select("study"), "study", "left_semi").groupBy("section_no").agg(F.collect_set(F.col("study").cast("bigint")).alias("known"))
    none = F.expr("cast(array() as array<bigint>)")
    out = sections.join(state, "section_no", "left").join(cites, "section_no", "left").join(known, "section_no", "left")
    out = out.withColumns({"known": F.coalesce("known", none), "given": F.coalesce("given", none)}).select(
        "section_no", "heading", "text", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"), F.coalesce(F.size("cited"), F.lit(0)).alias("n_cited"),
        (F.coalesce(F.size("cited"), F.lit(0)) - F.size("known")).alias("n_unknown"), F.size(F.array_except("known", "given")).alias("n_unsupplied"),
        F.coalesce(F.size(V.unparsed_citations(F.col("text"), "study")), F.lit(0)).alias("n_unparsed"), "failed", "lost",
    )
    bad = F.coalesce("failed", F.lit(True)) | (F.coalesce("lost", F.lit(0)) > 0) | (F.col("n_unknown") > 0) | (F.col("n_unsupplied") > 0) | (F.col("n_unparsed") > 0)
    return out.withColumn("partial", bad).drop("failed", "lost")


# ---------------------------------------------------------------- revisions
def citation_shift(before: Column, after: Column, word: str = "study") -> Column:
    """Null, or why a revision's citations do not hold: a study cited more often, or claim sentences that lost theirs."""
    b, a = V.cited_ids(before, word, distinct=False), V.cited_ids(after, word, distinct=False)
    times = lambda c, i: F.size(F.filter(c, lambda x: x == i))
    more = F.exists(F.array_distinct(a), lambda i: times(a, i) > times(b, i))
    marked = lambda t: F.size(F.filter(sentences_of(t), lambda s: s.rlike(V.cite_pattern(word))))
    bare = lambda t: F.size(sentences_of(t)) - marked(t)
    stripped = F.least(marked(before) - marked(after), bare(after) - bare(before)) > 0
    return F.when(more, "a study is cited more often").when(stripped, "a claim sentence lost its citation")


@F.pandas_udf(T.BooleanType())
def new_figures(before: pd.Series, after: pd.Series) -> pd.Series:
    """Whether a text states a number that the text before did not."""
    return pd.Series([bool({f[1] for f in R.figures_in(a or "")} - {f[1] for f in R.figures_in(b or "")}) for b, a in zip(before, after, strict=True)])


def revise(texts: DataFrame, client: Client, passes: tuple[str, ...] = PASSES) -> DataFrame:
    """section_no, text, kept, refused of texts(section_no, text): each pass rewrites every section, and a rewriting
    stays only if it holds: no new booster or universal, hedges in proportion, citations not shifted, no new figure,
    and for ``cut`` fewer words. ``kept`` and ``refused`` list passes; a refused pass leaves the text as it was.
    """
    unknown = set(passes) - set(PASSES)
    if unknown:
        raise ValueError(f"no such pass: {', '.join(sorted(unknown))}")
    empty = F.expr("cast(array() as array<string>)")
    state = texts.select("section_no", "text", empty.alias("kept"), empty.alias("refused"))
    for name in passes:
        asked = call(state.withColumn("prompt", _prompt(REVISE, name, text_or_empty(F.col("text")))), client)
        pairs = cut(asked.select("section_no", "kept", "refused", F.col("text").alias("before"), F.when(F.col("ok") & has_content(F.col("reply")), F.col("reply")).alias("after")))
        judged = R.strength_guard(pairs)
        why = (
            F.when(F.col("before").isNull() | F.col("after").isNull(), "no text").when(~F.col("holds"), "claims are stronger")
            .otherwise(F.coalesce(citation_shift(F.col("before"), F.col("after")), F.when(new_figures("before", "after"), "a figure is new")))
        )
        if name == "cut":
            why = F.coalesce(why, F.when(count_words(F.col("after")) >= count_words(F.col("before")), "not shorter"))
        judged = judged.withColumn("why", why)
        good = F.col("why").isNull()
        state = cut(judged.select(
            "section_no", F.when(good, F.col("after")).otherwise(F.col("before")).alias("text"), F.when(good, F.concat("kept", F.array(F.lit(name)))).otherwise(F.col("kept")).alias("kept"),
            F.when(good, F.col("refused")).otherwise(F.concat("refused", F.array(F.concat(F.lit(f"{name}: "), F.col("why"))))).alias("refused"),
        ))
    return state
