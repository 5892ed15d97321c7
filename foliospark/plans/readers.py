"""Reading strategies: plans that turn chunks and a question into one answer a document around the call operator.

Every reader takes chunks(document, chunk_id, text, tokens[, section]) and returns answers(document, reader, answer,
not_found, premise, partial, chunks_used, calls, notes). A strategy's map step is one call over a DataFrame of prompts;
its reduce step is a grouped aggregation; loops have a bound known beforehand and cut their lineage through the shared
checkpoint folder. Every request goes through the call operator, so a Desk given as the client brings its cache, its
limits and its ledger to any reader.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import NONE, NOT_FOUND, count_words, has_content, is_none_reply, is_not_found, lexical_terms, not_found, premise_split, truncate_words
from foliospark.functions.tokens import count_tokens
from foliospark.operators import extract as X
from foliospark.operators import rank as R
from foliospark.operators.model import Client, Desk, call, call_in_turn, read_json
from foliospark.operators.verify import cite_pattern, cited_ids, contains_quote, normalise_column, stands_in, unparsed_citations
from foliospark.session import cut


@dataclass(frozen=True)
class ReadSpec:
    reader: str = "map_reduce"
    budget: int = 4000
    top_k: int = 6
    #: maximal marginal relevance: 1 is relevance alone
    weight: float = 1.0
    min_score: float = 0.0
    #: an embedder's name, whose cosine is half of the score, or None for BM25 alone
    embedder: str | None = "lexical"
    arrange: str = "document"
    prefilter: int = 20
    least_mark: int = 4
    fan_in: int = 5
    max_levels: int = 5
    max_rounds: int = 4
    members: tuple[str, ...] = ("retrieve", "map_reduce", "refine")
    settings: dict = field(default_factory=dict)


#: name -> (reader, select | calls | state)
READERS: dict[str, tuple[Callable[[DataFrame, str, Client, ReadSpec], DataFrame], str]] = {}
#: What the parts of a prompt are called.
ASK, EVIDENCE, MERGE, SUMMARY, DRAFT, MARK, PLAN, STEP, FILL, SCREEN = "QUESTION", "EVIDENCE", "MERGE", "SUMMARISE", "DRAFT", "SCORE", "PLAN", "STEP", "FILL", "SCREEN"
#: Equal groups that a preview outlines where there are no sections.
GROUPS = 8


def register_reader(name: str, signature: str):
    """Add a reader(chunks, question, client, spec) -> answers under its traversal signature."""

    def add(run):
        READERS[name] = (run, signature)
        return run

    return add


def read(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    if spec.reader not in READERS:
        raise KeyError(f"no reader {spec.reader!r}; there are {', '.join(READERS)}")
    return READERS[spec.reader][0](chunks, question, client, spec)


def _prompt(kind: str, question: str, body):
    return F.concat(F.lit(f"{kind}: {question}\n\n"), body)


def render(text="text", number="chunk_id"):
    return F.concat(F.lit("[chunk "), F.col(number).cast("string"), F.lit("]\n"), F.col(text))


def _ask(df: DataFrame, client: Client) -> DataFrame:
    out = call(df, client)
    return out.withColumn("reply", F.when(F.col("ok"), F.col("reply")))


def _answers(df: DataFrame, reader: str) -> DataFrame:
    """Shape to the contract. A blank answer counts as not found, a denied premise is told apart from the answer, and
    an answer that cites a chunk it was not given, or a citation that does not read as one, is partial."""
    said = df.withColumn("_p", premise_split(F.coalesce("answer", F.lit(NOT_FOUND))))
    answer = F.col("_p.answer")
    cites = answer.contains("[")
    odd = F.when(cites, (F.size(F.array_except(cited_ids(answer, "chunk"), "chunks_used")) > 0) | (F.size(unparsed_citations(answer, "chunk")) > 0)).otherwise(False)
    notes = F.col("notes") if "notes" in df.columns else F.lit(None).cast("map<string,string>")
    return said.select(
        "document", F.lit(reader).alias("reader"), answer.alias("answer"), is_not_found(answer).alias("not_found"), F.col("_p.premise").alias("premise"), (F.col("partial") | odd).alias("partial"), "chunks_used",
        F.col("calls").cast("bigint").alias("calls"), notes.alias("notes"),
    )


NO_CHUNKS = "cast(array() as array<int>)"


def _gather(rows: DataFrame, order: str, budget: int | None = None) -> DataFrame:
    """(document, body, chunks_used, dropped): rows joined in order, greedily within a budget of tokens."""
    packed = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "chunk_id", render().alias("r"), "tokens"))).alias("us"))
    if budget is None:
        taken = F.col("us")
    else:
        kind = packed.schema["us"].dataType.simpleString()
        taken = F.expr(
            f"aggregate(us, named_struct('t', 0L, 'o', cast(array() as {kind})),"
            f" (s, x) -> if(s.t + x.tokens <= {budget} or size(s.o) = 0, named_struct('t', s.t + x.tokens, 'o', concat(s.o, array(x))), s), s -> s.o)"
        )
    out = packed.select("document", taken.alias("u"), F.size("us").alias("n"))
    return out.select(
        "document", F.array_join(F.transform("u", lambda x: x["r"]), "\n\n").alias("body"),
        F.array_sort(F.transform("u", lambda x: x["chunk_id"])).alias("chunks_used"), (F.size("u") < F.col("n")).alias("dropped"),
    )


@register_reader("stuff", "all|1|none")
def read_stuff(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """One call over what fits, in document order."""
    packed = _gather(chunks.select("document", "chunk_id", "text", "tokens"), "chunk_id", spec.budget)
    asked = _ask(packed.withColumn("prompt", _prompt(ASK, question, F.col("body"))), client)
    return _answers(asked.select("document", F.col("reply").alias("answer"), "dropped", "ok", "chunks_used", F.lit(1).alias("calls")).withColumn("partial", F.col("dropped") | ~F.col("ok")), "stuff")


def merge_levels(parts: DataFrame, question: str, client: Client, budget: int, levels: int = 7) -> DataFrame:
    """(document, answer, calls, gave_up, merge_failed) from parts(document, n, text): greedy groups under the budget, merged level by level.

    A group of one passes through unmerged. The loop ends when every document has one part, when no document got
    fewer, or after ``levels``; what is left then is joined as it is and marked.
    """
    state = cut(parts.select("document", "n", "text", F.lit(0).alias("calls"), F.lit(False).alias("bad")))
    for _ in range(levels):
        counted = state.withColumn("tokens", count_words(F.col("text")))
        lists = counted.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("n", "text", "tokens", "calls", "bad"))).alias("us"))
        if not lists.filter(F.size("us") > 1).limit(1).count():
            break
        groups = F.expr(
            "aggregate(us, named_struct('g', 0, 't', 0L, 'o', cast(array() as array<int>)),"
            f" (s, x) -> if(s.g > 0 and s.t + x.tokens <= {budget}, named_struct('g', s.g, 't', s.t + x.tokens, 'o', concat(s.o, array(s.g))),"
            "  named_struct('g', s.g + 1, 't', cast(x.tokens as bigint), 'o', concat(s.o, array(s.g + 1)))), s -> s.o)"
        )
        placed = lists.withColumn("gs", groups).select("document", F.explode(F.arrays_zip("us", "gs")).alias("z")).select("document", F.col("z.gs").alias("g"), "z.us.*")
        grouped = placed.groupBy("document", "g").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("u"), F.sum("calls").alias("calls"), F.max("bad").alias("bad"))
        grouped = grouped.withColumn("body", F.array_join(F.transform("u", lambda x: x["text"]), "\n\n"))
        single = grouped.filter(F.size("u") == 1).select("document", F.col("g").alias("n"), F.col("body").alias("text"), "calls", "bad")
        many = _ask(grouped.filter(F.size("u") > 1).withColumn("prompt", _prompt(MERGE, question, F.col("body"))), client)
        merged = many.select("document", F.col("g").alias("n"), F.coalesce("reply", "body").alias("text"), (F.col("calls") + 1).alias("calls"), (F.col("bad") | ~F.col("ok")).alias("bad"))
        after = cut(single.unionByName(merged))
        if after.count() == state.count():
            break
        state = after
    done = state.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("u"), F.sum("calls").alias("calls"), F.max("bad").alias("merge_failed"))
    return done.select("document", F.array_join(F.transform("u", lambda x: x["text"]), "\n\n").alias("answer"), "calls", (F.size("u") > 1).alias("gave_up"), "merge_failed")


@register_reader("map_reduce", "all|N+logN|tree")
def read_map_reduce(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """A call a chunk; answers that found something are merged in a tree."""
    asked = cut(_ask(chunks.withColumn("prompt", _prompt(ASK, question, render())), client))
    good = asked.filter(F.col("ok") & ~is_not_found(F.col("reply")))
    totals = asked.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("ok")).alias("failed"))
    used = good.groupBy("document").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks_used"))
    merged = merge_levels(good.select("document", F.col("chunk_id").alias("n"), F.col("reply").alias("text")), question, client, spec.budget)
    out = totals.join(used, "document", "left").join(merged, "document", "left")
    return _answers(
        out.select(
            "document", "answer", (F.col("failed") | F.coalesce("gave_up", F.lit(False))).alias("partial"),
            F.coalesce("chunks_used", F.expr(NO_CHUNKS)).alias("chunks_used"), (F.col("n") + F.coalesce("calls", F.lit(0))).alias("calls"),
        ), "map_reduce",
    )


@register_reader("refine", "all|N|forward")
def read_refine(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """A draft carried forward, chunk by chunk; a failed step keeps the draft.

    The fold is sequential by nature: a document's chunks pass through one task in order. Documents of equal chunks
    are read once. At a Desk, whose limits span the documents, each round is a call.
    """
    if isinstance(client, Desk):
        return _refine_in_rounds(chunks, question, client)
    own = cut(chunks).select("document", "chunk_id", "text")
    whole = own.groupBy("document").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("chunk_id", F.sha2("text", 256).alias("text"))))), 256).alias("chunks"))
    whole = cut(whole)
    firsts = whole.groupBy("chunks").agg(F.min("document").alias("document"))

    def take(state, row, ask):
        draft, failed, used, calls = state or (None, False, [], 0)
        opening = f"{ASK if draft is None else DRAFT}: {question}\n\n" + ("" if draft is None else f"{draft}\n\n")
        reply, ok = ask(None if row.text is None else f"{opening}[chunk {row.chunk_id}]\n{row.text}")
        if ok and not not_found(reply):
            draft, used = reply, [*used, int(row.chunk_id)]
        return draft, failed or not ok, used, calls + 1

    told = call_in_turn(own.join(firsts.select("document"), "document", "left_semi"), client, "document", "chunk_id", take, "document string, draft string, failed boolean, used array<int>, calls int")
    done = cut(told).join(firsts, "document").drop("document")
    return _answers(whole.join(done, "chunks").select("document", F.col("draft").alias("answer"), F.col("failed").alias("partial"), F.array_sort("used").alias("chunks_used"), "calls"), "refine")


def _refine_in_rounds(chunks: DataFrame, question: str, client: Client) -> DataFrame:
    """A round a chunk, over the documents that have one left, as many rounds as the longest document has chunks. A
    document's state leaves the loop with its last chunk."""
    order = Window.partitionBy("document").orderBy("chunk_id")
    steps = cut(chunks.select("document", "chunk_id", "text", F.row_number().over(order).alias("step"), F.count(F.lit(1)).over(Window.partitionBy("document")).alias("steps")))
    rounds = steps.agg(F.max("step")).first()[0] or 0  # one row
    folder = f"{steps.sparkSession.sparkContext.getCheckpointDir()}/refine-{uuid.uuid4().hex}"
    state = steps.filter("step = 1").select("document", F.lit(None).cast("string").alias("draft"), F.lit(False).alias("failed"), F.expr(NO_CHUNKS).alias("used"))
    for n in range(1, rounds + 1):
        work = steps.filter(F.col("step") == n).join(state, "document")
        fresh = F.col("draft").isNull()
        body = F.concat(F.when(fresh, "").otherwise(F.concat("draft", F.lit("\n\n"))), render())
        asked = _ask(work.withColumn("prompt", F.concat(F.when(fresh, ASK).otherwise(DRAFT), F.lit(f": {question}\n\n"), body)), client)
        better = F.col("ok") & ~is_not_found(F.col("reply"))
        state = cut(asked.select(
            "document", "steps", F.when(better, F.col("reply")).otherwise(F.col("draft")).alias("draft"), (F.col("failed") | ~F.col("ok")).alias("failed"),
            F.when(better, F.concat("used", F.array("chunk_id"))).otherwise(F.col("used")).alias("used"),
        ))
        state.filter(F.col("steps") == n).write.mode("append").parquet(folder)
        state = state.filter(F.col("steps") > n).drop("steps")
    if not rounds:
        done = state.withColumn("steps", F.lit(0))
    else:
        done = steps.sparkSession.read.parquet(folder)
    return _answers(done.select("document", F.col("draft").alias("answer"), F.col("failed").alias("partial"), F.array_sort("used").alias("chunks_used"), F.col("steps").alias("calls")), "refine")


def loose_lines(reply, chunk):
    """How many lines of a reply about a chunk, their citations aside, the chunk does not hold."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(F.regexp_replace(x, cite_pattern("chunk"), " "))), has_content)
    return F.transform(F.array(normalise_column(chunk)), lambda s: F.size(F.filter(F.transform(lines, normalise_column), lambda q: ~stands_in(s, q))))[0]


@register_reader("skim", "all|N+1|none")
def read_skim(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """Evidence from every chunk, NONE dropped, one answer over it. Evidence over the budget is merged in a tree first;
    where the merge gives up short of the budget or one of its calls fails, the answer is over all that is left and
    partial. So is an answer over evidence with a line that its chunk does not hold; notes count these lines.

    Only the evidence is kept of a chunk, and a row a document of that, so each plan stays small.
    """
    told = _ask(chunks.withColumn("prompt", _prompt(EVIDENCE, question, render())), client)
    some = F.col("ok") & ~is_none_reply(F.col("reply"))
    told = told.select("document", "chunk_id", "ok", F.when(some, F.col("reply")).alias("reply"), F.when(some, loose_lines(F.col("reply"), F.col("text"))).alias("loose"), F.when(some, count_words(F.col("reply"))).alias("words"))
    told = cut(told)
    found = F.when(F.col("reply").isNotNull(), F.struct("chunk_id", render("reply").alias("r")))
    rows = told.groupBy("document").agg(
        F.count(F.lit(1)).alias("n"), F.max(~F.col("ok")).alias("failed"), F.coalesce(F.sum("loose"), F.lit(0)).alias("loose"), F.coalesce(F.sum("words"), F.lit(0)).alias("size"), F.array_sort(F.collect_list(found)).alias("us"),
    )
    rows = cut(rows.select("document", "n", "failed", "loose", "size", F.array_join(F.transform("us", lambda x: x["r"]), "\n\n").alias("body"), F.transform("us", lambda x: x["chunk_id"]).alias("chunks_used")))
    over = rows.filter(F.col("size") > spec.budget).select("document")
    if over.limit(1).count():
        pieces = told.filter("reply is not null").join(over, "document", "left_semi").select("document", F.col("chunk_id").alias("n"), render("reply").alias("text"))
        merged = merge_levels(pieces, question, client, spec.budget)
        body = F.coalesce("answer", "body")
        unmerged = F.coalesce(F.col("merge_failed") | (F.col("gave_up") & (count_words(body) > spec.budget)), F.lit(False))
        rows = cut(rows.join(merged, "document", "left").select("document", (F.col("n") + F.coalesce("calls", F.lit(0))).alias("n"), (F.col("failed") | unmerged).alias("failed"), "loose", body.alias("body"), "chunks_used"))
    some = F.size("chunks_used") > 0
    final = _ask(rows.filter(some).withColumn("prompt", _prompt(ASK, question, F.col("body"))), client)
    kept = ["document", "failed", "loose", "chunks_used", (F.col("n") + some.cast("int")).alias("calls")]
    out = final.select(*kept, F.col("reply").alias("answer"), "ok").unionByName(rows.filter(~some).select(*kept, F.lit(None).cast("string").alias("answer"), F.lit(True).alias("ok")))
    out = out.withColumns({"partial": F.col("failed") | (F.col("loose") > 0) | ~F.col("ok"), "notes": F.when(F.col("loose") > 0, F.create_map(F.lit("unverified_lines"), F.col("loose").cast("string")))})
    return _answers(out, "skim")


def score_chunks(chunks: DataFrame, question: str) -> DataFrame:
    """Add ``score``: BM25 of the question inside each document, from counts of the question's terms in each chunk."""
    spark = chunks.sparkSession
    terms = spark.range(1).select(F.explode(F.array_distinct(lexical_terms(F.lit(question)))).alias("t"))
    wanted = sorted(r[0] for r in terms.collect())  # the question's own words
    own = chunks.withColumn("_t", lexical_terms(F.col("text"))).withColumn("_len", F.size("_t"))
    own = own.withColumns({f"_f{i}": R.times("_t", w) for i, w in enumerate(wanted)}).drop("_t")
    stats = own.groupBy("document").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.avg(F.when(F.col("_len") > 0, F.col("_len"))), F.lit(1.0)).alias("_avg"),
        *[F.sum((F.col(f"_f{i}") > 0).cast("int")).alias(f"_d{i}") for i in range(len(wanted))],
    )
    score = F.lit(0.0)
    for i in range(len(wanted)):
        d, f = F.col(f"_d{i}"), F.col(f"_f{i}")
        score = score + F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5)) * (f * (R.K1 + 1)) / (f + R.K1 * (1 - R.B + R.B * F.col("_len") / F.col("_avg")))
    return own.join(stats, "document").withColumn("score", F.round(score, 9)).select(*chunks.columns, "score")


def score_queries(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Add ``score``: BM25 inside each document of the document's own query; queries(document, query).

    Documents without a query are left out. Only the query's terms leave a chunk.
    """
    asked = queries.select("document", F.array_distinct(lexical_terms(F.col("query"))).alias("_q"))
    own = chunks.join(asked, "document").withColumn("_t", lexical_terms(F.col("text"))).withColumn("_len", F.size("_t"))
    own = cut(own.withColumn("_t", F.filter("_t", lambda t: F.array_contains("_q", t))))
    sizes = own.groupBy("document").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.avg(F.when(F.col("_len") > 0, F.col("_len"))), F.lit(1.0)).alias("_avg"))
    terms = own.select("document", "chunk_id", "_len", F.explode("_t").alias("_w")).groupBy("document", "chunk_id", "_len", "_w").agg(F.count(F.lit(1)).alias("_f"))
    df = terms.groupBy("document", "_w").agg(F.count(F.lit(1)).alias("_d"))
    part = terms.join(df, ["document", "_w"]).join(sizes, "document")
    gain = F.log(1 + (F.col("_n") - F.col("_d") + 0.5) / (F.col("_d") + 0.5)) * (F.col("_f") * (R.K1 + 1)) / (F.col("_f") + R.K1 * (1 - R.B + R.B * F.col("_len") / F.col("_avg")))
    sums = part.groupBy("document", "chunk_id").agg(F.round(F.sum(gain), 9).alias("_s"))
    return own.join(sums, ["document", "chunk_id"], "left").select(*chunks.columns, F.coalesce("_s", F.lit(0.0)).alias("score"))


def relevance(chunks: DataFrame, queries: DataFrame, embedder: str | None) -> DataFrame:
    """Add ``score`` and ``vector``: BM25 alone (vector null), or half cosine and half BM25 scaled in the document."""
    scored = score_queries(chunks, queries)
    if embedder is None:
        return scored.withColumn("vector", F.lit(None).cast("array<double>"))
    q = R.embed(queries, "query", "_qv", embedder).select("document", "_qv")
    both = R.scale01(R.embed(scored, "text", "vector", embedder), "score", "_lexical", "document").join(q, "document")
    return both.select(*chunks.columns, F.round(0.5 * R.cosine(F.col("vector"), F.col("_qv")) + 0.5 * F.col("_lexical"), 9).alias("score"), "vector")


def retrieved(scored: DataFrame, spec: ReadSpec) -> DataFrame:
    """The chunks of scored(document, chunk_id, …, score, vector) that a reader sends: the least score (the best one
    stays at any rate), then the best or, with a weight under 1, the most relevant and diverse; with their ``rank``."""
    able = scored.withColumn("_top", F.max("score").over(Window.partitionBy("document"))).filter((F.col("score") >= spec.min_score) | (F.col("score") == F.col("_top"))).drop("_top")
    if spec.weight < 1 and spec.embedder is not None:
        able = cut(able)
        chosen = R.mmr(able, "chunk_id", "score", "vector", spec.top_k, spec.weight, "document").select("document", "chunk_id", F.col("position").alias("rank"))
        return able.drop("vector").join(chosen, ["document", "chunk_id"])
    ranked = R.top_k(able.drop("vector"), spec.top_k, "score", "chunk_id", "document")
    return ranked.filter((F.col("score") >= spec.min_score) | (F.col("rank") == 1))


@register_reader("retrieve", "topk|1|none")
def read_retrieve(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """The best chunks that reach the least score (one at any rate), within the budget, arranged, one call."""
    asked_of = chunks.select("document").distinct().withColumn("query", F.lit(question))
    scored = score_chunks(chunks, question).withColumn("vector", F.lit(None).cast("array<double>")) if spec.embedder is None else relevance(chunks, asked_of, spec.embedder)
    placed = R.arrange(retrieved(scored, spec), spec.arrange, "rank", "chunk_id", "document")
    packed = _gather(placed, "position", spec.budget)
    asked = _ask(packed.withColumn("prompt", _prompt(ASK, question, F.col("body"))), client)
    return _answers(asked.select("document", F.col("reply").alias("answer"), (F.col("dropped") | ~F.col("ok")).alias("partial"), "chunks_used", F.lit(1).alias("calls")), "retrieve")


@register_reader("rerank", "topk|m+1|none")
def read_rerank(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """BM25 top m, a mark of 0 to 10 from the model for each, the best of those that reach the least mark, one call.
    Where no mark can be read the BM25 order stands and the answer is partial."""
    near = R.top_k(score_chunks(chunks, question), spec.prefilter, "score", "chunk_id", "document").drop("rank")
    marked = cut(_ask(near.withColumn("prompt", _prompt(MARK, question, render())), client))
    mark = F.regexp_extract("reply", r"^\s*([0-9]{1,2})(?:\s*/\s*10)?\s*$", 1).try_cast("int")
    marked = marked.withColumn("mark", F.when(mark <= 10, mark))
    by = Window.partitionBy("document")
    silent = F.max("mark").over(by).isNull()
    marked = marked.withColumn("silent", silent).withColumn("worth", F.when(silent, F.col("score")).otherwise(F.col("mark").cast("double")))
    able = marked.filter(F.col("silent") | (F.col("mark") >= spec.least_mark))
    best = R.top_k(able.select("document", "chunk_id", "text", "tokens", "worth", "silent"), spec.top_k, "worth", "chunk_id", "document")
    packed = _gather(best.select("document", "chunk_id", "text", "tokens"), "chunk_id", spec.budget)
    final = _ask(packed.withColumn("prompt", _prompt(ASK, question, F.col("body"))), client).select("document", F.col("reply").alias("answer"), "chunks_used", "dropped", F.col("ok").alias("final_ok"))
    totals = marked.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.max("silent").alias("silent"))
    out = totals.join(final, "document", "left")
    return _answers(
        out.select(
            "document", "answer", (F.col("silent") | F.coalesce("dropped", F.lit(False)) | ~F.coalesce("final_ok", F.lit(True))).alias("partial"),
            F.coalesce("chunks_used", F.expr(NO_CHUNKS)).alias("chunks_used"), (F.col("n") + F.col("final_ok").isNotNull().cast("int")).alias("calls"),
        ), "rerank",
    )


@register_reader("hierarchical", "all|N+tree+1|tree")
def read_hierarchical(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """A summary of every chunk, then of groups of fan_in, until what is left fits; one answer over it."""
    summed = cut(_ask(chunks.withColumn("prompt", _prompt(SUMMARY, question, render())), client))
    ids = summed.groupBy("document").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks_used"), F.count(F.lit(1)).alias("base"), F.max(~F.col("ok")).alias("failed"))
    state = cut(summed.select("document", F.col("chunk_id").alias("n"), F.coalesce("reply", "text").alias("text"), F.lit(0).cast("bigint").alias("calls")))
    for _ in range(spec.max_levels - 1):
        totals = state.groupBy("document").agg(F.sum(count_words(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("parts"))
        over = totals.filter((F.col("words") > spec.budget) & (F.col("parts") > 1)).select("document")
        if not over.limit(1).count():
            break
        rest = state.join(over, "document", "left_anti")
        work = state.join(over, "document", "left_semi").withColumn("g", F.floor((F.row_number().over(Window.partitionBy("document").orderBy("n")) - 1) / spec.fan_in).cast("int"))
        grouped = work.groupBy("document", "g").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("u"), F.sum("calls").alias("calls"))
        grouped = grouped.withColumn("body", F.array_join(F.transform("u", lambda x: x["text"]), "\n\n"))
        merged = _ask(grouped.withColumn("prompt", _prompt(SUMMARY, question, F.col("body"))), client)
        state = cut(rest.unionByName(merged.select("document", F.col("g").alias("n"), F.coalesce("reply", "body").alias("text"), (F.col("calls") + 1).alias("calls"))))
    final = state.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("u"), F.sum("calls").alias("calls"))
    asked = _ask(final.withColumn("prompt", _prompt(ASK, question, F.array_join(F.transform("u", lambda x: x["text"]), "\n\n"))), client)
    out = asked.select("document", F.col("reply").alias("answer"), "ok", F.col("calls").alias("inner_calls")).join(ids, "document")
    return _answers(out.select("document", "answer", (F.col("failed") | ~F.col("ok")).alias("partial"), "chunks_used", (F.col("base") + F.col("inner_calls") + 1).alias("calls")), "hierarchical")


_STEP = "can_answer boolean, answer string, next_query string, quotes array<string>"


@register_reader("iterative", "topk|rounds*2|forward")
def read_iterative(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """Rounds over unseen chunks until the model can answer, asks what it asked before, nothing is unseen, or the rounds
    are used up.

    A reply is {can_answer, answer, next_query, quotes}; one that is no such object counts as an answer, if it is not
    the absence verdict. Each round anti-joins what a document has seen, ranks the rest by the document's own next
    query, and asks once a document that is still open. Without any answer of its own a document gets the last one
    said. Quotations that no chunk of the round holds make the answer partial.
    """
    seen = chunks.select("document", "chunk_id").limit(0)
    queries = chunks.select("document").distinct().withColumn("query", F.lit(question)).withColumn("asked", F.array(F.lower(F.lit(question))))
    answers = None
    for turn in range(1, spec.max_rounds + 1):
        unseen = chunks.join(seen, ["document", "chunk_id"], "left_anti")
        best = cut(R.top_k(relevance(unseen, queries, spec.embedder).drop("vector"), spec.top_k, "score", "chunk_id", "document"))
        if not best.limit(1).count():
            break
        packed = _gather(best, "chunk_id", spec.budget).join(queries, "document")
        step = cut(_ask(packed.withColumn("prompt", _prompt(STEP, question, F.concat(F.lit("QUERY: "), "query", F.lit("\n\n"), "body"))), client))
        said = read_json(F.col("reply"), _STEP)
        free = said["can_answer"].isNull()
        answer = F.when(free, F.col("reply")).otherwise(said["answer"])
        done = F.coalesce(F.when(free, ~is_not_found(F.col("reply"))).otherwise(said["can_answer"] & ~is_not_found(answer)), F.lit(False))
        loose = F.exists(F.coalesce(said["quotes"], F.expr("cast(array() as array<string>)")), lambda q: ~contains_quote(F.col("body"), q))
        follow = F.trim(F.coalesce(said["next_query"], F.lit("")))
        again = F.array_contains("asked", F.lower(follow))
        step = cut(step.select(
            "document", answer.alias("answer"), "chunks_used", F.lit(turn).alias("turn"), done.alias("done"), (~F.col("ok")).alias("failed"), loose.alias("loose"),
            F.when(follow == "", F.lit(question)).otherwise(follow).alias("query"), ((follow != "") & again).alias("stuck"), F.concat("asked", F.array(F.lower(follow))).alias("asked"),
        ))
        row = step.select("document", "answer", "chunks_used", "turn", "done", "failed", "loose")
        answers = row if answers is None else answers.unionByName(row)
        seen = cut(seen.unionByName(best.select("document", "chunk_id")))
        queries = step.filter(~F.col("done") & ~F.col("stuck")).select("document", "query", "asked")
    if answers is None:
        return _answers(chunks.select("document", F.lit(None).cast("string").alias("answer"), F.lit(True).alias("partial"), F.expr(NO_CHUNKS).alias("chunks_used"), F.lit(0).alias("calls")).limit(0), "iterative")
    told = F.when(~is_not_found(F.col("answer")), F.struct("done", "turn"))
    done = answers.groupBy("document").agg(
        F.max_by("answer", told).alias("answer"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks_used")))).alias("chunks_used"),
        F.count(F.lit(1)).alias("calls"), (F.max("failed") | F.max("loose") | ~F.max("done")).alias("partial"),
    )
    return _answers(done, "iterative")


def preview_units(chunks: DataFrame) -> DataFrame:
    """Add ``unit`` and ``label``: runs of equal sections where a document has two or more, else at most GROUPS equal
    groups, labelled by how the first chunk begins."""
    order = Window.partitionBy("document").orderBy("chunk_id")
    whole = Window.partitionBy("document")
    section = F.col("section") if "section" in chunks.columns else F.lit(None).cast("string")
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(order)
    rows = chunks.withColumns({"_section": section, "_n": n, "_at": at}).withColumn("_new", (~F.col("_section").eqNullSafe(F.lag("_section").over(order)) | (F.col("_at") == 1)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order)).withColumn("_runs", F.max("_run").over(whole))
    group = F.floor((F.col("_at") - 1) * F.least(F.col("_n"), F.lit(GROUPS)) / F.col("_n")) + 1
    rows = rows.withColumn("unit", F.when(F.col("_runs") > 1, F.col("_run")).otherwise(group).cast("int"))
    head = F.first(F.substring("text", 1, 120)).over(Window.partitionBy("document", "unit").orderBy("chunk_id"))
    return rows.withColumn("label", F.coalesce(F.when(F.col("_runs") > 1, F.col("_section")), head)).drop("_section", "_n", "_at", "_new", "_run", "_runs")


_PLAN = "read array<int>, skim array<int>"


@register_reader("preview", "planned|1+s+1|none")
def read_preview(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """An outline of a document's sections, one planning call that says which to read, skim or skip, an evidence call
    a skimmed chunk, one answer over it all.

    The plan is {read, skim}, or bare numbers to read. Chunks to read that do not fit the budget are skimmed; a plan
    that names no unit reads what fits. A document of one unit is read without a plan. notes names what was skipped.
    """
    placed = cut(preview_units(chunks.select("document", "chunk_id", "text", "tokens", *[c for c in ("section",) if c in chunks.columns])))
    outline = placed.groupBy("document", "unit").agg(F.first("label").alias("label")).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("unit", "label"))).alias("us"))
    body = F.array_join(F.transform("us", lambda x: F.concat(x["unit"].cast("string"), F.lit(": "), x["label"])), "\n")
    planned = _ask(outline.filter(F.size("us") > 1).withColumn("prompt", _prompt(PLAN, question, body)), client)
    said = read_json(F.col("reply"), _PLAN)
    bare = F.transform(F.regexp_extract_all(F.coalesce("reply", F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    none = F.expr(NO_CHUNKS)
    known = lambda c: F.array_intersect(F.coalesce(c, none), F.transform("us", lambda x: x["unit"]))
    plan = planned.select("document", "us", "ok", known(F.when(said.isNull(), bare).otherwise(said["read"])).alias("read"), known(F.when(said.isNull(), none).otherwise(said["skim"])).alias("skim"))
    plan = plan.withColumn("lost", (F.size("read") == 0) & (F.size("skim") == 0))
    units = F.transform("us", lambda x: x["unit"])
    plan = plan.unionByName(outline.filter(F.size("us") == 1).select("document", "us", F.lit(True).alias("ok"), units.alias("read"), none.alias("skim"), F.lit(None).cast("boolean").alias("lost")))
    plan = cut(plan.withColumns({"read": F.when(F.coalesce("lost", F.lit(False)), units).otherwise(F.col("read")), "skim": F.array_except("skim", "read")}))

    marked = placed.join(plan.select("document", "read", "skim", "lost"), "document")
    running = F.sum("tokens").over(Window.partitionBy("document").orderBy("chunk_id"))
    wanted = marked.filter(F.array_contains("read", F.col("unit"))).withColumn("_run", running)
    first = F.min("chunk_id").over(Window.partitionBy("document")) == F.col("chunk_id")
    wanted = cut(wanted.withColumn("fits", (F.col("_run") <= spec.budget) | first))
    over = wanted.filter(~F.col("fits") & ~F.coalesce("lost", F.lit(False)))
    columns = ["document", "chunk_id", "text", "tokens"]
    skims = marked.filter(F.array_contains("skim", F.col("unit"))).select(*columns).unionByName(over.select(*columns))
    skimmed = cut(_ask(skims.withColumn("prompt", _prompt(EVIDENCE, question, render())), client))
    evidence = skimmed.filter(F.col("ok") & ~is_none_reply(F.col("reply"))).select("document", "chunk_id", F.col("reply").alias("text"), count_words(F.col("reply")).alias("tokens"))
    packed = _gather(wanted.filter("fits").select(*columns).unionByName(evidence), "chunk_id").drop("dropped")
    final = _ask(packed.withColumn("prompt", _prompt(ASK, question, F.col("body"))), client).select("document", F.col("reply").alias("answer"), "chunks_used", F.col("ok").alias("final_ok"))
    cost = skimmed.groupBy("document").agg(F.count(F.lit(1)).alias("s"), F.max(~F.col("ok")).alias("failed"))
    cutoff = wanted.filter(~F.col("fits") & F.coalesce("lost", F.lit(False))).select("document").distinct().withColumn("short", F.lit(True))
    out = plan.join(final, "document", "left").join(cost, "document", "left").join(cutoff, "document", "left")
    skipped = F.filter("us", lambda x: ~F.array_contains(F.concat("read", "skim"), x["unit"]))
    return _answers(
        out.select(
            "document", "answer", (~F.col("ok") | F.coalesce("failed", F.lit(False)) | F.coalesce("short", F.lit(False)) | ~F.coalesce("final_ok", F.lit(True))).alias("partial"),
            F.coalesce("chunks_used", none).alias("chunks_used"),
            (F.col("lost").isNotNull().cast("int") + F.coalesce("s", F.lit(0)) + F.col("final_ok").isNotNull().cast("int")).alias("calls"),
            F.when(F.size(skipped) > 0, F.create_map(F.lit("skipped"), F.array_join(F.transform(skipped, lambda x: x["label"]), "; "))).alias("notes"),
        ), "preview",
    )


@register_reader("ensemble", "ensemble|sum+1|none")
def read_ensemble(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """Two or more readers of different signatures, one adjudicating call over their answers."""
    signatures = {READERS[m][1] for m in spec.members}
    if len(spec.members) < 2 or len(signatures) < len(spec.members):
        raise ValueError("an ensemble needs at least two readers, each of another signature")
    # written once for all members, and each member's answers by themselves: the members' plans never stand in one
    chunks, rows = cut(chunks), None
    for m in spec.members:
        one = cut(read(chunks, question, client, replace(spec, reader=m)).select("document", "reader", "answer", "partial", "chunks_used", "calls"))
        rows = one if rows is None else rows.unionByName(one)
    lists = rows.groupBy("document").agg(
        F.array_sort(F.collect_list(F.struct("reader", "answer"))).alias("m"), F.sum("calls").alias("inner"), F.max("partial").alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks_used")))).alias("chunks_used"),
    )
    body = F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), x["reader"], F.lit("] "), x["answer"])), "\n\n")
    asked = _ask(lists.withColumn("prompt", _prompt(MERGE, question, body)), client)
    return _answers(asked.select("document", F.col("reply").alias("answer"), (F.col("p") | ~F.col("ok")).alias("partial"), "chunks_used", (F.col("inner") + 1).alias("calls")), "ensemble")


# ---------------------------------------------------------------- records
def fill_fields(chunks: DataFrame, fields: list[X.Field], goal: str, client: Client, require_quote: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, totals): what each chunk says about each field, and calls and failures a document.

    hits(document, chunk_id, field, value, quote, supported); supported where the chunk holds the quotation. A reply
    that is no object counts as failed. With ``require_quote`` unsupported values are left out.
    """
    shape = json.dumps(X.json_schema(X.check_fields(fields)), sort_keys=True)
    asked = cut(_ask(chunks.withColumn("prompt", _prompt(FILL, goal, F.concat(F.lit(f"{shape}\n\n"), render()))), client))
    parsed = F.from_json("reply", X.reply_schema(fields), {"mode": "PERMISSIVE"})
    read = F.col("ok") & F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)^\s*(\{.*\})\s*$", 1).isNotNull() & F.coalesce("reply", F.lit("")).rlike(r"(?s)^\s*\{.*\}\s*$") & parsed.isNotNull()
    totals = asked.groupBy("document").agg(F.count(F.lit(1)).alias("calls"), F.sum((~read).cast("int")).alias("failed"), F.array_sort(F.collect_list(F.when(read, F.col("chunk_id")))).alias("chunks_used"))
    hits = X.parse_replies(asked.filter(read).select("document", "chunk_id", "reply"), fields)
    hits = hits.join(chunks.select("document", "chunk_id", F.col("text").alias("_chunk")), ["document", "chunk_id"])
    hits = hits.withColumn("supported", F.coalesce(contains_quote(F.col("_chunk"), F.col("quote")), F.lit(False))).drop("_chunk")
    return (hits.filter("supported") if require_quote else hits), totals


@register_reader("extract", "all|N+conflicts|none")
def read_extract(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """Fields filled from every chunk and reconciled; the answer is the record as a JSON object. The question is the
    goal, settings hold ``fields`` (a list of Field) and ``require_quote``."""
    fields = spec.settings["fields"]
    hits, totals = fill_fields(chunks, fields, question, client, spec.settings.get("require_quote", False))
    table = X.extraction_table(X.reconcile(hits), fields)
    record = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in fields]), {"ignoreNullFields": "false"})
    out = totals.join(table.select("document", record.alias("answer"), "n_filled", "conflicts"), "document", "left")
    notes = F.when(F.coalesce("conflicts", F.lit("")) != "", F.create_map(F.lit("conflicts"), F.col("conflicts")))
    return _answers(out.select("document", F.when(F.col("n_filled") > 0, F.col("answer")).alias("answer"), (F.col("failed") > 0).alias("partial"), "chunks_used", "calls", notes.alias("notes")), "extract")


def openings(chunks: DataFrame, budget: int) -> DataFrame:
    """(document, opening, seen_tokens, document_tokens, truncated, chunks_used): the chunks from the start that fit, or
    of a first chunk that does not its first ``budget`` words."""
    order = Window.partitionBy("document").orderBy("chunk_id")
    run = chunks.withColumns({"_run": F.sum("tokens").over(order), "_at": F.row_number().over(order)})
    totals = chunks.groupBy("document").agg(F.sum("tokens").cast("bigint").alias("document_tokens"))
    kept = run.filter((F.col("_run") <= budget) | (F.col("_at") == 1)).withColumn("text", F.when(F.col("tokens") > budget, truncate_words(F.col("text"), budget)).otherwise(F.col("text")))
    joined = kept.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("u"), F.sum(F.least("tokens", F.lit(budget))).cast("bigint").alias("seen_tokens"))
    opening = F.array_join(F.transform("u", lambda x: x["text"]), "\n\n")
    return joined.join(totals, "document").select(
        "document", opening.alias("opening"), "seen_tokens", "document_tokens", (F.col("seen_tokens") < F.col("document_tokens")).alias("truncated"), F.transform("u", lambda x: x["chunk_id"]).alias("chunks_used"),
    )


_DECISION = "decision string, criterion string, reason string, quote string"


def screened_openings(chunks: DataFrame, question: str, client: Client, inclusion: list[str], exclusion: list[str], budget: int) -> DataFrame:
    """The openings with the model's decision, criterion, reason and quotation; ``read`` where the reply was an object."""
    listed = lambda head, items: "".join([f"{head}\n", *(f"{k}. {c}\n" for k, c in enumerate(items, 1))]) if items else ""
    criteria = listed("INCLUDE", inclusion) + listed("EXCLUDE", exclusion)
    asked = _ask(openings(chunks, budget).withColumn("prompt", _prompt(SCREEN, question, F.concat(F.lit(f"{criteria}\n"), "opening"))), client)
    said = read_json(F.col("reply"), _DECISION)
    return asked.select(
        "document", "opening", "seen_tokens", "document_tokens", "truncated", "chunks_used", "error", (F.col("ok") & said["decision"].isNotNull()).alias("read"), *[said[c].alias(c) for c in ("decision", "criterion", "reason", "quote")],
    )


@register_reader("screen", "head|1|none")
def read_screen(chunks: DataFrame, question: str, client: Client, spec: ReadSpec) -> DataFrame:
    """One decision on a document's opening; settings hold ``inclusion`` and ``exclusion``. The answer is the decision;
    an exclusion without a listed criterion is unclear."""
    from foliospark.operators.screen import screening_table

    exclusion = list(spec.settings.get("exclusion", ()))
    rows = cut(screened_openings(chunks, question, client, list(spec.settings.get("inclusion", ())), exclusion, spec.budget))
    table = screening_table(rows, exclusion).select("document", F.col("decision").alias("answer"), F.col("reason").alias("_reason"))
    out = rows.select("document", "truncated", "read", "chunks_used").join(table, "document")
    notes = F.when(F.col("_reason").isNotNull(), F.create_map(F.lit("reason"), F.col("_reason")))
    return _answers(out.select("document", "answer", (F.col("truncated") | ~F.col("read") | F.col("answer").isNull()).alias("partial"), "chunks_used", F.lit(1).alias("calls"), notes.alias("notes")), "screen")


# ---------------------------------------------------------------- costs, recipes, routing
def most_calls(reader: str, n, spec: ReadSpec = ReadSpec()):
    """Calls a reader makes over ``n`` chunks at most, as a Column: merges of pairs, every round, every chunk skimmed."""
    c = F.col(n) if isinstance(n, str) else n
    if reader == "ensemble":
        return sum((most_calls(m, c, spec) for m in spec.members), F.lit(1)).cast("bigint")
    # a tree over n leaves merges at least two at a time
    more = {"map_reduce": 2 * c - 1, "skim": 2 * c, "hierarchical": 2 * c + 1, "preview": c + 2, "iterative": F.least(F.lit(spec.max_rounds), c)}
    return (more[reader] if reader in more else expected_calls(reader, c, spec)).cast("bigint")


def most_tokens(reader: str, n, tokens, question_tokens: int, spec: ReadSpec = ReadSpec()):
    """Tokens a reader sends at most over ``n`` chunks of ``tokens`` in all: each call at its budget, each chunk once."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (n, tokens))
    once = {"stuff": F.least(t, F.lit(spec.budget)), "retrieve": F.least(t, F.lit(spec.budget)), "screen": F.least(t, F.lit(spec.budget)), "extract": t}
    if reader == "ensemble":
        return sum((most_tokens(m, c, t, question_tokens, spec) for m in spec.members), F.lit(spec.budget)).cast("bigint")
    body = once[reader] if reader in once else t + (most_calls(reader, c, spec) - F.least(c, most_calls(reader, c, spec))) * spec.budget + F.when(F.lit(reader == "refine"), c * spec.budget).otherwise(0)
    return (body + most_calls(reader, c, spec) * question_tokens).cast("bigint")


def expected_calls(reader: str, n, spec: ReadSpec = ReadSpec()):
    """Calls a reader is expected to make over ``n`` chunks, as a Column."""
    c = F.col(n) if isinstance(n, str) else n
    one = F.lit(1)
    table = {
        "stuff": one, "map_reduce": c + F.ceil(c / 5), "refine": c, "skim": c + 1, "retrieve": one, "rerank": F.least(F.lit(spec.prefilter), c) + 1,
        "hierarchical": c + F.ceil(c / spec.fan_in) + 1, "iterative": F.lit(spec.max_rounds + 1), "extract": c, "screen": one, "preview": c,
    }
    if reader == "ensemble":
        return sum((expected_calls(m, c, spec) for m in spec.members), F.lit(1)).cast("bigint")
    return table[reader].cast("bigint")


def tree_levels(n: int, fan_in: int) -> int:
    """Levels of a tree of groups of ``fan_in`` over n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_in), levels + 1
    return levels


@dataclass(frozen=True)
class Recipe:
    clean: str
    segment: str
    max_tokens: int
    overlap: int
    read: ReadSpec


#: The built-in recipes.
RECIPES = {
    "fast": Recipe("standard", "paragraph", 4000, 0, ReadSpec("stuff")),
    "precise": Recipe("standard", "sentence", 600, 60, ReadSpec("skim")),
    "needle": Recipe("standard", "semantic", 500, 50, ReadSpec("retrieve", top_k=8)),
    "thorough": Recipe("standard", "paragraph", 1200, 120, ReadSpec("map_reduce")),
    "survey": Recipe("standard", "structural", 1500, 0, ReadSpec("hierarchical", fan_in=5)),
    "narrative": Recipe("standard", "paragraph", 1500, 0, ReadSpec("refine")),
    "scanned": Recipe("scan", "page", 2000, 0, ReadSpec("rerank", prefilter=25, top_k=6)),
    "research": Recipe("academic", "structural", 900, 90, ReadSpec("iterative", top_k=5, max_rounds=4)),
    "consensus": Recipe("standard", "recursive", 1000, 100, ReadSpec("ensemble")),
    "legacy": Recipe("legacy", "paragraph", 3000, 0, ReadSpec("map_reduce")),
}


def auto_route(tokens, room: int = 100_000):
    """fast where a document's tokens fit half the room (50 000 at most), else thorough."""
    return F.when(tokens <= min(50_000, room // 2), "fast").otherwise("thorough")


def chunked(blocks: DataFrame, recipe: Recipe) -> DataFrame:
    """The chunks that a recipe reads, cleaned and segmented, written once."""
    from foliospark.functions.clean import clean
    from foliospark.operators.segment import SegmentSpec, segment

    return cut(segment(blocks.withColumn("text", clean(F.col("text"), recipe.clean)), SegmentSpec(recipe.segment, recipe.max_tokens, recipe.overlap)))


def answer_documents(blocks: DataFrame, question: str, client: Client, recipe: str | Recipe = "thorough", room: int = 100_000) -> DataFrame:
    """Clean, segment and read blocks(document, block_id, text[, page, section]) under a recipe.

    "auto" takes for each document the recipe that ``auto_route`` names for its tokens in ``room``.
    """
    if recipe != "auto":
        r = RECIPES[recipe] if isinstance(recipe, str) else recipe
        return read(chunked(blocks, r), question, client, r.read)
    sizes = blocks.groupBy("document").agg(F.sum(count_tokens(F.col("text"))).alias("tokens"))
    routed = cut(sizes.select("document", auto_route(F.col("tokens"), room).alias("route")))
    parts = [answer_documents(blocks.join(routed.filter(F.col("route") == name), "document", "left_semi"), question, client, name) for name in ("fast", "thorough")]
    return parts[0].unionByName(parts[1])


__all__ = ["NONE", "READERS", "RECIPES", "ReadSpec", "Recipe", "answer_documents", "auto_route", "expected_calls", "merge_levels", "read", "register_reader", "tree_levels"]
