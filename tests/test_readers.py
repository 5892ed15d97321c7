"""Readers: golden call counts, plans, follow-up queries, desks, runs."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from foliospark.operators import extract as E
from foliospark.operators import model as M
from foliospark.operators.model import mock_client
from foliospark.plans import corpus as C
from foliospark.plans import readers as P
from foliospark.plans import runs as U


def six(spark, sections=None):
    rows = [("d", i, f"part {i} tells of matter {i}", 6, sections[i - 1] if sections else None) for i in range(1, 7)]
    return spark.createDataFrame(rows, "document string, chunk_id int, text string, tokens int, section string")


def answer(prompt: str) -> str:
    return "2, 3" if prompt.startswith(P.PLAN) else "7" if prompt.startswith(P.MARK) else "all is well"


#: Calls over six chunks, with evidence in each of them.
GOLDEN = {"stuff": 1, "map_reduce": 7, "refine": 6, "skim": 7, "retrieve": 1, "rerank": 7, "hierarchical": 7, "iterative": 1, "ensemble": 15}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_calls(spark, name):
    got = P.read(six(spark), "how?", mock_client(answer), P.ReadSpec(name)).collect()
    assert [r.calls for r in got] == [GOLDEN[name]] and got[0].answer.startswith("all is well")


@pytest.mark.parametrize("name", ["map_reduce", "rerank", "hierarchical", "iterative", "preview"])
def test_other_readers_conform(spark, name):
    from foliospark.plans import conformance

    assert {r.rule: r.detail for r in conformance.check_reader(spark, name).collect() if r.passed is False} == {}


def test_preview_reads_skims_and_names_what_it_skipped(spark):
    asked = []

    def reply(prompt):
        if prompt.startswith(P.PLAN):
            assert "1: Intro\n2: Methods\n3: Results" in prompt
            return json.dumps({"read": [3], "skim": [2, 9]})
        if prompt.startswith(P.EVIDENCE):
            return "NONE" if "part 3 " in prompt else "part 4 tells of matter 4"
        return prompt

    chunks = six(spark, ["Intro", "Intro", "Methods", "Methods", "Results", "Results"])
    got = P.read(chunks, "q", mock_client(reply), P.ReadSpec("preview")).first()
    assert got.chunks_used == [4, 5, 6] and got.calls == 4 and got.notes == {"skipped": "Intro"} and not got.partial
    tight = P.read(chunks, "q", mock_client(reply), P.ReadSpec("preview", budget=6)).first()
    assert tight.chunks_used == [4, 5, 6] and tight.calls == 5  # chunk 6 is over the budget and skimmed
    one = P.read(chunks.filter("chunk_id = 1"), "q", mock_client(reply), P.ReadSpec("preview")).first()
    assert one.calls == 1 and one.chunks_used == [1] and not asked
    lost = P.read(chunks, "q", mock_client(lambda p: "no plan" if p.startswith(P.PLAN) else "all"), P.ReadSpec("preview")).first()
    assert lost.chunks_used == [1, 2, 3, 4, 5, 6] and lost.calls == 2


def test_iterative_follows_the_next_query_and_stops_on_a_repeated_one(spark):
    rows = [(d, i, t, 3) for d in "abc" for i, t in enumerate(["apples are red", "the moon is far", "keys open doors", "rivers run down"], 1)]
    chunks = spark.createDataFrame(rows, "document string, chunk_id int, text string, tokens int")

    def reply(prompt):
        query, _, body = prompt.partition("\n\n")[2].partition("\n\n")
        if "doors" in body:
            return json.dumps({"can_answer": True, "answer": "doors", "quotes": ["keys open doors"]})
        return json.dumps({"can_answer": False, "answer": "NOT_IN_DOCUMENT", "next_query": "keys" if "apples" in query else "APPLES"})

    got = P.read(chunks, "apples", mock_client(reply), P.ReadSpec("iterative", top_k=1, embedder=None)).collect()
    assert {(r.document, r.answer, r.calls, tuple(r.chunks_used), r.partial) for r in got} == {(d, "doors", 2, (1, 3), False) for d in "abc"}
    stuck = P.read(chunks, "apples", mock_client(lambda p: json.dumps({"can_answer": False, "next_query": "Apples"})), P.ReadSpec("iterative", top_k=1, embedder=None)).collect()
    assert {(r.calls, r.not_found, r.partial) for r in stuck} == {(1, True, True)}
    loose = P.read(chunks, "apples", mock_client(lambda p: json.dumps({"can_answer": True, "answer": "x", "quotes": ["nobody said"]})), P.ReadSpec("iterative", top_k=1)).collect()
    assert all(r.partial and r.answer == "x" for r in loose)


def test_retrieval_by_vectors_finds_what_terms_rank_low_and_diversity_spreads(spark):
    rows = [("d", i, t, 4) for i, t in enumerate(["harbour walls crumble", "harbour walls crumble", "harbour walls crumble", "ships and harbour", "plain sentence here"], 1)]
    chunks = spark.createDataFrame(rows, "document string, chunk_id int, text string, tokens int")
    said = mock_client(lambda p: p)
    near = P.read(chunks, "harbour walls", said, P.ReadSpec("retrieve", top_k=2)).first()
    wide = P.read(chunks, "harbour walls", said, P.ReadSpec("retrieve", top_k=2, weight=0.5)).first()
    assert near.chunks_used == [1, 2] and wide.chunks_used[0] == 1 and wide.chunks_used[1] in (4, 5)
    strict = P.read(chunks, "zebra", said, P.ReadSpec("retrieve", top_k=3, min_score=0.9)).first()
    assert strict.chunks_used == [1]


def test_score_queries_agree_with_one_question(spark):
    chunks = six(spark).withColumn("text", F.concat("text", F.when(F.col("chunk_id") % 2 == 0, " and part again").otherwise("")))
    one = {r.chunk_id: r.score for r in P.score_chunks(chunks, "part again 3").collect()}
    many = {r.chunk_id: r.score for r in P.score_queries(chunks, spark.createDataFrame([("d", "part again 3")], "document string, query string")).collect()}
    assert one == many and len(one) == 6


def test_unknown_citations_make_an_answer_partial(spark):
    for said, partial in (("Yes [chunk 2].", False), ("Yes [chunk 2, 9].", True), ("Yes [chunk two].", True)):
        assert P.read(six(spark), "q", mock_client(lambda p, said=said: said), P.ReadSpec("stuff")).first().partial is partial


@pytest.fixture
def folder(spark):
    from foliospark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/desk-{uuid.uuid4().hex}"


def test_a_desk_sends_nothing_twice_and_nothing_beyond_its_limits(spark, folder):
    sent = spark.sparkContext.accumulator(0)

    def reply(prompt):
        sent.add(1)
        return answer(prompt)

    desk = M.Desk(mock_client(reply), folder, M.Governor(max_calls=4))
    got = P.read(six(spark), "how?", desk, P.ReadSpec("refine")).first()
    assert sent.value == 4 == desk.spent["calls"] and got.partial and got.chunks_used == [1, 2, 3, 4]
    told = desk.ledger(spark).orderBy("step").collect()
    assert [r.refused for r in told] == [None] * 4 + ["calls"] * 2 and [r.step for r in told] == [1, 2, 3, 4, 5, 6]
    again = M.Desk(mock_client(reply), folder, M.Governor(max_calls=2))
    got = P.read(six(spark), "how?", again, P.ReadSpec("refine")).first()
    assert sent.value == 6 and not got.partial and got.calls == 6
    M.trace_save(again.ledger(spark), f"{folder}/saved.json")
    back = M.trace_load(spark, f"{folder}/saved.json")
    assert back.count() == 12 and back.filter("cached").count() == 4
    asked = six(spark).select(F.lit("QUESTION: how?\n\n[chunk 1]\npart 1 tells of matter 1").alias("prompt"), F.lit("mock").alias("model"), "chunk_id").limit(1)
    assert M.replay(asked, back, "mock", "chunk_id").first().reply == "all is well"


def test_prices_limit_a_desk(spark, folder):
    row = ("dear", "chat", 1000, 100, 100.0, 100.0, None)
    desk = M.Desk(mock_client(answer), folder, M.Governor(max_cost_usd=0.02), model="dear", max_output=50, prices=(row,))
    got = P.read(six(spark), "how?", desk, P.ReadSpec("map_reduce")).first()
    assert got.partial and 0 < desk.spent["usd"] <= 0.02
    none = M.Desk(mock_client(answer), f"{folder}x", M.Governor(), model="unheard-of")
    assert P.read(six(spark), "how?", none, P.ReadSpec("stuff")).first().not_found and none.spent["calls"] == 0


FIELDS = [E.Field("n", "integer"), E.Field("name", "string")]


def test_an_extraction_run_tells_lost_replies_and_reads_copies_once(spark):
    blocks = spark.createDataFrame([(d, i, f"{t} {i}") for d, t in (("a", "alpha"), ("b", "beta"), ("c", "alpha"), ("x", "lost")) for i in (1, 2)], "document string, block_id int, text string")
    chunks = blocks.select("document", F.col("block_id").alias("chunk_id"), "text", F.lit(2).alias("tokens"))
    calls = spark.sparkContext.accumulator(0)

    def reply(prompt):
        calls.add(1)
        text = prompt.rpartition("]\n")[2]
        if "lost" in text:
            raise OSError("gone")
        if text == "beta 2":
            return "not json"
        return json.dumps({"n": text.split()[1], "n__quote": text, "name": text.split()[0].upper(), "name__quote": "nowhere"})

    table, evidence = U.extract_documents(blocks, FIELDS, "goal", mock_client(reply), chunks=chunks)
    got = {r.document: (r.n, r.name, r.n_unverified, r.conflicts, r.status, r.duplicate_of) for r in table.collect()}
    assert got == {"a": (1, "ALPHA", 1, "n", "ok", None), "b": (1, "BETA", 1, "", "incomplete", None), "c": (1, "ALPHA", 1, "n", "duplicate", "a"), "x": (None, None, 0, "", "failed", None)}
    assert calls.value == 6 and {(r.field, r.verified) for r in evidence.collect()} == {("n", True), ("name", False)}
    strict = {r.document: (r.n, r.name) for r in U.extract_documents(blocks, FIELDS, "goal", mock_client(reply), chunks=chunks, require_quote=True)[0].collect()}
    assert strict["a"] == (1, None)
    assert [(r.study, r.document) for r in U.usable_studies(table).orderBy("study").collect()] == [(1, "a"), (2, "b")]
    got = P.read(chunks.filter("document = 'a'"), "goal", mock_client(reply), P.ReadSpec("extract", settings={"fields": FIELDS})).first()
    assert json.loads(got.answer) == {"n": 1, "name": "ALPHA"} and got.calls == 2 and got.notes == {"conflicts": "n"}


def test_a_screening_run_reads_openings(spark):
    words = lambda n, w: " ".join([w] * n)
    blocks = spark.createDataFrame([("long", 1, words(50, "w")), ("two", 1, words(8, "a")), ("two", 2, words(8, "b")), ("twin", 1, words(8, "a")), ("twin", 2, words(8, "b")), ("bad", 1, "bad")], "document string, block_id int, text string")
    chunks = blocks.select("document", F.col("block_id").alias("chunk_id"), "text", F.size(F.split("text", " ")).alias("tokens"))

    def reply(prompt):
        opening = prompt.rpartition("\n\n")[2]
        if opening == "bad":
            return "?"
        return json.dumps({"decision": "exclude", "criterion": "Off topic" if opening[0] == "w" else "a whim", "reason": "r", "quote": opening[:5]})

    rows = U.screen_documents(blocks, "q", mock_client(reply), ["good"], ["Off topic"], 10, chunks=chunks).collect()
    got = {r.document: (r.decision, r.criterion_valid, r.verified, r.seen_tokens, r.document_tokens, r.truncated, r.status, r.duplicate_of) for r in rows}
    assert got["long"] == ("exclude", True, True, 10, 50, True, "ok", None) and got["bad"][0] is None and got["bad"][6] == "failed"
    assert got["two"] == ("unclear", False, True, 8, 16, True, "duplicate", "twin") or got["twin"] == ("unclear", False, True, 8, 16, True, "duplicate", "two")
    said = P.read(chunks.filter("document = 'long'"), "q", mock_client(reply), P.ReadSpec("screen", budget=10, settings={"exclusion": ["Off topic"]})).first()
    assert (said.answer, said.partial, said.calls, said.notes) == ("exclude", True, 1, {"reason": "r"})


def test_read_many_stays_within_its_ceiling_and_goes_on_later(spark, folder):
    blocks = spark.createDataFrame([(f"d{k}", 1, f"text {k % 4}") for k in range(6)], "document string, block_id int, text string")
    first = {r.document: r.status for r in C.read_many(blocks, "q", mock_client(answer), "fast", folder, max_calls=2).collect()}
    assert first == {"d0": "ok", "d1": "ok", "d2": "skipped", "d3": "skipped", "d4": "duplicate", "d5": "duplicate"}
    later = {r.document: r.status for r in C.read_many(blocks, "q", mock_client(answer), "fast", folder, max_calls=2).collect()}
    assert later == {"d0": "restored", "d1": "restored", "d2": "ok", "d3": "ok", "d4": "duplicate", "d5": "duplicate"}


def test_auto_takes_a_recipe_a_document(spark):
    blocks = spark.createDataFrame([("short", 1, "few words"), ("long", 1, "many words " * 400)], "document string, block_id int, text string")
    got = {r.document: r.reader for r in P.answer_documents(blocks, "q", mock_client(answer), "auto", 600).collect()}
    assert got == {"short": "stuff", "long": "map_reduce"}


def test_refine_takes_as_many_jobs_however_long_a_document(spark):
    """A chunk more is no job more, a failed step keeps the draft and makes the answer partial, copies are read once."""

    def answer(prompt):
        if "w7 " in prompt:
            raise OSError("down")
        return "NOT_IN_DOCUMENT." if prompt.startswith(P.ASK) and "w1 " in prompt else f"{prompt.count('[chunk')} {prompt[-3:]}"

    def jobs(n):
        rows = [(d, k, f"w{k} {k % 10}", 2) for d in "ab" for k in range(1, n + 1)] + [("c", 1, "w1 1", 2)]
        spark.sparkContext.setJobGroup(f"refine-{n}", "")
        got = P.read(spark.createDataFrame(rows, "document string, chunk_id int, text string, tokens int"), "q?", mock_client(answer), P.ReadSpec("refine")).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"refine-{n}")), {r.document: r for r in got}

    few, _ = jobs(3)
    many, got = jobs(12)
    assert many == few
    assert got["a"].partial and got["a"].calls == 12 and got["a"].chunks_used == [2, 3, 4, 5, 6, 8, 9, 10, 11, 12] and got["b"].answer == got["a"].answer
    assert got["c"].not_found and got["c"].calls == 1


def test_the_absence_verdict_is_the_same_in_python(spark):
    from foliospark.functions.text import is_not_found, not_found

    said = ["", "  ", "**Not in document.**", "NOT_IN_DOCUMENT: it is not", "NOT IN DOCUMENT (none)", "not in document that we have", "It is NOT_IN_DOCUMENT", "€not_in_document\u2028", "not_in_document\u2028\n"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", is_not_found(F.col("s")).alias("b")).collect()
    assert [not_found(r.s) for r in rows] == [r.b for r in rows]


def test_an_ensembles_members_stand_in_plans_of_their_own(spark, monkeypatch):
    """The chunks are made once for all members, and no plan of an ensemble is larger than the largest of a member alone,
    but for the last call, which reads their written answers."""
    sizes, made = [], spark.sparkContext.accumulator(0)
    operators = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")

    def noted(df, *a, real=P.cut, **b):
        sizes.append(operators(df))
        return real(df, *a, **b)

    def counted(parts):
        for pdf in parts:
            made.add(len(pdf))
            yield pdf

    monkeypatch.setattr(P, "cut", noted)
    chunks = six(spark).mapInPandas(counted, "document string, chunk_id int, text string, tokens int, section string")
    alone = []
    for m in ("stuff", "skim", "refine"):
        alone.append(operators(P.read(six(spark), "how?", mock_client(answer), P.ReadSpec(m))))
    alone, sizes = [*alone, *sizes], sizes.clear() or sizes
    got = P.read(chunks, "how?", mock_client(answer), P.ReadSpec("ensemble", members=("stuff", "skim", "refine")))
    assert [r.calls for r in got.collect()] == [1 + 7 + 6 + 1] and made.value == 6
    assert max(sizes) <= max(alone) + 2  # the columns that are kept


def test_skim_counts_the_lines_that_chunks_do_not_hold(spark):
    told = {
        "one": "Part one [chunk 1]\n\n \ntells  of fish", "two": "nothing of this\nfish; [chunk 2]\nnor \\E this", "three": "*NONE*", "four": None, "five": "says",
    }

    def reply(prompt):
        word = prompt.split()[-1]
        if prompt.startswith(P.ASK):
            return "said"
        if told[word] is None:
            raise OSError("down")
        return told[word]

    rows = [("a", 1, "part one tells of fish and one", 7), ("a", 2, "of fish, \\E says two", 5), ("b", 1, "three", 1), ("b", 2, "four", 1), ("c", 1, "it says five", 3), ("d", 1, "three", 1)]
    got = {r.document: r for r in P.read(spark.createDataFrame(rows, "document string, chunk_id int, text string, tokens int"), "q?", mock_client(reply), P.ReadSpec("skim")).collect()}
    assert got["a"].notes == {"unverified_lines": "3"} and got["a"].partial and got["a"].chunks_used == [1, 2] and got["a"].calls == 3
    assert got["b"].not_found and got["b"].partial and got["b"].chunks_used == [] and got["b"].calls == 2 and got["b"].notes is None
    assert got["c"].answer == "said" and not got["c"].partial and got["c"].chunks_used == [1] and got["c"].calls == 2 and got["c"].notes is None
    assert got["d"].not_found and not got["d"].partial and got["d"].calls == 1
