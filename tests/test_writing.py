from __future__ import annotations

import json

import pytest

from foliospark.operators.model import mock_client
from foliospark.plans import writing as W


def studies(spark, n=6):
    return spark.createDataFrame([(i, f"[study {i}]\neffect: {i}") for i in range(1, n + 1)], "study long, text string")


def reply(prompt):
    kind = prompt.split(":", 1)[0]
    if kind == W.CLAIMS:
        ids = [int(x.split("]")[0]) for x in prompt.split("[study ")[1:]]
        if ids[0] == 5:
            return "no json"
        return json.dumps({"claims": [{"claim": f"Rises {'x' * ids[0]}", "kind": "finding", "moderator": "dose", "studies": [ids[0], "99"], "contradicts": [ids[1], ids[0]]}, {"claim": "nobody", "kind": "odd", "studies": [77]}, {"claim": " "}]})
    if kind == W.MERGE_CLAIMS:
        return '{"groups": [[1, 2], [2, 9]]}'
    if kind == W.OUTLINE:
        return '{"sections": [{"heading": "Effects", "brief": "b", "claims": [2, 2, 1]}, {"heading": "effects.", "claims": [3]}, {"heading": "Nothing", "claims": [50]}, {"heading": "Gaps", "claims": [4]}]}'
    if kind == W.WRITE:
        return "It rises [study 1]. It falls [study 3; study 99]."
    return "joined [study 1]."


CLIENT = mock_client(reply)


def test_study_batches(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (4, 50), (5, 1), (2001, 1)], "study long, tokens int")
    got = {r.study: r.batch for r in W.study_batches(df, 6).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 2001: 2000}
    assert {r.study: r.batch for r in W.study_batches(df, 1000, 2).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 2001: 2000}


def test_draw_and_reconcile(spark):
    claims, support, batches = W.draw_claims(studies(spark), "q?", CLIENT, ["dose"], reply_tokens=480)
    assert sorted((r.n_studies, r.status) for r in batches.collect()) == [(2, "failed"), (2, "ok"), (2, "ok")]
    assert sorted((r.claim, r.n_support, r.n_contradict) for r in claims.collect()) == [("Rises x", 1, 1), ("Rises xxx", 1, 1)]
    merged, sides, reason = W.reconcile_claims(claims, support, "q?", CLIENT)
    row = merged.first()
    assert reason is None and merged.count() == 1 and (row.claim, row.n_support, row.n_contradict, row.note) == ("Rises xxx", 2, 2, "also worded as 'Rises x'")
    assert sorted((r.study, r.role) for r in sides.collect()) == [(1, "support"), (2, "contradict"), (3, "support"), (4, "contradict")]
    assert W.reconcile_claims(claims, support, "q?", CLIENT, most=2)[0].count() == 1
    assert W.reconcile_claims(claims, support, "q?", mock_client(lambda p: "[1, 2]"))[2]


def placed(spark):
    claims = spark.createDataFrame([(1, "a", "finding", 2), (2, "b", "method", 1), (3, "c", "finding", 1), (4, "d", "gap", 1), (5, "e", "finding", 1)], "claim_id long, claim string, kind string, n_support int")
    return claims, *W.draw_outline(claims, "q?", CLIENT)


def test_outline(spark):
    claims, sections, placement = placed(spark)
    assert [(r.section_no, r.heading) for r in sections.orderBy("section_no").collect()] == [(1, "Effects"), (2, "What is not known")]
    assert sorted((r.section_no, r.claim_id) for r in placement.collect()) == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    assert len(W.outline_alternatives(claims, "q?", CLIENT, 2)) == 1
    lost = W.draw_outline(claims, "q?", mock_client(lambda p: "?"))
    assert sorted(r.heading for r in lost[0].collect()) == ["Findings", "What is not known"]
    with pytest.raises(ValueError):
        W.draw_outline(claims, "q?", CLIENT, most=2)


def test_claim_batches():
    got = W.claim_batches([(1, 2, [(1, 3), (2, 3)]), (2, 2, [(2, 3)]), (3, 2, [(3, 5), (4, 5), (5, 5)]), (4, 99, [(1, 3)])], 10)
    assert got == ([([1, 2], [1, 2]), ([3], [3]), ([3], [4]), ([3], [5])], [4])


def test_sections(spark):
    claims, sections, placement = placed(spark)
    support = spark.createDataFrame([(1, 1, "support"), (1, 2, "support"), (2, 2, "support"), (3, 6, "support"), (4, 3, "support"), (5, 4, "contradict")], "claim_id long, study long, role string")
    got = {r.section_no: r for r in W.synthesise(sections, placement, claims, support, studies(spark), "q?", CLIENT).collect()}
    assert (got[1].n_cited, got[1].n_unknown, got[1].n_unsupplied, got[1].partial, got[1].calls) == (3, 1, 1, True, 1)
    few = {r.section_no: r for r in W.synthesise(sections, placement, claims, support, studies(spark), "q?", CLIENT, 20).collect()}
    assert few[1].text == "joined [study 1]." and few[1].calls > 2
    failed = W.synthesise(sections, placement, claims, support, studies(spark), "q?", mock_client(lambda p: "")).collect()
    assert all(r.partial and r["text"] is None for r in failed)


@pytest.mark.parametrize("name, after, kept", [
    ("cut", "Trials may suggest a rise of 5 [study 1].", True), ("cut", "The two trials, as we saw, may suggest a rise of 5 [study 1]. So it is. And more.", False),
    ("structure", "Trials prove a rise of 5 [study 1].", False), ("structure", "Trials may suggest a rise of 6 [study 1].", False),
    ("structure", "Trials may suggest a rise of 5 [study 1]. It is so [study 1].", False), ("register", "Trials may suggest a rise of 5.", False), ("register", " ", False),
])
def test_revise(spark, name, after, kept):
    before = "The two trials may suggest a rise of 5 [study 1]."
    row = W.revise(spark.createDataFrame([(1, before)], "section_no int, text string"), mock_client(lambda p: after), (name,)).first()
    assert (row.text == after) == kept and row.kept == ([name] if kept else []) and len(row.refused) == (0 if kept else 1)


def test_more_claims_than_a_prompt_lists_all_meet(spark):
    """Eleven claims, four to a prompt: wordings far apart are still seen together, and groups join through a claim."""
    claims = spark.createDataFrame([(k, f"claim {'abc'[k % 3]} no {k}", "finding", None, None, None) for k in range(11)], "claim_id bigint, claim string, kind string, moderator string, scope string, note string")
    support = spark.createDataFrame([(k, 100 + k, "support") for k in range(11)], "claim_id bigint, study bigint, role string")
    seen = []

    def reply(prompt):
        lines = [x.split(". ", 1) for x in prompt.partition("\n\n")[2].split("\n")]
        assert len(lines) <= 4
        return json.dumps({"groups": [[n for n, t in lines if f"claim {c} " in t] for c in "abc"]})

    merged, moved, reason = W.reconcile_claims(claims, support, "q", mock_client(reply), most=4)
    assert reason is None and {r.claim_id: r.n_support for r in merged.collect()} == {0: 4, 1: 4, 2: 3}
    assert moved.count() == 11 and not seen
    some = mock_client(lambda p: reply(p) if "no 0" in p else "?")
    assert "replies were lost" in W.reconcile_claims(claims, support, "q", some, most=4)[2]
