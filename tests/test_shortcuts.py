"""Shortcuts, prompts, and replies that must fit a schema."""

from __future__ import annotations

import json

import pytest

from foliospark.operators import model as M
from foliospark.operators.model import mock_client
from foliospark.plans import prompts as T
from foliospark.plans import readers as P
from foliospark.plans import shortcuts as S
from foliospark.plans import writing as W

SCHEMA = {"type": "object", "properties": {"n": {"type": ["integer", "null"]}, "kind": {"enum": ["a", "b"]}, "items": {"type": "array", "items": {"type": "number"}}}, "required": ["n"], "additionalProperties": False}


@pytest.mark.parametrize(
    "reply, problem",
    [
        ('{"n": 1}', None), ('```json\n{"n": null, "kind": "a", "items": [1, 2.5]}\n```', None), ('{"n": 2.0}', None), ("no", "no JSON"), (None, "no JSON"), ("{}", "lacks n"), ('{"n": "1"}', "n is no integer or null"), ('{"n": true}', "n is no integer"),
        ('{"n": 1, "kind": "c"}', "none of a, b"), ('{"n": 1, "x": 2}', "has x"), ('{"n": 1, "items": [1, "2"]}', "items[1] is no number"), ("[1]", "reply is no object"),
    ],
)
def test_replies_against_a_schema(reply, problem):
    got = M.reply_problem(reply, SCHEMA)
    assert got is None if problem is None else problem in got


def test_a_reply_that_does_not_fit_is_asked_for_once_more(spark):
    def reply(prompt):
        if "gone" in prompt:
            raise OSError("gone")
        return "{}" if "never" in prompt or "could not be used" not in prompt and "late" in prompt else json.dumps({"n": 7})

    asked = spark.createDataFrame([(k, p) for k, p in enumerate(["first", "late", "never", "gone"])], "k int, prompt string")
    got = {r.prompt: (r.reply, r.ok, r.problem) for r in M.call_json(asked, mock_client(reply), SCHEMA).collect()}
    assert got == {"first": ('{"n": 7}', True, None), "late": ('{"n": 7}', True, None), "never": ("{}", True, "reply lacks n"), "gone": (None, False, None)}


def test_every_kind_of_request_has_a_prompt():
    kinds = [P.ASK, P.EVIDENCE, P.MERGE, P.SUMMARY, P.DRAFT, P.MARK, P.PLAN, P.STEP, P.FILL, P.SCREEN, W.CLAIMS, W.MERGE_CLAIMS, W.OUTLINE, W.WRITE, W.JOIN, W.REVISE, "STATEMENTS", "CONTEXT"]
    assert set(kinds) == set(T.PROMPTS) and T.system_prompt(f"{P.MARK}: how?\n\nx") == T.PROMPTS["SCORE"] and T.system_prompt("anything") is None


def test_shortcuts(spark):
    client = mock_client(lambda p: "45.2 million" if "45.2" in p else "NOT_IN_DOCUMENT")
    assert S.answer_question(spark, S.EXAMPLE, "What does the berth cost?", client).first().answer == "45.2 million"
    assert [r.section for r in S.parse_text(spark, S.EXAMPLE, method="structural").orderBy("chunk_id").collect()] == ["Harbour report", "Works", "Outlook"]
    for read in (S.read_chunked, S.read_retrieval, S.read_hierarchical, S.read_multipass):
        assert read(spark, S.EXAMPLE, "cost of the berth", client).count() == 1
    rows = {r.ending: (r.ready, r.needs) for r in S.extractors(spark).collect()}
    assert rows["md"] == (True, None) and rows["pdf"][1] == "pypdf"
    S.flush_caches(spark)
