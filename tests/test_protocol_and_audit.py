from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliospark.operators import audit as A
from foliospark.operators import rank as R
from foliospark.operators import segment as S
from foliospark.operators.model import mock_client
from foliospark.plans import protocol as P
from foliospark.plans import readers as D


def test_protocol_round_trip_and_placeholders():
    for p in P.PROTOCOLS.values():
        assert P.from_json(P.to_json(p)) == p
        with pytest.raises(ValueError, match="still to be written"):
            P.ready(p)
    mine = P.Protocol("mine", "What?", recipe="fast")
    assert P.ready(mine) is mine and P.drift(mine, P.Protocol("mine", "Why?", recipe="fast")) == {"question": ("What?", "Why?")}
    with pytest.raises(ValueError):
        P.from_json('{"name": "x", "question": "y", "code": 1}')


def test_audit_page_escapes_and_counts(spark):
    flow = spark.createDataFrame([(1, "<b>found</b>", 2)], "step int, stage string, n long")
    figures = spark.createDataFrame([(1, False)], "sentence_id long, backed boolean")
    page = A.audit_page("A & B", "{}", [("Flow", flow, ["step"])], A.caveats(flow, figures))
    assert "&lt;b&gt;found" in page and "A &amp; B" in page and "1 figures" in page


def test_propositions_and_premise(spark):
    blocks = spark.createDataFrame([("d", 1, "one two"), ("e", 1, "bad")], "document string, block_id int, text string")
    got = S.seg_proposition(blocks, mock_client(lambda p: "no json" if "bad" in p else '["a b", "c"]')).orderBy("document", "chunk_id").collect()
    assert [(r.document, r.text) for r in got] == [("d", "a b"), ("d", "c"), ("e", "bad")]
    chunks = spark.createDataFrame([("d", 1, "x", 1)], "document string, chunk_id int, text string, tokens int")
    one = D.read(chunks, "q?", mock_client(lambda p: "FALSE_PREMISE: it was 2019\nRevenue rose."), D.ReadSpec("stuff")).first()
    assert (one.premise, one.answer, one.not_found) == ("it was 2019", "Revenue rose.", False)


def test_embed_falls_back(spark):
    R.EMBEDDERS["broken"] = lambda c: F.array(F.lit(float("nan")))
    row = R.embed(spark.createDataFrame([("some words here",)], "t string"), "t", "v", "broken").first()
    assert row.embedding_source == "lexical" and sum(x * x for x in row.v) == pytest.approx(1)
    del R.EMBEDDERS["broken"]
