from __future__ import annotations

import pytest

from foliospark import options as O
from foliospark.plans import conformance as C
from foliospark.plans import readers as R


@pytest.mark.parametrize("name", ["paragraph", "sentence", "fixed", "recursive"])
def test_segmenters_conform(spark, name):
    assert {r.rule: r.detail for r in C.check_segmenter(spark, name).collect() if not r.passed} == {}


@pytest.mark.parametrize("name", ["stuff", "retrieve", "skim", "refine"])
def test_readers_conform(spark, name):
    assert {r.rule: r.detail for r in C.check_reader(spark, name).collect() if r.passed is False} == {}


def test_a_loose_reader_is_told(spark):
    R.READERS["loose"] = (lambda chunks, q, client, spec: R.read_stuff(chunks.filter("document = 'a'"), q, client, spec), "none|1|none")
    got = {r.rule: r.passed for r in C.check_reader(spark, "loose").collect()}
    del R.READERS["loose"]
    assert got["runs"] and not got["one_answer_a_document"] and not got["named"] and got["calls_within_cost"] is None


def test_options(spark):
    O.set_option(spark, "workers", 99)
    O.set_option(spark, "max_calls", None)
    with pytest.warns(UserWarning):
        O.set_option(spark, "safety_margin", "much")
    assert O.option(spark, "workers") == 32 and O.option(spark, "max_calls") is None and O.option(spark, "safety_margin") == 0.1
    for bad in ("", "NA", float("nan"), -1):
        with pytest.raises(ValueError):
            O.set_option(spark, "max_cost_usd", bad)
    with pytest.raises(KeyError):
        O.set_option(spark, "speed", 1)
    g = O.governor(spark)
    assert g.max_calls is None and g.max_cost_usd == 5.0
    for name in ("workers", "max_calls"):
        spark.conf.unset(O.PREFIX + name)
