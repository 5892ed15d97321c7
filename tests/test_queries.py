"""Every registered query that SQL can express, against DuckDB; the others run and keep their schema."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from foliospark import catalogue
from tests.comparison import duck, rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir)) == duck(sf_dir, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_twice_alike(spark, sf_dir, name):
    first = rows(catalogue.QUERIES[name](spark, sf_dir).drop("seconds"))
    assert first[0]
    assert first == rows(catalogue.QUERIES[name](spark, sf_dir).drop("seconds"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
