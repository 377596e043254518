"""Every registered query against its SQL on whole tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


OWN = sorted(set(entry.oracle_sql()) - set(entry.llm.oracle_sql() if entry.llm else ()))


@pytest.mark.parametrize("name", OWN)
def test_agrees_with_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == []


def test_every_query_has_sql():
    own = set(entry.queries()) - set(entry.llm.queries() if entry.llm else ())
    assert own == set(OWN)


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name, rows",
    [
        ("approval_rate_selected", 22),
        ("bin_processor_stats", 210),
        ("bin_processor_stats_all", 571),
        ("poor_pairs", 2),
        ("active_bins", 42),
        ("active_processors", 10),
        ("eval_roc", 57 + 1),  # the origin
    ],
)
def test_known_sizes(spark, name, rows):
    assert entry.queries()[name](spark, SF).count() == rows


def test_known_null_rates(spark):
    assert entry.queries()["approval_rate_selected"](spark, SF).where("ar IS NULL AND rnk = 1").count() == 4
