"""A cross-section of registered queries against their SQL on the smallest data set."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import check

SF = "/root/testdata/sf0.001"
NAMES = (
    "f5_reliability_by_phone", "e2_context_sessions", "e11_merge_spans", "j4_j5_rule_verdicts", "a5_c4_h9_build_processed",
    "c6_resolve_people", "d22_repeated_cases", "d31_j20_check_standards", "j17_misplaced_defects", "j23_coverage_candidates",
)


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, message = check(spark, name, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
