"""Plans that matter at scale: one exchange per file, pruned scans, no Python on built-in paths."""

import re

import pytest

from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lex_tokens", "rest_of_line", "running_freq", "minhash_sig", "position_kinds"])
def test_one_exchange(spark, name):
    p = plan(spark, name)
    if name != "position_kinds":
        assert len(re.findall("Exchange hashpartitioning", p)) == 1
    assert "Python" not in p and "Arrow" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_top_k_prunes_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "example_dump")


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull" in plan(spark, "pair_counts")
