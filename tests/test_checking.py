"""The number checker reads tables that are made once: facts, consulted facts and answers."""

from quaestor.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_facts_are_made_once(spark):
    plan = catalogue.QUERIES["number_checker_summary"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "InMemoryRelation" not in plan
