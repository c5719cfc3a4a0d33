"""Queries over whole tables, without a choice of ids."""

from __future__ import annotations

from parlance.plans.queries import QUERIES
from parlance.sources.tables import read

DATA = "/root/testdata/sf0.001"


def test_newest_of_all_sessions(spark):
    ids = [r["id"] for r in QUERIES["src10_snk6_newest_of_all"](spark, DATA).collect()]
    every = {r["conv_id"] for r in read(spark, DATA, "conversations").collect()}
    assert len(ids) == len(set(ids)) == min(60, len(every)) and set(ids) <= every and len({i % 10 for i in ids}) > 5


def test_all_members(spark):
    suppliers, customers = (read(spark, DATA, t).count() for t in ("supplier", "customer"))
    out = QUERIES["join3_all_members"](spark, DATA)
    assert out.count() == max(suppliers, customers) and out.where("username <> 'Member'").count() == suppliers


def test_scope_by_a_system_turn(spark):
    channels = {r["channel_id"] for r in QUERIES["tvf3_search_system_scope"](spark, DATA).collect()}
    system = {r["conv_id"] for r in read(spark, DATA, "conversations").where("role = 'system'").collect()}
    assert channels and channels <= system


def test_exists_collects_no_arrays(spark):
    plan = QUERIES["agg9_exists"](spark, DATA)._jdf.queryExecution().toString()
    assert "bool_or" in plan and "collect_list" not in plan
