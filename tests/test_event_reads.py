"""Inputs that several parts of a query read are made once."""

from cuesheet.plans import roles
from cuesheet.plans.registry import all_queries


def test_blueprint_reads_the_events_once(spark, monkeypatch):
    read, plain = [], roles.table
    monkeypatch.setattr(roles, "table", lambda spark, sf, name: read.append(name) or plain(spark, sf, name))
    rows = all_queries()["scene_blueprint"].run(spark, "/root/testdata/sf0.001")
    events = plain(spark, "/root/testdata/sf0.001", "events").count()
    assert rows.count() == events and read == ["events"]


def test_audited_claims_are_made_once(spark):
    out = all_queries()["claim_audit"].run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
