"""Findings of round 3: tables of names don't go through the driver."""

import pytest

import __spark_entry__ as entry
from ledgerloom import queries_identity
from ledgerloom.operators import identity


@pytest.mark.parametrize("name", ["w_group_split", "a_split_checks"])
def test_names_are_not_broadcast(spark, monkeypatch, name):
    """joins with names or groups are shuffled, and groups are found once."""
    plans, found = [], []
    for module in (identity, queries_identity):
        monkeypatch.setattr(module, "stored", lambda df, n, f=identity.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, n), raising=False)
    monkeypatch.setattr(identity, "components", lambda links, f=identity.components: found.append(1) or f(links))
    out = entry.queries()[name](spark, "/root/testdata/sf0.001")
    if name == "w_group_split":
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    # What a stratum's parts begin with is bounded (4,096 rows a stratum); nothing else may be sent.
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and "_q#" not in line]
    assert len(plans) > 5 and not sent and len(found) == 1
