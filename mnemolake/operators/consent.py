"""Authorisation over grants: direct, delegated and expiring."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grant:
    grant_seq: int
    grantor: str
    grantee: str
    expires: int | None


def scope_grants(grants: DataFrame, action: str, resource: str) -> list[Grant]:
    """The grants of one scope, compared exactly; the edges that a single decision can depend on."""
    rows = grants.where((F.col("action") == action) & (F.col("resource") == resource)).select("grant_seq", "grantor", "grantee", "expires").collect()
    return [Grant(*r) for r in rows]


def active_grant(grants: Iterable[Grant], agent: str, now_ms: int) -> int | None:
    """The smallest grant to the agent that holds: it isn't expired, and its grantor is a root or itself holds one.

    A grantor that ever received the scope, expired or not, is no root. Cycles hold nothing.
    """
    grants = list(grants)
    received = {g.grantee for g in grants}
    live = [g for g in grants if g.expires is None or now_ms < g.expires]
    gives: dict[str, list[str]] = {}
    for g in live:
        gives.setdefault(g.grantor, []).append(g.grantee)
    # everybody who holds the scope by chains that don't lead through the agent, from the roots on
    holds = {g.grantor for g in live} - received
    todo = list(holds)
    while todo:
        for who in gives.get(todo.pop(), ()):
            if who != agent and who not in holds:
                holds.add(who)
                todo.append(who)
    return min((g.grant_seq for g in live if g.grantee == agent and g.grantor in holds), default=None)


def authorized(grants: DataFrame, now_ms: int) -> DataFrame:
    """(grantee, action, resource, grant_seq) of everybody who holds a scope, for all scopes at once.

    Rounds of joins from the roots down, each over the grants that are still open, until none is added; as each adds some,
    chains of any length end.
    """
    from mnemolake.session import materialize

    live = grants.where(F.col("expires").isNull() | (F.col("expires") > now_ms)).select("grant_seq", "grantor", "grantee", "action", "resource")
    received = grants.select(F.col("grantee").alias("grantor"), "action", "resource").distinct()
    key = ["grantor", "action", "resource"]
    held = materialize(live.join(received, key, "left_anti"), "held")
    open_ = materialize(live.join(held.select("grant_seq"), "grant_seq", "left_anti"), "open")
    while True:
        holders = held.select(F.col("grantee").alias("grantor"), "action", "resource").distinct()
        more = materialize(open_.join(holders, key, "left_semi"), "more")
        if more.isEmpty():
            return held.groupBy("grantee", "action", "resource").agg(F.min("grant_seq").alias("grant_seq"))
        held = held.unionByName(more.select(held.columns))
        open_ = materialize(open_.join(more.select("grant_seq"), "grant_seq", "left_anti"), "open")
