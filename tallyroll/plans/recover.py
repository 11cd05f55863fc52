"""Composed repair: failed results -> targets -> proposal -> next state -> audit again -> status of each result.

A repair runs over all results of its rule and all their targets at once. Which rows it proposes is the rule's own
operator; here it is only declared what a repair's targets are, which outcomes count as success, and how its scope is
checked, so that no job runs for a single target.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroll.operators import recovery
from tallyroll.operators.recovery import ACTIONS, REPAIRABLE_TYPES, Proposal
from tallyroll.plans.runner import recheck
from tallyroll.plans.scope import AS_OF_RANGE, EVENT
from tallyroll.plans.staging import cut
from tallyroll.sources.ledger import Tables

#: Statuses of a result after a repair.
RECOVERED, RECOVERY_FAILED, NOT_APPLICABLE = "RECOVERED", "RECOVERY_FAILED", "NOT_APPLICABLE"
OUT_OF_SCOPE, NOT_FOUND = "OUT_OF_SCOPE", "NOT_FOUND"


@dataclass(frozen=True)
class Repair:
    """One repair: its rule, the key of its targets, what it proposes for them, and which outcomes are good.

    ``timed`` rules are audited again as of the time of the repair; ``ranged`` names the column that a range scope limits.
    """

    action: str
    check: str
    target: str
    propose: Callable[[Tables, DataFrame, datetime], Proposal]
    good: tuple[str, ...]
    timed: bool = False
    ranged: str | None = None


def _chains_of(tables: Tables, events: DataFrame, now: datetime) -> Proposal:
    issue = tables.issue.join(events, "event_id", "left_semi")
    history = tables.history.join(issue.select("issue_id"), "issue_id", "left_semi")
    return recovery.restore_chain(issue, history)


#: By action. Campaign-wise repairs succeed for a campaign when every coupon they had to judge does.
REPAIRS = {r.action: r for r in (
    Repair("STOCK_RECONCILE_COUNTER", "stock", "event_id", lambda t, ids, now: recovery.reconcile_stock(t.event, t.issue, now, ids), ("SUCCESS",)),
    Repair("STOCK_REVOKE_EXCESS_ISSUANCE", "stock", "event_id", lambda t, ids, now: recovery.revoke_excess(t.event, t.issue, now, ids), ("SUCCESS",)),
    Repair("RESTORE_STATE_MACHINE", "state_chain", "event_id", _chains_of, ("RECOVERED",)),
    Repair("SYNC_TIME_TO_HISTORY", "time_sync", "event_id", lambda t, ids, now: recovery.sync_times(t.issue, t.history, ids), ("PATCHED",)),
    Repair("RESTORE_INITIAL_ISSUE_HISTORY", "issue_history_state", "issue_id",
           lambda t, ids, now: recovery.restore_initial_history(t.issue, t.history, now, ids), ("RESTORED", "ALREADY_RESOLVED")),
    Repair("EXPIRE_DELAYED_ISSUE", "expiration_lag", "issue_id",
           lambda t, ids, now: recovery.expire_delayed(t.issue, t.history, now, ids), ("EXPIRED", "ALREADY_RESOLVED"), timed=True, ranged="valid_to"),
)}
assert {(r.check, r.action) for r in REPAIRS.values()} == {(c, a) for c, actions in ACTIONS.items() for a in actions}


@dataclass(frozen=True)
class Recovery:
    """A repair's rows: ``statuses`` (one a result), ``outcomes`` (one a result and target), the proposal and the tables after it."""

    statuses: DataFrame
    outcomes: DataFrame
    proposal: Proposal
    tables: Tables


def _targets(repair: Repair, tables: Tables, asked: DataFrame, violations: DataFrame) -> DataFrame:
    """result_id, target, distinct: the campaigns or coupons that each failed result has to visit."""
    mine = violations.filter(F.col("check_name") == repair.check).join(asked, "result_id", "left_semi")
    if repair.target == "issue_id":
        if repair.check in REPAIRABLE_TYPES:
            mine = mine.filter(F.col("violation_type").isin(*REPAIRABLE_TYPES[repair.check]))
        return mine.select("result_id", F.col("target_id").alias("issue_id")).distinct()
    named = asked.filter(F.col("scope_type") == EVENT).select("result_id", "event_id")
    wide = mine.join(asked.filter(F.col("scope_type") != EVENT), "result_id", "left_semi").select("result_id", "target_id").distinct()
    if repair.check == "stock":
        found = wide.select("result_id", F.col("target_id").alias("event_id"))
    else:
        found = wide.join(tables.issue.select(F.col("issue_id").alias("target_id"), "event_id"), "target_id").select("result_id", "event_id")
    return named.unionByName(found).distinct()


def _scoped(repair: Repair, tables: Tables, asked: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with their campaign and the reason, if any, why they are not repaired for their result."""
    c = F.col
    if repair.target == "event_id":
        known = tables.event.select("event_id").distinct().withColumn("_known", F.lit(True))
        return targets.join(known, "event_id", "left").select(
            "result_id", "event_id", F.when(c("_known").isNull(), NOT_FOUND).alias("refusal"))
    limits = asked.select("result_id", "scope_type", c("event_id").alias("scope_event"), "scope_from", "scope_to")
    extra = [repair.ranged] if repair.ranged else []
    known = tables.issue.select("issue_id", "event_id", *extra)
    elsewhere: Column = (c("scope_type") == EVENT) & ~c("event_id").eqNullSafe(c("scope_event"))
    if repair.ranged:
        at = c(repair.ranged)
        inside = F.coalesce((at >= c("scope_from")) & (at < c("scope_to")), F.lit(False))
        elsewhere = elsewhere | ((c("scope_type") == AS_OF_RANGE) & ~inside)
    return targets.join(limits, "result_id").join(known, "issue_id", "left").select(
        "result_id", "issue_id", "event_id",
        F.when(c("event_id").isNull(), NOT_FOUND).when(elsewhere, OUT_OF_SCOPE).alias("refusal"))


def _cut(proposal: Proposal) -> Proposal:
    frames = {n: f if f is None else cut(f) for n, f in vars(proposal).items()}
    return Proposal(**frames)


def applied(tables: Tables, proposal: Proposal) -> Tables:
    """The tables after a proposal, whose frames have to be stored ones: ids of new history rows hang on their order."""
    event, issue, history = tables.event, tables.issue, tables.history
    if proposal.event_updates is not None:
        event = recovery.apply_changes(event, "event_id", proposal.event_updates)
    if proposal.issue_updates is not None:
        issue = recovery.apply_changes(issue, "issue_id", proposal.issue_updates)
    if proposal.history_inserts is not None or proposal.history_deletes is not None:
        inserts = proposal.history_inserts
        if inserts is not None:
            # New rows get ids behind the ones there are, unique without numbering them in one task.
            last = history.agg(F.max("history_id")).first()[0] or 0
            inserts = inserts.withColumn("history_id", F.lit(last + 1) + F.monotonically_increasing_id())
        history = recovery.apply_changes(history, "history_id", deletes=proposal.history_deletes, inserts=inserts)
    return tables.with_(event=event, issue=issue, history=history)


def recover(tables: Tables, results: DataFrame, violations: DataFrame, action: str, now: datetime) -> Recovery:
    """Repair what failed results of the action's rule found, audit the repaired campaigns again and judge each result.

    ``results``: result_id, check_name, status, scope_type, event_id, scope_from, scope_to. ``violations``: result_id, check_name,
    target_id, violation_type. A result that hasn't failed, or has no target of a kind the action repairs, is NOT_APPLICABLE
    and changes nothing. Targets that aren't there or lie outside of their result's scope fail without being touched for it.
    A result is RECOVERED when each of its outcomes is good and each of its campaigns passes its rule in EVENT scope
    afterwards. A target of several results is repaired once, and all of them see that outcome.
    """
    if action not in REPAIRS:
        raise ValueError(f"no repair is called {action!r}")
    repair, c = REPAIRS[action], F.col
    mine = results.filter(c("check_name") == repair.check)
    asked = mine.filter(c("status") == "FAIL")
    targets = cut(_scoped(repair, tables, asked, _targets(repair, tables, asked, violations)))
    proposal = _cut(repair.propose(tables, targets.filter("refusal is null").select(repair.target).distinct(), now))
    after = applied(tables, proposal)

    judged = proposal.outcomes.filter(c("outcome") != NOT_FOUND) if repair.target == "event_id" else proposal.outcomes
    good = c("outcome").isin(*repair.good)
    if repair.target == "event_id":
        # A campaign without anything to judge is in order already.
        by = judged.groupBy("event_id").agg(F.bool_and(good).alias("good"), F.min(F.when(~good, c("outcome"))).alias("worst"), F.max("outcome").alias("best"))
        told = by.select("event_id", F.coalesce("worst", "best").alias("outcome"), "good")
        joined = targets.join(told, "event_id", "left").withColumn("good", F.coalesce("good", F.lit(True))).withColumn(
            "outcome", F.coalesce("outcome", F.lit("NOT_VIOLATING")))
    else:
        joined = targets.join(judged.select("issue_id", "outcome", good.alias("good")), "issue_id", "left")
    outcomes = cut(joined.select(
        "result_id", c(repair.target).alias("target_id"), "event_id", F.coalesce("refusal", "outcome").alias("outcome"),
        (c("refusal").isNull() & F.coalesce(c("good"), F.lit(False))).alias("succeeded")))

    again = recheck(after, repair.check, outcomes.filter("succeeded"), {"checked_at": now} if repair.timed else None)
    judged_results = recovery.recovery_status(outcomes, again)
    statuses = mine.select("result_id").join(judged_results, "result_id", "left").select(
        "result_id", F.coalesce("recovery_status", F.lit(NOT_APPLICABLE)).alias("recovery_status"),
        F.coalesce("outcomes", F.lit(0)).cast("long").alias("outcomes"), F.coalesce("recovered", F.lit(0)).cast("long").alias("recovered"))
    return Recovery(statuses, outcomes, proposal, after)
