"""Running audits: a registry of rules, isolated execution, result rows and stored violations."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroll.constants import ORPHAN_THRESHOLD_MINUTES
from tallyroll.functions.times import seconds, ts
from tallyroll.operators import checks as rules
from tallyroll.plans.scope import ALL, AS_OF_RANGE, EVENT, Scope
from tallyroll.schemas import STORED_VIOLATION, VIOLATION
from tallyroll.sources.ledger import Tables


@dataclass(frozen=True)
class Check:
    """One audit rule. ``errors`` lists campaigns the rule refuses to judge, with an ``outcome`` column."""

    name: str
    label: str
    target_type: str
    target_column: str
    scopes: tuple[str, ...]
    fn: Callable[..., DataFrame]
    errors: Callable[..., DataFrame] | None = None


CHECKS: dict[str, Check] = {}


def register_check(
    name: str, label: str, target_type: str, target_column: str, scopes: Iterable[str],
    fn: Callable[..., DataFrame], errors: Callable[..., DataFrame] | None = None,
) -> Check:
    """Add a rule; a name may be used once."""
    if name in CHECKS:
        raise ValueError(f"check {name!r} is already registered")
    CHECKS[name] = Check(name, label, target_type, target_column, tuple(scopes), fn, errors)
    return CHECKS[name]


register_check("stock", "stock counters", "EVENT", "event_id", (EVENT, ALL), rules.stock)
register_check("loss", "accepted but not stored", "EVENT", "event_id", (EVENT,), rules.loss, rules.loss_errors)
register_check("state_chain", "status chain continuity", "ISSUE", "issue_id", (EVENT, AS_OF_RANGE, ALL), rules.state_chain)
register_check("issue_structure", "issue row structure", "ISSUE", "issue_id", (EVENT, ALL), rules.issue_structure)
register_check("history_structure", "history row structure", "HISTORY", "history_id", (EVENT, AS_OF_RANGE, ALL), rules.history_structure)
register_check("issue_history_state", "issue against latest history", "ISSUE", "issue_id", (EVENT, ALL), rules.issue_history_state)
register_check("time_sync", "issue and history times", "ISSUE", "issue_id", (EVENT, AS_OF_RANGE, ALL), rules.time_sync)
register_check("expiration_lag", "late expiry", "ISSUE", "issue_id", (EVENT, AS_OF_RANGE, ALL), rules.expiration_lag)


def catalog(spark: SparkSession, scope_type: str | None = None) -> DataFrame:
    """Registered rules, optionally those that support one scope type."""
    rows = [
        (c.name, c.label, c.target_type, s)
        for c in CHECKS.values() for s in c.scopes if scope_type in (None, s)
    ]
    return spark.createDataFrame(rows, "check_name string, label string, target_type string, scope_type string")


def select_checks(names: list[str] | None, scope_type: str) -> list[Check]:
    """Rules by name; none given means every rule that supports the scope."""
    if not names:
        return [c for c in CHECKS.values() if scope_type in c.scopes]
    if len(set(names)) != len(names):
        raise ValueError("a check is named twice")
    unknown = [n for n in names if n not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks: {unknown}")
    refused = [n for n in names if scope_type not in CHECKS[n].scopes]
    if refused:
        raise ValueError(f"checks without {scope_type} scope: {refused}")
    return [CHECKS[n] for n in names]


def as_violations(df: DataFrame, check: Check) -> DataFrame:
    """Uniform violation rows: everything but the key columns goes into a JSON detail."""
    keys = {"event_id", "violation_type"}
    detail = [c for c in df.columns if c not in keys]
    event = F.col("event_id") if "event_id" in df.columns else F.lit(None)
    return df.select(
        F.lit(check.name).alias("check_name"),
        F.lit(check.target_type).alias("target_type"),
        F.col(check.target_column).cast("long").alias("target_id"),
        event.cast("long").alias("event_id"),
        "violation_type",
        F.to_json(F.struct(*detail)).alias("detail") if detail else F.lit("{}").alias("detail"),
    )


# Rules that read the same newest history rows and can share one pass.
LATEST_ROW_RULES = ("issue_history_state", "time_sync")


def _shared_pass(chosen: list[Check], scope: Scope) -> list[Check]:
    """The rules of ``chosen`` to run in one pass, or none."""
    both = [c for c in chosen if c.name in LATEST_ROW_RULES and c is CHECKS.get(c.name)]
    campaigns = scope.kind == EVENT or scope.event_set is not None
    return both if len(both) == 2 and campaigns else []


def _shared_violations(tables: Tables, scope: Scope, params: dict[str, dict] | None) -> DataFrame:
    rows = rules.latest_row_rules(tables, scope, **(params or {}).get("time_sync", {}))
    return rows.select(
        "check_name", F.lit("ISSUE").alias("target_type"), F.col("issue_id").cast("long").alias("target_id"),
        F.col("event_id").cast("long").alias("event_id"), "violation_type", "detail",
    )


def _require_event(tables: Tables, scope: Scope) -> None:
    if scope.kind == EVENT and scope.event_set is None and tables.event.filter(F.col("event_id") == scope.event_id).isEmpty():
        raise ValueError(f"campaign {scope.event_id} does not exist")


def summarize(
    spark: SparkSession, violations: DataFrame, names: Iterable[str], scope: Scope, trigger: str,
    executed_at: datetime, errors: dict[str, str] | None = None, refused: DataFrame | None = None,
) -> DataFrame:
    """One result row per rule, PASS rows included.

    ``errors`` holds rules that failed to run, ``refused`` (check_name, error_message) rules that declined.
    """
    errors = errors or {}
    listed = spark.createDataFrame(
        [(n, errors.get(n)) for n in names], "check_name string, run_error string"
    )
    counted = violations.groupBy("check_name").agg(F.count(F.lit(1)).alias("n"))
    out = listed.join(counted, "check_name", "left")
    if refused is not None:
        out = out.join(refused, "check_name", "left")
    else:
        out = out.withColumn("error_message", F.lit(None).cast("string"))
    n = F.coalesce(F.col("n"), F.lit(0))
    message = F.coalesce(F.col("run_error"), F.col("error_message"))
    return out.select(
        "check_name",
        F.lit(trigger).alias("trigger_type"),
        F.lit(scope.kind).alias("scope_type"),
        F.lit(scope.event_id).cast("long").alias("event_id"),
        (ts(scope.start) if scope.start else F.lit(None).cast("timestamp_ntz")).alias("scope_from"),
        (ts(scope.end) if scope.end else F.lit(None).cast("timestamp_ntz")).alias("scope_to"),
        F.when(message.isNotNull(), "ERROR").when(n > 0, "FAIL").otherwise("PASS").alias("status"),
        F.when(message.isNotNull(), F.lit(0)).otherwise(n).cast("long").alias("violation_count"),
        F.to_json(F.create_map(F.lit("violationCount"), n.cast("string"))).alias("diff_detail"),
        message.alias("error_message"),
        ts(executed_at).alias("executed_at"),
        F.when(message.isNotNull() | (n > 0), "NOT_RECOVERED").otherwise("NOT_REQUIRED").alias("recovery_status"),
    )


def _refusals(check: Check, tables: Tables, scope: Scope) -> DataFrame:
    return check.errors(tables, scope).groupBy(F.lit(check.name).alias("check_name")).agg(
        F.min("outcome").alias("error_message")
    )


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VIOLATION)


def run_checks(
    spark: SparkSession, tables: Tables, scope: Scope, executed_at: datetime, names: list[str] | None = None,
    trigger: str = "MANUAL", params: dict[str, dict] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results and violations as lazy frames. A rule that cannot be built becomes an ERROR row."""
    _require_event(tables, scope)
    frames, errors, refused = [], {}, []
    chosen = select_checks(names, scope.kind)
    shared = _shared_pass(chosen, scope)
    if shared:
        try:
            frames.append(_shared_violations(tables, scope, params))
        except Exception:  # let each rule report for itself
            shared = []
    for check in [c for c in chosen if c not in shared]:
        try:
            frames.append(as_violations(check.fn(tables, scope, **(params or {}).get(check.name, {})), check))
            if check.errors:
                refused.append(_refusals(check, tables, scope))
        except Exception as failure:  # one rule must not stop the others
            errors[check.name] = str(failure)
    violations = reduce(DataFrame.unionByName, frames) if frames else _empty(spark)
    results = summarize(
        spark, violations, [c.name for c in chosen], scope, trigger, executed_at, errors,
        reduce(DataFrame.unionByName, refused) if refused else None,
    )
    return results, violations


def run_name(scope: Scope, executed_at: datetime, trigger: str, names: list[str]) -> str:
    """The id of an audit run: the same audit at the same time has the same one.

    The campaigns of a narrowed scope are not part of it; name such a run yourself where several could meet.
    """
    parts = (scope.kind, scope.event_id, scope.start, scope.end, scope.event_set is not None, executed_at.isoformat(), trigger, *names)
    return uuid.uuid3(uuid.NAMESPACE_OID, "|".join(map(str, parts))).hex


def number_of(*parts: Column) -> Column:
    """A positive number of 60 bits made of some values: the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def run_and_store(
    spark: SparkSession, tables: Tables, scope: Scope, executed_at: datetime, folder: str,
    names: list[str] | None = None, trigger: str = "MANUAL", params: dict[str, dict] | None = None,
    run_id: str | None = None, clock: Callable[[], float] = time.monotonic,
) -> tuple[DataFrame, DataFrame]:
    """Run each rule as its own job, write its violations, and count what was written.

    A rule that fails while running becomes an ERROR row and the others go on. Nothing
    passes through the driver; results are counted from the stored rows.

    Results have an id made of run and rule and the milliseconds their job took; violations have their result's id and one of
    their own. Everything is written below a new attempt of the run, and the run counts once its row in ``runs``
    names that attempt: a repeated run replaces itself, and readers (:func:`stored_results`, :func:`stored_violations`) see
    whole runs only.
    """
    _require_event(tables, scope)
    chosen = select_checks(names, scope.kind)
    run_id = run_id or run_name(scope, executed_at, trigger, [c.name for c in chosen])
    attempt = uuid.uuid4().hex
    inside = f"run_id={run_id}/attempt={attempt}"
    errors, refused, written, took = {}, [], [], {}

    def store(build: Callable[[], DataFrame], part: str, names: list[str]) -> None:
        started = clock()
        rows = build()
        result = number_of(F.lit(run_id), F.col("check_name"))
        rows.withColumn("result_id", result).withColumn(
            "violation_id", number_of(result.cast("string"), "target_type", F.col("target_id").cast("string"), "violation_type", "detail")
        ).write.parquet(f"{folder}/violations/{inside}/part={part}")
        written.append(f"{folder}/violations/{inside}/part={part}")
        took.update(dict.fromkeys(names, int((clock() - started) * 1000)))

    shared = _shared_pass(chosen, scope)
    if shared:
        try:
            store(lambda: _shared_violations(tables, scope, params), "latest_row_rules", [c.name for c in shared])
        except Exception:  # let each rule report for itself
            shared = []
    for check in [c for c in chosen if c not in shared]:
        try:
            store(lambda: as_violations(check.fn(tables, scope, **(params or {}).get(check.name, {})), check), check.name, [check.name])
            if check.errors:
                refused.append(_refusals(check, tables, scope))
        except Exception as failure:
            errors[check.name] = str(failure)
    violations = spark.read.schema(STORED_VIOLATION).parquet(*written) if written else spark.createDataFrame([], STORED_VIOLATION)
    times = spark.createDataFrame([(c.name, took.get(c.name, 0)) for c in chosen], "check_name string, duration_millis long")
    results = summarize(
        spark, violations, [c.name for c in chosen], scope, trigger, executed_at, errors,
        reduce(DataFrame.unionByName, refused) if refused else None,
    ).join(F.broadcast(times), "check_name").withColumn("result_id", number_of(F.lit(run_id), F.col("check_name")))
    results.write.parquet(f"{folder}/results/{inside}")
    spark.range(1).select(F.lit(attempt).alias("attempt"), ts(executed_at).alias("executed_at")).write.mode("overwrite").parquet(f"{folder}/runs/run_id={run_id}")
    return results.withColumn("run_id", F.lit(run_id)), violations


def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, attempt, executed_at of the runs that have been finished."""
    schema = "attempt string, executed_at timestamp_ntz, run_id string"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/runs").select("run_id", "attempt", "executed_at")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run_id string, attempt string, executed_at timestamp_ntz")


def _of_runs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    runs = stored_runs(spark, folder).select("run_id", "attempt")
    return spark.read.parquet(f"{folder}/{name}").join(runs, ["run_id", "attempt"], "left_semi").drop("attempt", "part")


def stored_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows of finished runs."""
    return _of_runs(spark, folder, "results")


def stored_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of finished runs, with their result's id."""
    return _of_runs(spark, folder, "violations")


def recheck(tables: Tables, name: str, events: DataFrame, params: dict | None = None) -> DataFrame:
    """Does each campaign pass the rule now? Runs the EVENT rule over all of them at once."""
    check = CHECKS[name]
    if EVENT not in check.scopes:
        raise ValueError(f"check {name!r} has no EVENT scope")
    wanted = events.select("event_id").distinct()
    bad = check.fn(tables, Scope.events(wanted), **(params or {})).select("event_id").distinct().withColumn("_bad", F.lit(True))
    return wanted.join(bad, "event_id", "left").select("event_id", F.col("_bad").isNull().alias("passed"))


def link_violations(violations: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach violations to their result by (run_id, check_name).

    The second frame lists results whose linked rows differ from their recorded count.
    """
    keys = ["run_id", "check_name"]
    linked = violations.join(results.select(*keys, "result_id"), keys)
    counted = linked.groupBy("result_id").agg(F.count(F.lit(1)).alias("linked"))
    mismatch = (
        results.select("result_id", "violation_count").join(counted, "result_id", "left")
        .withColumn("linked", F.coalesce(F.col("linked"), F.lit(0)))
        .filter(F.col("linked") != F.col("violation_count"))
    )
    return linked, mismatch


def orphan_violations(
    violations: DataFrame, runs: DataFrame, now: datetime, threshold_minutes: int = ORPHAN_THRESHOLD_MINUTES
) -> DataFrame:
    """Violations without a result whose run has not been touched since the threshold.

    ``runs``: run_id, check_name, last_updated.
    """
    alive = runs.filter(F.col("last_updated") >= ts(now) - seconds(threshold_minutes * 60))
    return violations.filter(F.col("result_id").isNull()).join(
        alive.select("run_id", "check_name"), ["run_id", "check_name"], "left_anti"
    )
