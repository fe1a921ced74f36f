"""Snapshots, tracked issues, ratings, quality gates and baselines of accepted findings, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.numeric import up_to

#: Metrics of which less is better (fixed values).
LOWER_IS_BETTER = ("duplication_percentage", "cyclomatic_complexity", "technical_debt_hours", "critical_vulnerabilities", "high_vulnerabilities", "naming_violations")
CLOSED = ("resolved", "closed", "false_positive", "wont_fix")
NEAR_LINES = 5
DEBT = ((5.0, "A"), (10.0, "B"), (20.0, "C"), (50.0, "D"))
SEVERITY = ("info", "low", "medium", "high", "critical")
LETTERS = ("A", "B", "C", "D", "E")


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows replace stored ones of the same key; of several fresh rows of a key the last by scan_timestamp counts."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_new"), F.desc("scan_timestamp")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_new", "_rank")


def list_snapshots(snapshots: DataFrame, project: str, limit: int = 100) -> DataFrame:
    """R2: the latest snapshots of a project."""
    return snapshots.where(F.col("project_path") == project).orderBy(F.desc("scan_timestamp"), "id").limit(limit)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each project."""
    rest = [c for c in snapshots.columns if c not in ("project_path", "scan_timestamp")]
    return snapshots.groupBy("project_path").agg(F.max(F.struct("scan_timestamp", *rest)).alias("_x")).select("project_path", "_x.*")


def metric_trends(metrics: DataFrame, limit: int = 100, steady: float = 5.0) -> DataFrame:
    """project_path, scan_timestamp, metric_name, value -> the last value of each metric against the one before, over each project's last snapshots."""
    recent = F.dense_rank().over(W.partitionBy("project_path").orderBy(F.desc("scan_timestamp"))) <= limit
    order = W.partitionBy("project_path", "metric_name").orderBy(F.desc("scan_timestamp"))
    rows = metrics.withColumn("_recent", recent).where("_recent").withColumn("_rank", F.row_number().over(order)).withColumn("previous_value", F.lead("value").over(order))
    made = rows.where("_rank = 1 and previous_value is not null").select("project_path", "metric_name", F.col("value").alias("current_value"), "previous_value")
    made = made.withColumn("change", F.col("current_value") - F.col("previous_value")).withColumn("change_percentage", F.when(F.col("previous_value") == 0, 0.0).otherwise(F.col("change") / F.abs("previous_value") * 100))
    good = F.when(F.col("metric_name").isin(*LOWER_IS_BETTER), F.col("change_percentage") < 0).otherwise(F.col("change_percentage") > 0)
    return made.withColumn("direction", F.when(F.abs("change_percentage") < steady, "stable").when(good, "improving").otherwise("degrading"))


def match_findings(issues: DataFrame, findings: DataFrame) -> DataFrame:
    """finding_id, issue_id: for each finding the first issue (least issue_id) of its project, rule and file that is not closed and at most five lines away.

    The line is put in buckets of the reach, so the join is on equality, with the exact distance as a residual.
    """
    bucket = lambda c: F.floor(F.col(c) / (NEAR_LINES + 1))
    open_ = issues.where(~F.col("status").isin(*CLOSED)).select("project_path", "rule_id", "file_path", "issue_id", F.col("line_number").alias("_line"), bucket("line_number").alias("_b"))
    b = bucket("line_number")
    near = findings.select("finding_id", "project_path", "rule_id", "file_path", "line_number", F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    met = near.join(open_, ["project_path", "rule_id", "file_path", "_b"]).where(F.abs(F.col("line_number") - F.col("_line")) <= NEAR_LINES)
    return met.groupBy("finding_id").agg(F.min("issue_id").alias("issue_id"))


def upsert_issues(issues: DataFrame, findings: DataFrame, now: str) -> DataFrame:
    """Matched issues are seen again, other findings become issues (issue_id is their finding_id)."""
    matched = match_findings(issues, findings)
    seen = matched.groupBy("issue_id").agg(F.count("*").alias("_n"))
    at = F.lit(now).cast("timestamp_ntz")
    old = issues.join(seen, "issue_id", "left").withColumn("last_seen", F.when(F.col("_n").isNotNull(), at).otherwise(F.col("last_seen"))).withColumn("scan_count", F.col("scan_count") + F.coalesce("_n", F.lit(0))).drop("_n")
    new = findings.join(matched, "finding_id", "left_anti").withColumnRenamed("finding_id", "issue_id")
    new = new.withColumn("status", F.lit("open")).withColumn("first_detected", at).withColumn("last_seen", at).withColumn("scan_count", F.lit(1).cast("long"))
    return old.unionByName(new, allowMissingColumns=True)


def mark_resolved(issues: DataFrame, project: str, scan_start: str, now: str) -> DataFrame:
    """R7."""
    gone = (F.col("project_path") == project) & F.col("status").isin("open", "confirmed") & (F.col("last_seen") < F.lit(scan_start).cast("timestamp_ntz"))
    return issues.withColumn("_gone", gone).withColumn("status", F.when(F.col("_gone"), "resolved").otherwise(F.col("status"))).withColumn("resolved_at", F.when(F.col("_gone"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("resolved_at"))).drop("_gone")


def apply_changes(issues: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Changes has issue_id, new_status, reason, assignee, comment (each may be null); one row an issue."""
    c = issues.join(changes, "issue_id", "left")
    at = F.lit(now).cast("timestamp_ntz")
    return (
        c.withColumn("resolved_at", F.when(F.col("new_status").isin("resolved", "closed"), at).otherwise(F.col("resolved_at")))
        .withColumn("false_positive_reason", F.when(F.col("new_status") == "false_positive", F.col("reason")).otherwise(F.col("false_positive_reason")))
        .withColumn("status", F.coalesce("new_status", "status")).withColumn("assigned_to", F.coalesce("assignee", "assigned_to"))
        .withColumn("comments", F.when(F.col("comment").isNotNull(), F.array_append(F.coalesce("comments", F.array().cast("array<string>")), F.col("comment"))).otherwise(F.col("comments")))
        .drop("new_status", "reason", "assignee", "comment")
    )


def query_issues(issues: DataFrame, project: str, status: list[str] | None = None, severity: list[str] | None = None, issue_type: list[str] | None = None, path_contains: str | None = None, assigned_to: str | None = None, rule_id: str | None = None) -> DataFrame:
    """The conjunction of the conditions given, newest first."""
    made = issues.where(F.col("project_path") == project)
    for column, values in (("status", status), ("severity", severity), ("issue_type", issue_type)):
        made = made.where(F.col(column).isin(*values)) if values else made
    made = made.where(F.lower("file_path").contains(path_contains.lower())) if path_contains else made
    for column, value in (("assigned_to", assigned_to), ("rule_id", rule_id)):
        made = made.where(F.col(column) == value) if value else made
    return made.orderBy(F.desc("first_detected"), "issue_id")


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts by status of each project, open and confirmed ones by severity, and the oldest that is open."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    live = F.col("status").isin("open", "confirmed")
    return issues.groupBy("project_path").agg(
        n("open").alias("total_open"), n("confirmed").alias("total_confirmed"), n("false_positive").alias("total_false_positives"), n("wont_fix").alias("total_wont_fix"), n("resolved", "closed").alias("total_resolved"),
        *(F.count_if(live & (F.col("severity") == s)).alias(f"open_{s}") for s in SEVERITY), F.min(F.when(F.col("status") == "open", F.col("first_detected"))).alias("oldest_open_issue"),
    )


def debt_rating(ratio: Column) -> Column:
    return up_to(ratio, list(DEBT), "E")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(severity) == s, F.lit(k + 1)) for k, s in enumerate(SEVERITY)), F.lit(0))


def letter(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LETTERS)), rank)


def ratings(findings: DataFrame, size: DataFrame, key: str) -> DataFrame:
    """Maintainability from debt hours over lines / 100, reliability and security from the worst severity, overall the worst letter.

    findings: key, dimension (reliability or security), severity, debt_hours. size: key, lines_of_code.
    """
    worst = lambda d: F.coalesce(F.max(F.when(F.col("dimension") == d, severity_rank(F.col("severity")))), F.lit(0))
    sums = findings.groupBy(key).agg(F.sum("debt_hours").alias("_debt"), worst("reliability").alias("_r"), worst("security").alias("_s"))
    made = size.join(sums, key, "left").withColumn("debt_ratio", 100 * F.coalesce("_debt", F.lit(0.0)) / F.greatest(F.col("lines_of_code") / 100, F.lit(1.0)))
    rank = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    made = made.withColumn("maintainability", debt_rating(F.col("debt_ratio"))).withColumn("reliability", letter(rank("_r"))).withColumn("security", letter(rank("_s")))
    return made.withColumn("overall", F.greatest("maintainability", "reliability", "security")).drop("_debt", "_r", "_s")


def compare(op: Column, actual: Column, wanted: Column) -> Column:
    """Both sides as ranks, if they are letters, else as numbers."""
    value = lambda c: F.coalesce(F.try_element_at(F.create_map(*(x for k, v in enumerate(LETTERS) for x in (F.lit(v), F.lit(float(k + 1))))), F.upper(c)), c.try_cast("double"))
    a, w = value(actual), value(wanted)
    return F.when(op == "lt", a < w).when(op == "le", a <= w).when(op == "gt", a > w).when(op == "ge", a >= w).when(op == "eq", a == w).when(op == "ne", a != w)


def quality_gate(conditions: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Conditions (metric, op, threshold, error_on_fail) on each key's metrics (key, metric, value as text). A missing metric passes."""
    keys = metrics.select(key).distinct()
    each = keys.join(F.broadcast(conditions)).join(metrics, [key, "metric"], "left")  # a gate is a short list of conditions
    passed = F.coalesce(compare(F.col("op"), F.col("value"), F.col("threshold")), F.lit(True))
    made = each.withColumn("_p", passed).groupBy(key).agg(F.count("*").alias("conditions"), F.count_if(~F.col("_p") & F.col("error_on_fail")).alias("failed"), F.count_if(~F.col("_p") & ~F.col("error_on_fail")).alias("warned"))
    return made.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("warned") > 0, "warning").otherwise("passed"))


def new_violations(violations: DataFrame, baseline: DataFrame, now: str) -> DataFrame:
    """Violations that no entry of the baseline covers that has not expired: same file, line and type, or same file, type and message."""
    live = baseline.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    left = violations.join(live.select("file_path", "line_number", "violation_type").distinct(), ["file_path", "line_number", "violation_type"], "left_anti")
    return left.join(live.select("file_path", "violation_type", "message").distinct(), ["file_path", "violation_type", "message"], "left_anti")


def extend_baseline(baseline: DataFrame, violations: DataFrame, now: str) -> DataFrame:
    """The baseline with all violations that it did not cover."""
    return baseline.unionByName(new_violations(violations, baseline, now).withColumn("expires_at", F.lit(None).cast("timestamp_ntz")).select(*baseline.columns))


def baseline_stats(baseline: DataFrame, now: str) -> DataFrame:
    """Counts by type, by file and over all (grouping sets), expired and active."""
    old = F.coalesce(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz"), F.lit(False))
    made = baseline.cube("violation_type", "file_path").agg(F.grouping_id().alias("_g"), F.count("*").alias("entries"), F.count_if(old).alias("expired"), F.count_if(~old).alias("active"))
    return made.where("_g > 0").drop("_g")


def dashboard(issues: DataFrame, snapshots: DataFrame, project: str) -> dict[str, DataFrame]:
    """Summary, the 100 newest issues and the 20 newest snapshots of a project."""
    return {"summary": issue_summary(issues.where(F.col("project_path") == project)), "recent_issues": query_issues(issues, project).limit(100), "recent_snapshots": list_snapshots(snapshots, project, 20)}
