"""Queries of issues, gates, texts, schemas and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import clones
from quarrylens.operators import history as h
from quarrylens.operators import schema as sc
from quarrylens.operators import text as tx
from quarrylens.operators import web
from quarrylens.plans.common import rounded, rounded_sql, t

NOW = "2024-02-01 00:00:00"

# Snapshots: each day and user class of events is a scan of a project, event types are its metrics.


def _metrics(s, d):
    e = t(s, d, "events")
    name = F.when(F.col("event_type") == "error", "high_vulnerabilities").when(F.col("event_type") == "click", "technical_debt_hours").otherwise(F.col("event_type"))
    return e.groupBy(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project_path"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("scan_timestamp"), name.alias("metric_name")).agg(F.avg("value").alias("value"))


METRICS = """(SELECT 'p' || (user_id % 7) AS project_path, date_trunc('day', ts)::TIMESTAMP AS scan_timestamp, CASE event_type WHEN 'error' THEN 'high_vulnerabilities' WHEN 'click' THEN 'technical_debt_hours' ELSE event_type END AS metric_name, avg(value) AS value FROM events GROUP BY 1, 2, 3)"""
R04 = f"""SELECT project_path, metric_name, current_value, previous_value, change, change_percentage, CASE WHEN abs(change_percentage) < 5 THEN 'stable' WHEN (metric_name IN ('high_vulnerabilities', 'technical_debt_hours')) = (change_percentage < 0) THEN 'improving' ELSE 'degrading' END AS direction FROM (
  SELECT *, CASE WHEN previous_value = 0 THEN 0.0 ELSE change / abs(previous_value) * 100 END AS change_percentage FROM (SELECT project_path, metric_name, value AS current_value, prev AS previous_value, value - prev AS change FROM (
  SELECT *, row_number() OVER w AS rn, lead(value) OVER w AS prev FROM {METRICS} WINDOW w AS (PARTITION BY project_path, metric_name ORDER BY scan_timestamp DESC)) WHERE rn = 1 AND prev IS NOT NULL))"""


def snapshots(s, d):
    return _metrics(s, d).groupBy("project_path", "scan_timestamp").agg(F.count("*").alias("n_metrics")).withColumn("id", F.concat_ws("@", "project_path", F.date_format("scan_timestamp", "yyyyMMdd")))


SNAPS = f"(SELECT project_path, scan_timestamp, count(*) AS n_metrics, project_path || '@' || strftime(scan_timestamp, '%Y%m%d') AS id FROM {METRICS} GROUP BY 1, 2)"

# Issues and findings: orders, by customer and priority.


def _issues(s, d):
    """The stored issues, to which the findings of later orders come."""
    return tracked(s, d).where(F.col("first_detected") < F.lit("1996-01-01").cast("timestamp_ntz"))


def tracked(s, d):
    o = t(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "confirmed").otherwise("resolved")
    return o.select(F.col("o_orderkey").alias("issue_id"), F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("project_path"), F.substring("o_orderpriority", 1, 1).alias("rule_id"), F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("file_path"), (F.col("o_orderkey") % 500).alias("line_number"), status.alias("status"),
        F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity"), F.col("o_orderstatus").alias("issue_type"), F.col("o_orderdate").alias("first_detected"), F.col("o_orderdate").alias("last_seen"), F.lit(1).cast("long").alias("scan_count"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))


def _findings(s, d):
    o = t(s, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return o.select(F.col("o_orderkey").alias("finding_id"), F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("project_path"), F.substring("o_orderpriority", 1, 1).alias("rule_id"), F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("file_path"), (F.col("o_orderkey") % 500).alias("line_number"))


TRACKED = """(SELECT o_orderkey AS issue_id, 'p' || (o_custkey % 5) AS project_path, o_orderpriority[1] AS rule_id, 'f' || (o_custkey % 40) AS file_path, o_orderkey % 500 AS line_number, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'confirmed' ELSE 'resolved' END AS status,
  ['critical', 'high', 'medium', 'low', 'info'][o_orderpriority[1]::INTEGER] AS severity, o_orderstatus AS issue_type, o_orderdate AS first_detected, o_orderdate AS last_seen, 1::BIGINT AS scan_count FROM orders)"""
ISSUES = f"(SELECT * FROM {TRACKED} WHERE first_detected < TIMESTAMP '1996-01-01')"
FINDINGS = "(SELECT o_orderkey AS finding_id, 'p' || (o_custkey % 5) AS project_path, o_orderpriority[1] AS rule_id, 'f' || (o_custkey % 40) AS file_path, o_orderkey % 500 AS line_number FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')"
MATCHED = f"(SELECT finding_id, min(issue_id) AS issue_id FROM {FINDINGS} f JOIN {ISSUES} i USING (project_path, rule_id, file_path) WHERE i.status NOT IN ('resolved', 'closed') AND abs(f.line_number - i.line_number) <= 5 GROUP BY 1)"


def r06(s, d):
    made = h.upsert_issues(_issues(s, d), _findings(s, d), NOW)
    return made.groupBy("project_path", "status").agg(F.count("*").alias("issues"), F.sum("scan_count").alias("scans"), F.count_if(F.col("last_seen") == F.lit(NOW).cast("timestamp_ntz")).alias("seen_now"))


def r07(s, d):
    return h.mark_resolved(tracked(s, d), "p1", "1995-01-01 00:00:00", NOW).groupBy("project_path", "status").agg(F.count("*").alias("issues"), F.count("resolved_at").alias("resolved"))


def r08(s, d):
    issues = tracked(s, d).withColumns({"false_positive_reason": F.lit(None).cast("string"), "assigned_to": F.lit(None).cast("string"), "comments": F.array().cast("array<string>")})
    changes = tracked(s, d).where("issue_id % 3 = 0").select("issue_id", F.when(F.col("issue_id") % 2 == 0, "false_positive").otherwise("closed").alias("new_status"), F.lit("seen").alias("reason"), F.when(F.col("issue_id") % 5 == 0, "ann").alias("assignee"), F.when(F.col("issue_id") % 7 == 0, "hm").alias("comment"))
    return h.apply_changes(issues, changes, NOW).groupBy("status", "assigned_to", "false_positive_reason").agg(F.count("*").alias("issues"), F.count("resolved_at").alias("resolved"), F.sum(F.size("comments")).alias("comments"))


def r11(s, d):
    li = t(s, d, "lineitem")
    found = li.select((F.col("l_suppkey") % 20).alias("project"), F.when(F.col("l_returnflag") == "R", "security").otherwise("reliability").alias("dimension"), F.when(F.col("l_quantity") > 49.5, "high").when(F.col("l_quantity") > 40, "medium").otherwise("low").alias("severity"), (F.col("l_tax") / 10).alias("debt_hours"))
    size = t(s, d, "supplier").groupBy((F.col("s_suppkey") % 20).alias("project")).agg((F.sum("s_acctbal") * 10 + 90000).cast("long").alias("lines_of_code"))
    return rounded(h.ratings(found, size, "project"))


def r12(s, d):
    conditions = s.createDataFrame([("view", "le", "120", True), ("purchase", "gt", "100", False), ("rating", "le", "B", True), ("unknown", "eq", "1", True)], "metric string, op string, threshold string, error_on_fail boolean")
    m = _metrics(s, d).groupBy("project_path", F.col("metric_name").alias("metric")).agg(F.round(F.avg("value"), 3).cast("string").alias("value"))
    m = m.unionByName(m.select("project_path").distinct().withColumn("metric", F.lit("rating")).withColumn("value", F.when(F.col("project_path") == "p3", "D").otherwise("A")))
    return h.quality_gate(conditions, m, "project_path")


R12 = f"""WITH m AS (SELECT project_path, max(round(v, 3)) FILTER (WHERE metric_name = 'view') AS vw, max(round(v, 3)) FILTER (WHERE metric_name = 'purchase') AS pu FROM (SELECT project_path, metric_name, avg(value) AS v FROM {METRICS} GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT project_path, 4::BIGINT AS conditions, (NOT coalesce(vw <= 120, true))::INTEGER + (project_path = 'p3')::INTEGER AS failed, (NOT coalesce(pu > 100, true))::INTEGER AS warned FROM m)
SELECT project_path, conditions, failed::BIGINT AS failed, warned::BIGINT AS warned, CASE WHEN failed > 0 THEN 'failed' WHEN warned > 0 THEN 'warning' ELSE 'passed' END AS status FROM f"""


def _violations(s, d):
    return _findings(s, d).select(F.col("file_path"), F.col("line_number"), F.col("rule_id").alias("violation_type"), F.concat(F.lit("m"), F.col("finding_id") % 11).alias("message"))


def _baseline(issues):
    return issues.select("file_path", "line_number", F.col("rule_id").alias("violation_type"), F.concat(F.lit("m"), F.col("issue_id") % 11).alias("message"), F.when(F.col("issue_id") % 2 == 0, F.lit("2024-01-15").cast("timestamp_ntz")).alias("expires_at"))


VIOL = f"(SELECT file_path, line_number, rule_id AS violation_type, 'm' || (finding_id % 11) AS message FROM {FINDINGS})"
BASE = f"(SELECT file_path, line_number, rule_id AS violation_type, 'm' || (issue_id % 11) AS message, CASE WHEN issue_id % 2 = 0 THEN TIMESTAMP '2024-01-15' END AS expires_at FROM {ISSUES})"
NEW = f"(SELECT v.* FROM {VIOL} v WHERE NOT EXISTS (SELECT 1 FROM {BASE} b WHERE (b.expires_at IS NULL OR b.expires_at > TIMESTAMP '{NOW}') AND b.file_path = v.file_path AND b.violation_type = v.violation_type AND (b.line_number = v.line_number OR b.message = v.message)))"

RULES = [
    {"rule_id": "email", "pattern": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "severity": "medium", "cwe": "CWE-359"},
    {"rule_id": "secret", "pattern": r"token = \"[0-9a-f]+\"", "severity": "critical", "cwe": "CWE-798"},
    {"rule_id": "address", "pattern": r"\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\b", "severity": "low", "cwe": "CWE-200"},
    {"rule_id": "notice", "pattern": r"^(Licensed|Released) under ", "severity": "info", "cwe": "none"},
    {"rule_id": "reserved", "pattern": r"ights reserved[.]?$", "severity": "info", "cwe": "none"},
]
H02 = " UNION ALL ".join(f"""SELECT doc_id, line_number::INTEGER AS line_number, '{r["rule_id"]}' AS rule_id, '{r["severity"]}' AS severity, '{r["cwe"]}' AS cwe FROM ln WHERE regexp_matches(line, '{r["pattern"]}')""" for r in RULES)
LINES = "WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents) "
BLOCKS = "bl AS (SELECT doc_id, st AS start_line, b FROM (SELECT doc_id, st, l[st:st + 5] AS b FROM (SELECT doc_id, l, unnest(range(1, len(l) - 4, 3)) AS st FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE len(list_filter(b, lambda x: length(trim(x, ' ')) > 3 AND NOT starts_with(trim(x, ' '), '#'))) >= 3 AND len(b) = 6)"


def _blocks(s, d):
    return tx.blocks(t(s, d, "documents"), "doc_id")


def _mixed(s, d):
    """event_id, json: objects of all JSON types, nested, from the events."""
    e, i = t(s, d, "events"), F.col("event_id")
    tag = F.when(i % 5 == 0, F.lit("42")).otherwise(F.format_string('"%s"', (i % 4).cast("string")))
    kid = F.when(i % 6 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('{"n":'), (i % 9).cast("string"), F.lit("}")))
    text = F.concat(F.lit('{"id":'), i.cast("string"), F.lit(',"tag":'), tag, F.lit(',"half":'), (i % 8).cast("string"), F.lit('.5,"list":['), (i % 3).cast("string"), F.lit(',"x"],"kid":'), kid, F.when(i % 7 == 0, F.lit(',"note":null')).otherwise(F.lit("")), F.lit("}"))
    return e.select("event_id", text.alias("json"))


MIXED = """(SELECT event_id, ('{"id":' || event_id || ',"tag":' || CASE WHEN event_id % 5 = 0 THEN '42' ELSE '"' || (event_id % 4) || '"' END || ',"half":' || (event_id % 8) || '.5,"list":[' || (event_id % 3) || ',"x"],"kid":'
  || CASE WHEN event_id % 6 = 0 THEN '"none"' ELSE '{"n":' || (event_id % 9) || '}' END || CASE WHEN event_id % 7 = 0 THEN ',"note":null' ELSE '' END || '}')::JSON AS j FROM events)"""
KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END"
MIXED_SCHEMA = {
    "type": "object", "required": ["id", "note"], "maxProperties": 5,
    "properties": {
        "id": {"type": "integer", "minimum": 10, "multipleOf": 2}, "tag": {"type": "string", "enum": ["0", "1", "2"]}, "half": {"type": "number", "exclusiveMaximum": 6},
        "list": {"items": {"type": ["integer", "string"], "maximum": 1}, "contains": {"const": 0}, "maxItems": 2}, "kid": {"type": "object", "properties": {"n": {"type": "integer", "maximum": 5}}, "additionalProperties": False},
    },
    "patternProperties": {"^no": {"type": "string"}}, "propertyNames": {"maxLength": 4},
}


def f05(s, d):
    return sc.validate(_mixed(s, d), MIXED_SCHEMA).drop("json")


F05 = f"""SELECT event_id, errors, errors = '' AS is_valid FROM (SELECT event_id, array_to_string(list_filter([
  CASE WHEN len(json_keys(j)) > 5 THEN '$:maxProperties' END,
  CASE WHEN NOT list_contains(json_keys(j), 'note') THEN '$:required.note' END,
  CASE WHEN (j->>'$.id')::BIGINT < 10 THEN '$.id:minimum' END, CASE WHEN (j->>'$.id')::BIGINT % 2 <> 0 THEN '$.id:multipleOf' END,
  CASE WHEN json_type(j->'$.tag') <> 'VARCHAR' THEN '$.tag:type' END, CASE WHEN (j->'$.tag')::VARCHAR NOT IN ('"0"', '"1"', '"2"') THEN '$.tag:enum' END,
  CASE WHEN (j->>'$.half')::DOUBLE >= 6 THEN '$.half:exclusiveMaximum' END,
  CASE WHEN (j->>'$.list[0]')::INT > 1 THEN '$.list[]:maximum' END, CASE WHEN (j->>'$.list[0]')::INT <> 0 THEN '$.list:contains' END,
  CASE WHEN json_type(j->'$.kid') <> 'OBJECT' THEN '$.kid:type' END, CASE WHEN (j->>'$.kid.n')::INT > 5 THEN '$.kid.n:maximum' END,
  CASE WHEN json_type(j->'$.note') = 'NULL' THEN '$./^no/:type' END], lambda x: x IS NOT NULL), ',') AS errors FROM {MIXED})"""
_PATHS = (("$", "$", "'$'"), ("$.id", "$.id", None), ("$.tag", "$.tag", None), ("$.half", "$.half", None), ("$.list", "$.list", None), ("$.list[]", "$.list[*]", None), ("$.kid", "$.kid", None), ("$.kid.n", "$.kid.n", None), ("$.note", "$.note", None))
F01 = (
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{path}' AS path, unnest({'json_extract(j, ' + repr([at]) + ')' if '*' not in at else 'json_extract(j, ' + repr(at) + ')'}) AS x FROM {MIXED}" for path, at, _ in _PATHS)
    + f"), k AS (SELECT path, x, {KIND.format('x')} AS kind FROM v WHERE x IS NOT NULL), objects AS (SELECT path AS parent, count(*) AS n FROM k WHERE kind = 'object' GROUP BY 1)"
    + """, a AS (SELECT path, count(*) AS presence_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, min(try_cast(x->>'$' AS DOUBLE)) FILTER (WHERE kind IN ('integer', 'number')) AS minimum, max(try_cast(x->>'$' AS DOUBLE)) FILTER (WHERE kind IN ('integer', 'number')) AS maximum,
  min(length(x->>'$')) FILTER (WHERE kind = 'string') AS min_length, max(length(x->>'$')) FILTER (WHERE kind = 'string') AS max_length, min(json_array_length(x)) FILTER (WHERE kind = 'array')::BIGINT AS min_items, max(json_array_length(x)) FILTER (WHERE kind = 'array')::BIGINT AS max_items,
  count(DISTINCT x::VARCHAR) FILTER (WHERE kind NOT IN ('object', 'array')) AS distinct_values FROM k GROUP BY 1)
SELECT a.*, CASE WHEN path LIKE '%[]' THEN false ELSE coalesce(presence_count = n, true) END AS required, distinct_values > 0 AND distinct_values <= 10 AS possible_enum FROM a LEFT JOIN objects ON parent = regexp_replace(path, '[.][a-z]+$', '') AND path <> '$'"""
)


def f10(s, d):
    """The catalogue of the tables against one in which columns were dropped, added and changed."""
    tables = ("orders", "lineitem", "customer", "events")
    rows = [(name, f.name, f.dataType.simpleString()) for name in tables for f in t(s, d, name).schema]
    old = s.createDataFrame(rows, "table_name string, column_name string, column_type string")
    new = old.where("column_name <> 'o_orderstatus'").withColumn("column_type", F.when(F.col("column_name") == "l_quantity", "decimal(10,2)").otherwise(F.col("column_type"))).unionByName(s.createDataFrame([("events", "source", "string")], old.schema))
    return sc.schema_diff(old, new)


def f16(s, d):
    return sc.mock_rows(s, {"type": "object", "properties": {"name": {"type": "string"}, "email": {"type": "string", "format": "email"}, "age": {"type": "integer", "minimum": 18, "maximum": 90}, "score": {"type": "number", "maximum": 1}, "active": {"type": "boolean"}, "plan": {"enum": ["free", "pro"]}, "at": {"type": "string", "format": "date-time"}}}, 1000)


def f08(s, d):
    """DDL of a table for each part, with quoted names, defaults that hold commas, comments and nested parentheses."""
    # A file of parts is small for its rows, and reading their texts costs time and not bytes, by which tasks would be dealt.
    p = t(s, d, "part").select("p_partkey", "p_size", "p_brand", "p_name").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    ddl = F.format_string(
        '''/* (, */ CREATE TABLE IF NOT EXISTS shop."part %d, (x)" (id BIGINT PRIMARY KEY, -- key, of
 "my, col" VARCHAR(%d) DEFAULT 'x, y); it''s' NOT NULL, `brand` CHAR(10) DEFAULT '%s not null', price DECIMAL(10, 2) CHECK (price IN (1, (2))), CONSTRAINT c CHECK (id > 0));
CREATE TEMPORARY TABLE "%s" ("a ""b""" INT NOT NULL, FOREIGN KEY ("a ""b""") REFERENCES x(id)); INSERT INTO t VALUES (1, ';')''',
        "p_partkey", "p_size", "p_brand", "p_name",
    )
    return sc.parse_ddl(p.select(ddl.alias("ddl")))


F08 = """SELECT x.* FROM (SELECT unnest([
  {'table_name': 'shop.part ' || p_partkey || ', (x)', 'position': 0, 'column_name': 'id', 'column_type': 'BIGINT', 'not_null': true}, {'table_name': 'shop.part ' || p_partkey || ', (x)', 'position': 1, 'column_name': 'my, col', 'column_type': 'VARCHAR(' || p_size || ')', 'not_null': true},
  {'table_name': 'shop.part ' || p_partkey || ', (x)', 'position': 2, 'column_name': 'brand', 'column_type': 'CHAR(10)', 'not_null': false}, {'table_name': 'shop.part ' || p_partkey || ', (x)', 'position': 3, 'column_name': 'price', 'column_type': 'DECIMAL(10, 2)', 'not_null': false},
  {'table_name': p_name, 'position': 0, 'column_name': 'a "b"', 'column_type': 'INT', 'not_null': true}]) AS x FROM part)"""


def _tags(s, d):
    return web.meta_tags(t(s, d, "pages"))


LINKS = r"""lk AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS tag, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')))) AS position FROM pages),
lh AS (SELECT page_id, page_url, position::INTEGER AS position, regexp_extract(tag, '(?i)\shref\s*=\s*["'']([^"'']*)["'']', 1) AS href, substr(trim(regexp_replace(regexp_replace(tag, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' '), 1, 100) AS text FROM lk WHERE regexp_matches(tag, '(?i)\shref\s*=\s*["'']'))"""
TYPED = LINKS + r""",
lt AS (SELECT *, regexp_extract(link_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS link_host FROM (SELECT *, CASE WHEN regexp_matches(lower(href), '^[a-z][a-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
  WHEN starts_with(href, '#') THEN regexp_replace(page_url, '#.*$', '') || href ELSE coalesce(nullif(regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)', 1), ''), regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/') || href END AS link_url FROM lh)),
ly AS (SELECT *, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(lower(href), 'mailto:') THEN 'mailto' WHEN starts_with(lower(href), 'tel:') THEN 'tel' WHEN starts_with(lower(href), 'javascript:') THEN 'javascript' WHEN link_host = regexp_extract(page_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) THEN 'internal' WHEN regexp_matches(lower(link_url), '^https?:') THEN 'external' ELSE 'other' END AS link_type FROM lt)"""


def x01(s, d):
    v = t(s, d, "embeddings").select("vec_id", "label", "embedding")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("model"))
    return rounded(v.join(F.broadcast(first), "label").select("vec_id", web.pearson(F.col("embedding"), F.col("model")).alias("similarity"), web.hash_distance(web.average_hash(F.col("embedding")), web.average_hash(F.col("model"))).alias("distance")), 5)


QUERIES = {
    "r01_upsert_snapshots": lambda s, d: h.upsert(snapshots(s, d), snapshots(s, d).where("project_path = 'p1'").withColumn("n_metrics", F.lit(0).cast("long")), "id"),
    "r02_list_snapshots": lambda s, d: h.list_snapshots(snapshots(s, d), "p2", 20),
    "r03_latest_snapshot": lambda s, d: h.latest_snapshot(snapshots(s, d)),
    "r04_metric_trend": lambda s, d: rounded(h.metric_trends(_metrics(s, d))),
    "r06_match_findings": lambda s, d: h.match_findings(_issues(s, d), _findings(s, d)),
    "r06_issue_upsert": r06, "r07_mark_resolved": r07, "r08_changes": r08,
    "r09_query": lambda s, d: h.query_issues(tracked(s, d), "p2", status=["open", "confirmed"], severity=["critical", "high"], path_contains="F1").select("issue_id", "file_path", "first_detected"),
    "r10_summary": lambda s, d: h.issue_summary(tracked(s, d)),
    "r11_ratings": r11, "r12_gate": r12,
    "r14_baseline_filter": lambda s, d: h.new_violations(_violations(s, d), _baseline(_issues(s, d)), NOW),
    "r15_baseline_extend": lambda s, d: h.extend_baseline(_baseline(_issues(s, d)), _violations(s, d), NOW).groupBy("file_path").agg(F.count("*").alias("entries")),
    "r16_baseline_stats": lambda s, d: h.baseline_stats(_baseline(tracked(s, d)), NOW),
    "h02_rule_scan": lambda s, d: tx.scan_rules(t(s, d, "documents"), "doc_id", RULES),
    "h04_literal_clones": lambda s, d: tx.literal_clones(_blocks(s, d), "doc_id"),
    "h04_clone_families": lambda s, d: tx.clone_families(_blocks(s, d), "doc_id"),
    "h05_near_clones": lambda s, d: rounded(clones.near_clones(_blocks(s, d), "doc_id")),
    "h06_blocks": lambda s, d: _blocks(s, d),
    "h07_duplication": lambda s, d: rounded(tx.duplication(t(s, d, "documents"), _blocks(s, d), "doc_id")),
    "f01_json_profile": lambda s, d: rounded(tx.json_profile(_mixed(s, d), "json")),
    "f02_formats": lambda s, d: t(s, d, "pages").select("page_id", tx.string_format(F.col("url")).alias("url_format"), tx.string_format(F.date_format(F.lit("2024-01-05").cast("date"), "yyyy-MM-dd")).alias("date_format")),
    "f03_common_pattern": lambda s, d: tx.common_pattern(t(s, d, "orders").withColumn("code", F.format_string("%s-%04d", F.substring("o_orderpriority", 1, 1), F.col("o_orderkey") % 10000)), ["o_orderstatus"], "code"),
    "f05_json_validate": f05, "f08_ddl": f08, "f10_schema_diff": f10, "f16_mock": f16,
    "w01_meta_tags": lambda s, d: _tags(s, d).select("page_id", "title", "canonical", "description", "viewport"),
    "w03_seo_score": lambda s, d: rounded(web.seo_score(web.meta_rules(_tags(s, d))).select("page_id", "title_valid", "description_valid", "issues", "seo_score")),
    "w04_links": lambda s, d: web.links(t(s, d, "pages"), "page_id").drop("base_url"),
    "w05_link_types": lambda s, d: web.link_types(web.links(t(s, d, "pages"), "page_id")).select("page_id", "position", "link_url", "link_host", "link_type"),
    "w06_filter_links": lambda s, d: web.filter_links(web.link_types(web.links(t(s, d, "pages"), "page_id")), "page_id", skip_patterns=("/the$",)).select("page_id", "link_url", "position"),
    "w07_link_report": lambda s, d: web.link_report(web.link_types(web.links(t(s, d, "pages"), "page_id")), "page_id"),
    "x01_pearson_vectors": x01,
}

ORACLES = {
    "x01_pearson_vectors": """SELECT vec_id, round(CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) ELSE 0.0 END, 5) + 0.0 AS similarity, (count(*) FILTER (WHERE i <= 64 AND (a > ma) <> (b > mb)))::INTEGER AS distance FROM (
      SELECT *, avg(a) OVER (PARTITION BY vec_id) AS ma, avg(b) OVER (PARTITION BY vec_id) AS mb FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(model)::DOUBLE AS b, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings JOIN (SELECT label, min_by(embedding, vec_id) AS model FROM embeddings GROUP BY 1) USING (label))) GROUP BY 1""",
    "r01_upsert_snapshots": f"SELECT project_path, scan_timestamp, CASE WHEN project_path = 'p1' THEN 0 ELSE n_metrics END AS n_metrics, id FROM {SNAPS}",
    "r02_list_snapshots": f"SELECT * FROM {SNAPS} WHERE project_path = 'p2' ORDER BY scan_timestamp DESC, id LIMIT 20",
    "r03_latest_snapshot": f"SELECT * FROM {SNAPS} QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY scan_timestamp DESC) = 1",
    "r04_metric_trend": rounded_sql(R04, "current_value", "previous_value", "change", "change_percentage"),
    "r06_match_findings": f"SELECT * FROM {MATCHED}",
    "r06_issue_upsert": f"""SELECT project_path, status, count(*) AS issues, sum(scans)::BIGINT AS scans, count(*) FILTER (WHERE now_seen) AS seen_now FROM (SELECT i.project_path, i.status, 1 + coalesce(n, 0) AS scans, n IS NOT NULL AS now_seen FROM {ISSUES} i LEFT JOIN (SELECT issue_id, count(*) AS n FROM {MATCHED} GROUP BY 1) USING (issue_id)
      UNION ALL SELECT project_path, 'open', 1, true FROM {FINDINGS} WHERE finding_id NOT IN (SELECT finding_id FROM {MATCHED})) GROUP BY 1, 2""",
    "r07_mark_resolved": f"SELECT project_path, CASE WHEN g THEN 'resolved' ELSE status END AS status, count(*) AS issues, count(*) FILTER (WHERE g) AS resolved FROM (SELECT *, project_path = 'p1' AND status IN ('open', 'confirmed') AND last_seen < TIMESTAMP '1995-01-01' AS g FROM {TRACKED}) GROUP BY 1, 2",
    "r08_changes": f"""SELECT status, assigned_to, false_positive_reason, count(*) AS issues, count(*) FILTER (WHERE closed) AS resolved, sum(c)::BIGINT AS comments FROM (SELECT CASE WHEN issue_id % 3 <> 0 THEN status WHEN issue_id % 2 = 0 THEN 'false_positive' ELSE 'closed' END AS status, CASE WHEN issue_id % 15 = 0 THEN 'ann' END AS assigned_to, CASE WHEN issue_id % 6 = 0 THEN 'seen' END AS false_positive_reason, issue_id % 3 = 0 AND issue_id % 2 <> 0 AS closed, (issue_id % 21 = 0)::INTEGER AS c FROM {TRACKED}) GROUP BY 1, 2, 3""",
    "r09_query": f"SELECT issue_id, file_path, first_detected FROM {TRACKED} WHERE project_path = 'p2' AND status IN ('open', 'confirmed') AND severity IN ('critical', 'high') AND file_path ILIKE '%F1%'",
    "r10_summary": f"""SELECT project_path, count(*) FILTER (WHERE status = 'open') AS total_open, count(*) FILTER (WHERE status = 'confirmed') AS total_confirmed, 0::BIGINT AS total_false_positives, 0::BIGINT AS total_wont_fix, count(*) FILTER (WHERE status = 'resolved') AS total_resolved,
      {", ".join(f"count(*) FILTER (WHERE status IN ('open', 'confirmed') AND severity = '{x}') AS open_{x}" for x in ("info", "low", "medium", "high", "critical"))}, min(first_detected) FILTER (WHERE status = 'open') AS oldest_open_issue FROM {TRACKED} GROUP BY 1""",
    "r11_ratings": rounded_sql("""SELECT project, lines_of_code, debt_ratio, m AS maintainability, r AS reliability, s AS security, greatest(m, r, s) AS overall FROM (SELECT *, CASE WHEN debt_ratio <= 5 THEN 'A' WHEN debt_ratio <= 10 THEN 'B' WHEN debt_ratio <= 20 THEN 'C' WHEN debt_ratio <= 50 THEN 'D' ELSE 'E' END AS m FROM (
      SELECT project, loc AS lines_of_code, 100 * coalesce(debt, 0.0) / greatest(loc / 100, 1.0) AS debt_ratio, coalesce(r, 'A') AS r, coalesce(s, 'A') AS s FROM (SELECT s_suppkey % 20 AS project, trunc(sum(s_acctbal) * 10 + 90000)::BIGINT AS loc FROM supplier GROUP BY 1) LEFT JOIN (SELECT l_suppkey % 20 AS project, sum(l_tax / 10) AS debt,
      max(CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_quantity > 49.5 THEN 'D' WHEN l_quantity > 40 THEN 'C' ELSE 'B' END END) AS r, max(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity > 49.5 THEN 'D' WHEN l_quantity > 40 THEN 'C' ELSE 'B' END END) AS s FROM lineitem GROUP BY 1) USING (project)))""", "debt_ratio"),
    "r12_gate": R12,
    "r14_baseline_filter": f"SELECT * FROM {NEW}",
    "r15_baseline_extend": f"SELECT file_path, count(*) AS entries FROM (SELECT file_path FROM {BASE} UNION ALL SELECT file_path FROM {NEW}) GROUP BY 1",
    "r16_baseline_stats": f"SELECT violation_type, file_path, count(*) AS entries, count(*) FILTER (WHERE expires_at IS NOT NULL) AS expired, count(*) FILTER (WHERE expires_at IS NULL) AS active FROM {BASE.replace(ISSUES, TRACKED)} GROUP BY GROUPING SETS ((), (violation_type), (file_path))",
    "h02_rule_scan": LINES + H02,
    "h04_literal_clones": "WITH " + BLOCKS + " SELECT md5(array_to_string(b, chr(10))) AS hash, count(*) AS blocks, count(DISTINCT doc_id) AS texts, min(doc_id) AS first FROM bl GROUP BY 1 HAVING count(*) >= 2",
    "h06_blocks": "WITH " + BLOCKS + " SELECT doc_id, start_line::INTEGER AS start_line, array_to_string(b, chr(10)) AS block FROM bl",
    "h07_duplication": rounded_sql("WITH " + BLOCKS + ", fa AS (SELECT count(*) AS n FROM bl GROUP BY array_to_string(b, chr(10)) HAVING count(*) >= 2) SELECT coalesce(sum(n), 0)::BIGINT AS clone_blocks, count(*) AS families, (SELECT sum(len(string_split(text, chr(10))))::BIGINT FROM documents) AS total_lines, least(100.0, 600.0 * coalesce(sum(n), 0) / (SELECT sum(len(string_split(text, chr(10)))) FROM documents)) AS duplication_percentage FROM fa", "duplication_percentage"),
    "f01_json_profile": rounded_sql(F01, "minimum", "maximum"),
    "f02_formats": "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'uri' END AS url_format, 'date' AS date_format FROM pages",
    "f03_common_pattern": r"SELECT o_orderstatus, count(*) AS samples, '^\d\-\d\d\d\d$' AS pattern FROM orders GROUP BY 1",
    "f05_json_validate": F05,
    "f08_ddl": F08,
    "f10_schema_diff": "SELECT * FROM (VALUES ('orders', 'o_orderstatus', 'string', NULL, 'dropped'), ('lineitem', 'l_quantity', 'double', 'decimal(10,2)', 'modified'), ('events', 'source', NULL, 'string', 'added')) v(table_name, column_name, old_type, new_type, change)",
    "w01_meta_tags": r"SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), ' ') END AS title, NULL::VARCHAR AS canonical, NULL::VARCHAR AS description, NULL::VARCHAR AS viewport FROM pages",
    "w03_seo_score": rounded_sql(r"""SELECT page_id, coalesce(length(title) BETWEEN 30 AND 60, false) AS title_valid, false AS description_valid, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title missing' WHEN length(title) < 30 THEN 'title short' WHEN length(title) > 60 THEN 'title long' END, 'description missing', 'canonical missing', 'viewport missing', 'og:title missing', 'og:description missing', 'og:image missing', 'og:url missing', 'og:type missing'], lambda x: x IS NOT NULL), ',') AS issues,
      greatest(0.0, 100.0 - CASE WHEN title IS NULL THEN 30 WHEN NOT length(title) BETWEEN 30 AND 60 THEN 15 ELSE 0 END - 25 - 5 - 10 - 20 - 10)::DOUBLE AS seo_score FROM (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), ' ') END AS title FROM pages)""", "seo_score"),
    "w04_links": "WITH " + LINKS + " SELECT * FROM lh",
    "w05_link_types": "WITH " + TYPED + " SELECT page_id, position, link_url, link_host, link_type FROM ly",
    "w06_filter_links": "WITH " + TYPED + " SELECT page_id, link_url, min(position) AS position FROM ly WHERE link_type NOT IN ('mailto', 'tel', 'javascript') AND NOT regexp_matches(link_url, '(?i)/the$') GROUP BY 1, 2",
    "w07_link_report": "WITH " + TYPED + " SELECT page_id, count(*) AS total_links, count(*) FILTER (WHERE link_type = 'internal') AS internal_links, count(*) FILTER (WHERE link_type = 'external') AS external_links, count(*) FILTER (WHERE link_type = 'anchor') AS anchor_links, count(DISTINCT link_host) FILTER (WHERE link_type = 'external') AS external_hosts FROM ly GROUP BY 1",
}
