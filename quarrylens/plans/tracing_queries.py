"""Queries of spans, service maps and graphs. Spans stand for customers, their orders and their line items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.operators import graph, tracing
from quarrylens.plans.common import rounded, rounded_sql, t

DAY_NS = 86_400_000_000_000


def spans(s, d):
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    c = t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("nation"), "c_nationkey").alias("service_name"), "c_acctbal")
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    first = o.groupBy("o_custkey").agg(F.min(ns("o_orderdate")).alias("start_ns"))
    cs = c.join(first, c["k"] == first["o_custkey"]).select(F.col("k").cast("string").alias("trace_id"), F.concat(F.lit("c"), "k").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit(0).cast("long").alias("seq"), "service_name",
        F.lit("session").alias("operation_name"), F.lit(False).alias("is_error"), "start_ns", (F.abs("c_acctbal") + 400.0).alias("duration_ms"))
    os_ = o.select(F.col("o_custkey").cast("string").alias("trace_id"), F.concat(F.lit("o"), "o_orderkey").alias("span_id"), F.concat(F.lit("c"), "o_custkey").alias("parent_span_id"), (F.col("o_orderkey") * 10).cast("long").alias("seq"), F.concat(F.lit("orders"), "o_orderstatus").alias("service_name"),
        F.col("o_orderpriority").alias("operation_name"), (F.col("o_orderstatus") == "F").alias("is_error"), ns("o_orderdate").alias("start_ns"), (F.col("o_totalprice") / 1000).alias("duration_ms"))
    ls = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").cast("string").alias("trace_id"), F.concat_ws("_", F.concat(F.lit("l"), "l_orderkey"), "l_linenumber").alias("span_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_span_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), F.concat(F.lit("items"), "l_linestatus").alias("service_name"), F.col("l_returnflag").alias("operation_name"), (F.col("l_returnflag") == "R").alias("is_error"), ns("l_shipdate").alias("start_ns"), F.col("l_quantity").alias("duration_ms"))
    return cs.unionByName(os_).unionByName(ls).withColumn("end_ns", F.col("start_ns") + F.round(F.col("duration_ms") * 1000).cast("long") * 1000)


SPANS = """WITH sp AS (SELECT *, start_ns + round(duration_ms * 1000)::BIGINT * 1000 AS end_ns FROM (
  SELECT c_custkey::VARCHAR AS trace_id, 'c' || c_custkey AS span_id, NULL::VARCHAR AS parent_span_id, 0::BIGINT AS seq, 'nation' || c_nationkey AS service_name, 'session' AS operation_name, false AS is_error, f.start_ns, abs(c_acctbal) + 400.0::DOUBLE AS duration_ms
  FROM customer JOIN (SELECT o_custkey, min(epoch_us(o_orderdate)) * 1000 AS start_ns FROM orders GROUP BY 1) f ON o_custkey = c_custkey
  UNION ALL SELECT o_custkey::VARCHAR, 'o' || o_orderkey, 'c' || o_custkey, o_orderkey * 10, 'orders' || o_orderstatus, o_orderpriority, o_orderstatus = 'F', epoch_us(o_orderdate) * 1000, o_totalprice / 1000 FROM orders
  UNION ALL SELECT o_custkey::VARCHAR, 'l' || l_orderkey || '_' || l_linenumber, 'o' || l_orderkey, l_orderkey * 10 + l_linenumber, 'items' || l_linestatus, l_returnflag, l_returnflag = 'R', epoch_us(l_shipdate) * 1000, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)),
"""
TRACES = """tr AS (SELECT trace_id, root_span_id, service_count, span_count, error_count, coalesce(root_ms, longest) AS total_duration_ms FROM (SELECT trace_id, arg_min(span_id, seq) FILTER (WHERE parent_span_id IS NULL) AS root_span_id, arg_min(duration_ms, seq) FILTER (WHERE parent_span_id IS NULL) AS root_ms,
  count(DISTINCT service_name) AS service_count, count(*) AS span_count, count(*) FILTER (WHERE is_error) AS error_count, max(duration_ms) AS longest FROM sp GROUP BY 1))"""
MAP = """mp AS (SELECT p.service_name AS source_service, c.service_name AS target_service, count(*) AS call_count, count(*) FILTER (WHERE c.is_error) AS error_count, avg(c.duration_ms) AS avg_latency_ms, quantile_cont(c.duration_ms, 0.99) AS p99_latency_ms
  FROM sp c JOIN sp p ON c.parent_span_id = p.span_id WHERE p.service_name <> c.service_name GROUP BY 1, 2)"""


def path_sql(latest: bool) -> str:
    pick = "CASE WHEN e_end > l_end THEN e_id ELSE l_id END" if latest else "l_id"
    root = "coalesce(arg_min(span_id, seq) FILTER (WHERE parent_span_id IS NULL), arg_min(span_id, (start_ns, seq)))" if latest else "arg_min(span_id, seq) FILTER (WHERE parent_span_id IS NULL)"
    return f"""nx AS (SELECT trace_id, span_id, {pick} AS next_id FROM (SELECT trace_id, parent_span_id AS span_id, arg_max(span_id, (duration_ms, -seq)) AS l_id, arg_max(end_ns, (duration_ms, -seq)) AS l_end, arg_max(span_id, (end_ns, -seq)) AS e_id, max(end_ns) AS e_end FROM sp WHERE parent_span_id IS NOT NULL GROUP BY 1, 2)),
cp(trace_id, depth, span_id) AS (SELECT * FROM (SELECT trace_id, 0::INTEGER AS depth, {root} AS span_id FROM sp GROUP BY 1) WHERE span_id IS NOT NULL UNION ALL SELECT cp.trace_id, depth + 1, next_id FROM cp JOIN nx USING (trace_id, span_id))"""


SEGMENTS = path_sql(True) + """,
sg AS (SELECT * FROM (SELECT *, CASE WHEN trace_duration_ms > 0 THEN 100 * contribution_ms / trace_duration_ms ELSE 0.0 END AS contribution_percent FROM (SELECT trace_id, depth, span_id, service_name, operation_name,
  greatest(0.0, duration_ms - coalesce(lead(duration_ms) OVER (PARTITION BY trace_id ORDER BY depth), 0.0)) AS contribution_ms, trace_duration_ms FROM cp JOIN sp USING (trace_id, span_id) JOIN (SELECT trace_id, (max(end_ns) - min(start_ns)) / 1e6 AS trace_duration_ms FROM sp GROUP BY 1) USING (trace_id)))
  WHERE contribution_percent >= 5 OR depth = 0)"""
RSPANS = SPANS.replace("WITH sp", "WITH RECURSIVE sp", 1)
PAR = """pa AS (SELECT trace_id, sum(CASE WHEN s2 >= end_ns THEN least(duration_ms, d2) ELSE 0.0 END) AS parallelization_opportunity_ms FROM (SELECT *, lead(start_ns) OVER w AS s2, lead(duration_ms) OVER w AS d2 FROM sp WHERE parent_span_id IS NOT NULL WINDOW w AS (PARTITION BY trace_id, parent_span_id ORDER BY start_ns, seq, duration_ms)) GROUP BY 1)"""


def _edges(s, d):
    """Nation of a customer to the nation of a supplier of its line items, kept where the target's number is larger or the pair is on a small cycle."""
    c, o, li, su = t(s, d, "customer"), t(s, d, "orders"), t(s, d, "lineitem"), t(s, d, "supplier")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = e.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return pairs.where("dst - src BETWEEN 1 AND 4 OR (src = 7 AND dst = 5)").select("src", "dst")


EDGES = """WITH RECURSIVE ed AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey - c_nationkey BETWEEN 1 AND 4 OR (c_nationkey = 7 AND s_nationkey = 5))"""
CLOSURE = EDGES + ", cl(src, dst) AS (SELECT src, dst FROM ed UNION SELECT cl.src, ed.dst FROM cl JOIN ed ON cl.dst = ed.src)"


def _handovers(s, d):
    """From each customer to the customer of the next order of the same day, after their first and after their last order that has one."""
    day = W.partitionBy("o_orderdate").orderBy("o_orderkey")
    after = t(s, d, "orders").select(F.col("o_custkey").alias("src"), "o_orderkey", F.lead("o_custkey").over(day).alias("dst")).where("dst IS NOT NULL")
    both = after.groupBy("src").agg(F.min_by("dst", "o_orderkey").alias("a"), F.max_by("dst", "o_orderkey").alias("b"))
    return both.select("src", F.explode(F.array("a", "b")).alias("dst")).distinct()


HANDOVERS = """WITH RECURSIVE nx AS (SELECT o_custkey AS src, o_orderkey, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS dst FROM orders),
ed AS (SELECT DISTINCT src, unnest([a, b]) AS dst FROM (SELECT src, arg_min(dst, o_orderkey) AS a, arg_max(dst, o_orderkey) AS b FROM nx WHERE dst IS NOT NULL GROUP BY 1)),
cl(src, dst) AS (SELECT src, dst FROM ed UNION SELECT cl.src, ed.dst FROM cl JOIN ed ON cl.dst = ed.src),
nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed),
co AS (SELECT node, least(node, coalesce(min(b.src), node)) AS component FROM nd LEFT JOIN cl a ON a.src = node LEFT JOIN cl b ON b.src = a.dst AND b.dst = node GROUP BY 1)"""
FEEDBACK = HANDOVERS + """, dg AS (SELECT src, count(*) AS dependencies FROM ed GROUP BY 1),
il AS (SELECT src, dst, a.component FROM ed JOIN co a ON a.node = src JOIN co b ON b.node = dst WHERE a.component = b.component AND src <> dst),
st AS (SELECT arg_min(dst, (dependencies, src, dst)) AS node FROM il JOIN dg USING (src) GROUP BY component),
lv(node, level) AS (SELECT node, 0 FROM st UNION SELECT dst, level + 1 FROM lv JOIN il ON node = src WHERE level < 60), pl AS (SELECT node, min(level) AS level FROM lv GROUP BY 1),
ps AS (SELECT il.*, (a.level, src) > (b.level, dst) AS against FROM il JOIN pl a ON a.node = src JOIN pl b ON b.node = dst),
ly(node, layer) AS (SELECT node, 0 FROM pl UNION SELECT dst, layer + 1 FROM ly JOIN ps ON node = src AND NOT against), la AS (SELECT node, max(layer) AS layer FROM ly GROUP BY 1)
SELECT src, dst, component, dependencies FROM (SELECT src, dst, component FROM ps JOIN la a ON a.node = src JOIN la b ON b.node = dst WHERE against AND a.layer >= b.layer
  UNION ALL SELECT src, dst, component FROM ed JOIN co ON node = src WHERE src = dst) JOIN dg USING (src)"""


def _nodes(s, d):
    return t(s, d, "nation").select(F.col("n_nationkey").alias("node"))


def h10_modularity(s, d):
    """Of the graph's components."""
    edges = _handovers(s, d)
    return rounded(graph.modularity(edges, graph.components(edges).select("node", F.col("component").alias("community"))), 9)


def p08(s, d):
    return rounded(tracing.apm_report(spans(s, d)))


def p17(s, d):
    """Orders written as OTLP documents and read back."""
    o = t(s, d, "orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    doc = F.format_string('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"%s"}}]},"scopeSpans":[{"scope":{"name":"x"},"spans":[{"traceId":"%d","spanId":"o%d","parentSpanId":"","name":"%s","kind":2,"startTimeUnixNano":"%d","endTimeUnixNano":"%d","status":{"code":%d}}]}]}]}',
                          "o_orderpriority", "o_custkey", "o_orderkey", "o_orderstatus", us * 1000, us * 1000 + 1500000, F.when(F.col("o_orderstatus") == "F", 2).otherwise(1))
    return rounded(tracing.parse_otlp(o.select(doc.alias("json"))))


def p18(s, d):
    o = t(s, d, "orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    doc = F.format_string('{"data":[{"processes":{"p1":{"serviceName":"%s"}},"spans":[{"traceID":"%d","spanID":"o%d","operationName":"%s","processID":"p1","startTime":%d,"duration":1500,"references":[{"refType":"CHILD_OF","spanID":"c%d"}],"tags":[{"key":"error","value":%s},{"key":"span.kind","value":"client"}]}]}]}',
                          "o_orderpriority", "o_custkey", "o_orderkey", "o_orderstatus", us, "o_custkey", F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"))
    return rounded(tracing.parse_jaeger(o.select(doc.alias("json"))))


def p22(s, d):
    """Single spans in three formats, told apart by their keys."""
    o = t(s, d, "orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    zipkin = F.format_string('{"traceId":"%d","id":"o%d","parentId":"c%d","name":"%s","kind":"server","timestamp":%d,"duration":1500,"localEndpoint":{"serviceName":"%s"},"tags":{"error":"%s"}}', "o_custkey", "o_orderkey", "o_custkey", "o_orderstatus", us, "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "yes").otherwise(""))
    plain = F.format_string('{"trace_id":"%d","span_id":"o%d","parent_span_id":"c%d","name":"%s","kind":"SERVER","start_time_unix_nano":%d,"end_time_unix_nano":%d,"service_name":"%s","status":"%s"}', "o_custkey", "o_orderkey", "o_custkey", "o_orderstatus", us * 1000, us * 1000 + 1500000, "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "ERROR").otherwise("UNSET"))
    return rounded(tracing.parse_spans(o.select(F.when(F.col("o_orderkey") % 2 == 0, zipkin).otherwise(plain).alias("json"))))


PARSED = """SELECT o_custkey::VARCHAR AS trace_id, 'o' || o_orderkey AS span_id, {parent} AS parent_span_id, o_orderstatus AS operation_name, o_orderpriority AS service_name, epoch_us(o_orderdate) * 1000 AS start_ns, epoch_us(o_orderdate) * 1000 + 1500000 AS end_ns, 1.5::DOUBLE AS duration_ms,
  CASE WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE '{ok}' END AS status_code, '{kind}' AS kind, o_orderstatus = 'F' AS is_error FROM orders"""

QUERIES = {
    "p01_self_time": lambda s, d: rounded(tracing.span_analysis(spans(s, d)).select("span_id", "child_count", "total_child_duration_ms", "self_time_ms", "is_slow", "slowness_factor"), 8),
    "p03_slow_spans": lambda s, d: rounded(tracing.slow_spans(spans(s, d), 5000.0).select("span_id", "duration_ms")),
    "p04_error_spans": lambda s, d: tracing.error_spans(spans(s, d)).select("span_id"),
    "p05_span_statistics": lambda s, d: rounded(tracing.span_statistics(spans(s, d), ["service_name"])),
    "p07_service_metrics": lambda s, d: rounded(tracing.service_metrics(spans(s, d))),
    "p08_apm_report": p08,
    "p08_slow_traces": lambda s, d: rounded(tracing.top_traces(spans(s, d))),
    "p10_traces": lambda s, d: rounded(tracing.traces(spans(s, d))),
    "p12_service_map": lambda s, d: rounded(tracing.service_map(spans(s, d))),
    "p12_roots_leaves": lambda s, d: tracing.roots_and_leaves(spans(s, d), tracing.service_links(spans(s, d))),
    "p13_critical_path": lambda s, d: tracing.critical_paths(spans(s, d)),
    "p14_cycles": lambda s, d: graph.cycles(_edges(s, d)).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "length", "severity"),
    "p15_callees": lambda s, d: graph.callees(_edges(s, d)),
    "p15_callers": lambda s, d: graph.callers(_edges(s, d)),
    "p16_depths": lambda s, d: graph.depths(_edges(s, d), _nodes(s, d)),
    "p17_otlp": p17, "p18_jaeger": p18, "p22_mixed_formats": p22,
    "p21_trace_depths": lambda s, d: rounded(tracing.trace_depths(spans(s, d))),
    "p23_path_segments": lambda s, d: rounded(tracing.path_segments(spans(s, d))),
    "p23_critical_path_results": lambda s, d: rounded(tracing.critical_path_results(spans(s, d))),
    "p25_parallel": lambda s, d: rounded(tracing.parallel_opportunity(spans(s, d))),
    "p26_common_bottlenecks": lambda s, d: rounded(tracing.common_bottlenecks(tracing.path_segments(spans(s, d)))),
    "p27_service_bottlenecks": lambda s, d: rounded(tracing.service_bottlenecks(tracing.path_segments(spans(s, d)))),
    "p28_compare_traces": lambda s, d: rounded(tracing.compare_traces(tracing.path_segments(spans(s, d)), "1", "2")),
    "h09_coupling": lambda s, d: rounded(graph.coupling(_edges(s, d))),
    "h10_components": lambda s, d: graph.components(_edges(s, d)),
    "h11_layer_violations": lambda s, d: graph.layer_violations(_edges(s, d), t(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("rank"))),
    "h13_strong_components": lambda s, d: graph.strong_components(_edges(s, d)),
    "h10_communities": lambda s, d: graph.communities(_edges(s, d)),
    "h10_modularity": h10_modularity,
    "h12_cycle_breaks": lambda s, d: graph.cycle_breaks(_edges(s, d)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ",")),
    "h12_feedback_edges": lambda s, d: graph.feedback_edges(_handovers(s, d)),
    "h13_strong_components_all": lambda s, d: graph.strong_components(_handovers(s, d)),
    "h13_shortest_paths": lambda s, d: graph.shortest_paths(_edges(s, d), 0),
    "h13_topological": lambda s, d: graph.topological_levels(_edges(s, d), _nodes(s, d)),
}

STAT = "count(*) AS span_count, sum(duration_ms) AS total_ms, avg(duration_ms) AS mean_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, stddev_pop(duration_ms) AS std_dev_ms, " + ", ".join(f"quantile_cont(duration_ms, 0.{p}) AS p{p}" for p in ("50", "75", "90", "95", "99"))
ORACLES = {
    "p01_self_time": rounded_sql(SPANS + """ch AS (SELECT parent_span_id AS span_id, count(*) AS n, sum(duration_ms) AS total FROM sp WHERE parent_span_id IS NOT NULL GROUP BY 1)
      SELECT span_id, coalesce(n, 0) AS child_count, coalesce(total, 0.0) AS total_child_duration_ms, greatest(0.0, duration_ms - coalesce(total, 0.0)) AS self_time_ms, duration_ms > 100 AS is_slow, duration_ms / 100 AS slowness_factor FROM sp LEFT JOIN ch USING (span_id)""", "total_child_duration_ms", "self_time_ms", "slowness_factor", digits=8),
    "p03_slow_spans": rounded_sql(SPANS + "x AS (SELECT 1) SELECT span_id, duration_ms FROM sp WHERE duration_ms > 5000", "duration_ms"),
    "p04_error_spans": SPANS + "x AS (SELECT 1) SELECT span_id FROM sp WHERE is_error",
    "p05_span_statistics": rounded_sql(SPANS + f"x AS (SELECT 1) SELECT service_name, {STAT} FROM sp GROUP BY 1", "total_ms", "mean_ms", "min_ms", "max_ms", "std_dev_ms", "p50", "p75", "p90", "p95", "p99"),
    "p07_service_metrics": rounded_sql(SPANS + """x AS (SELECT 1) SELECT service_name, operation_name, count(*) AS request_count, count(*) FILTER (WHERE is_error) AS error_count, sum(duration_ms) AS total_duration_ms, avg(duration_ms) AS avg_duration_ms, min(duration_ms) AS min_duration_ms, max(duration_ms) AS max_duration_ms,
      count(*) FILTER (WHERE is_error) / count(*) AS error_rate, count(*) / greatest((max(end_ns) - min(start_ns)) / 1e9, 1.0) AS throughput_per_second, operation_name IS NULL AS is_total, quantile_cont(duration_ms, 0.5) AS p50_duration_ms, quantile_cont(duration_ms, 0.95) AS p95_duration_ms, quantile_cont(duration_ms, 0.99) AS p99_duration_ms
      FROM sp GROUP BY GROUPING SETS ((service_name), (service_name, operation_name))""", "total_duration_ms", "avg_duration_ms", "min_duration_ms", "max_duration_ms", "error_rate", "throughput_per_second", "p50_duration_ms", "p95_duration_ms", "p99_duration_ms"),
    "p08_apm_report": rounded_sql(SPANS + TRACES + """ SELECT trace_count, span_count, slow_traces, error_traces, overall_avg_latency_ms, overall_p99_latency_ms, overall_error_rate, greatest(0.0, least(100.0, 100.0 - least(overall_error_rate * 3000, 30) - CASE WHEN overall_p99_latency_ms > 5000 THEN 20 WHEN overall_p99_latency_ms > 2000 THEN 10 WHEN overall_p99_latency_ms > 1000 THEN 5 ELSE 0 END)) AS health_score
      FROM (SELECT count(*) AS trace_count, sum(span_count)::BIGINT AS span_count, count(*) FILTER (WHERE total_duration_ms > 1000) AS slow_traces, count(*) FILTER (WHERE error_count > 0) AS error_traces, avg(total_duration_ms) AS overall_avg_latency_ms, quantile_cont(total_duration_ms, 0.99) AS overall_p99_latency_ms, sum(error_count) / sum(span_count) AS overall_error_rate FROM tr)""", "overall_avg_latency_ms", "overall_p99_latency_ms", "overall_error_rate", "health_score"),
    "p08_slow_traces": rounded_sql(SPANS + TRACES + " SELECT * FROM tr WHERE total_duration_ms > 1000 ORDER BY trace_id LIMIT 10", "total_duration_ms"),
    "p10_traces": rounded_sql(SPANS + TRACES + " SELECT * FROM tr", "total_duration_ms"),
    "p12_service_map": rounded_sql(SPANS + MAP + " SELECT * FROM mp", "avg_latency_ms", "p99_latency_ms"),
    "p12_roots_leaves": SPANS + MAP + " SELECT DISTINCT service_name, 'root' AS kind FROM sp WHERE service_name NOT IN (SELECT target_service FROM mp) UNION ALL SELECT DISTINCT service_name, 'leaf' FROM sp WHERE service_name NOT IN (SELECT source_service FROM mp)",
    "p13_critical_path": RSPANS + path_sql(False) + " SELECT * FROM cp",
    "p14_cycles": EDGES + """, pt(path) AS (SELECT [src, dst] FROM ed WHERE dst >= src UNION ALL SELECT list_append(path, ed.dst) FROM pt JOIN ed ON path[-1] = ed.src WHERE path[1] <> path[-1] AND len(path) <= 4 AND (ed.dst = path[1] OR (ed.dst > path[1] AND NOT list_contains(path, ed.dst))))
      SELECT array_to_string(path, ',') AS path, (len(path) - 1)::INTEGER AS length, CASE WHEN len(path) <= 3 THEN 'critical' WHEN len(path) <= 4 THEN 'high' WHEN len(path) <= 6 THEN 'medium' ELSE 'low' END AS severity FROM pt WHERE path[1] = path[-1]""",
    "p15_callees": CLOSURE + " SELECT src AS service, dst AS callee FROM cl",
    "p15_callers": CLOSURE + " SELECT dst AS service, src AS caller FROM cl",
    "p16_depths": EDGES + """, lv(node, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM ed) UNION SELECT dst, depth + 1 FROM lv JOIN ed ON node = src WHERE depth < 30) SELECT n_nationkey AS node, coalesce(min(depth), -1)::INTEGER AS depth FROM nation LEFT JOIN lv ON node = n_nationkey GROUP BY 1""",
    "p17_otlp": rounded_sql(PARSED.format(parent="NULL::VARCHAR", ok="OK", kind="SERVER"), "duration_ms"), "p18_jaeger": rounded_sql(PARSED.format(parent="'c' || o_custkey", ok="UNSET", kind="CLIENT"), "duration_ms"), "p22_mixed_formats": rounded_sql(PARSED.format(parent="'c' || o_custkey", ok="UNSET", kind="SERVER"), "duration_ms"),
    "p21_trace_depths": rounded_sql(SPANS + """dp AS (SELECT a.trace_id, max(CASE WHEN a.parent_span_id IS NULL THEN 1 WHEN b.parent_span_id IS NULL THEN 2 ELSE 3 END) AS depth FROM sp a LEFT JOIN sp b ON a.parent_span_id = b.span_id AND a.trace_id = b.trace_id GROUP BY 1)
      SELECT trace_id, (max(end_ns) - min(start_ns)) / 1e6 AS total_duration_ms, count(DISTINCT service_name) AS service_count, count(*) AS span_count, count(*) FILTER (WHERE is_error) AS error_count, any_value(depth)::BIGINT AS depth FROM sp JOIN dp USING (trace_id) GROUP BY 1""", "total_duration_ms"),
    "p23_path_segments": rounded_sql(RSPANS + SEGMENTS + " SELECT * FROM sg", "contribution_ms", "contribution_percent", "trace_duration_ms"),
    "p23_critical_path_results": rounded_sql(RSPANS + SEGMENTS + ", " + PAR + """ SELECT trace_id, max(trace_duration_ms) AS total_duration_ms, sum(contribution_ms) AS critical_path_duration_ms, count(*) AS segments, arg_max(service_name, (contribution_ms, -depth)) AS bottleneck_service, arg_max(operation_name, (contribution_ms, -depth)) AS bottleneck_operation,
      coalesce(any_value(parallelization_opportunity_ms), 0.0) AS parallelization_opportunity_ms FROM sg LEFT JOIN pa USING (trace_id) GROUP BY 1""", "total_duration_ms", "critical_path_duration_ms", "parallelization_opportunity_ms"),
    "p25_parallel": rounded_sql(SPANS + PAR + " SELECT * FROM pa", "parallelization_opportunity_ms"),
    "p26_common_bottlenecks": rounded_sql(RSPANS + SEGMENTS + " SELECT service_name, operation_name, avg(contribution_ms) AS avg_contribution_ms FROM sg GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5", "avg_contribution_ms"),
    "p27_service_bottlenecks": rounded_sql(RSPANS + SEGMENTS + " SELECT service_name, sum(contribution_ms) AS total_contribution_ms, avg(contribution_ms) AS avg_contribution_ms, max(contribution_ms) AS max_contribution_ms, count(*) AS occurrence_count, quantile_cont(contribution_ms, 0.5) AS p50_contribution_ms, quantile_cont(contribution_ms, 0.99) AS p99_contribution_ms FROM sg GROUP BY 1",
      "total_contribution_ms", "avg_contribution_ms", "max_contribution_ms", "p50_contribution_ms", "p99_contribution_ms"),
    "p28_compare_traces": rounded_sql(RSPANS + SEGMENTS + """, a AS (SELECT service_name, operation_name, arg_max(contribution_ms, depth) AS x FROM sg WHERE trace_id = '1' GROUP BY 1, 2), b AS (SELECT service_name, operation_name, arg_max(contribution_ms, depth) AS y FROM sg WHERE trace_id = '2' GROUP BY 1, 2)
      SELECT service_name, operation_name, coalesce(x, 0.0) AS time_a_ms, coalesce(y, 0.0) AS time_b_ms, coalesce(y, 0.0) - coalesce(x, 0.0) AS difference_ms, CASE WHEN coalesce(x, 0.0) > 0 THEN 100 * (coalesce(y, 0.0) - x) / x ELSE 0.0 END AS change_percent FROM a FULL JOIN b USING (service_name, operation_name) WHERE abs(coalesce(y, 0.0) - coalesce(x, 0.0)) > 1""", "time_a_ms", "time_b_ms", "difference_ms", "change_percent"),
    "h09_coupling": rounded_sql(EDGES + """, a AS (SELECT src AS node, count(*) AS ce FROM ed WHERE src <> dst GROUP BY 1), b AS (SELECT dst AS node, count(*) AS ca FROM ed WHERE src <> dst GROUP BY 1), c AS (SELECT node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) AS instability FROM a FULL JOIN b USING (node))
      SELECT *, CASE WHEN instability < 0.2 THEN 'stable' WHEN instability > 0.8 THEN 'unstable' ELSE 'balanced' END AS category FROM c""", "instability"),
    "h10_components": EDGES + ", bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), re(node, other) AS (SELECT src, src FROM bo UNION SELECT node, dst FROM re JOIN bo ON other = src) SELECT node, min(other) AS component FROM re GROUP BY 1",
    "h11_layer_violations": EDGES + " SELECT src, dst, a.n_regionkey AS src_rank, b.n_regionkey AS dst_rank FROM ed JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey > b.n_regionkey",
    "h13_strong_components": CLOSURE + ", nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed) SELECT node, least(node, coalesce(min(b.src), node)) AS component FROM nd LEFT JOIN cl a ON a.src = node LEFT JOIN cl b ON b.src = a.dst AND b.dst = node GROUP BY 1",
    "h10_modularity": HANDOVERS + """, sy AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ed WHERE src <> dst), un AS (SELECT a AS src, b AS dst FROM sy UNION ALL SELECT b, a FROM sy), uc(src, dst) AS (SELECT src, dst FROM un UNION SELECT uc.src, un.dst FROM uc JOIN un ON uc.dst = un.src),
      cm AS (SELECT src AS node, min(dst) AS c FROM uc GROUP BY 1), kk AS (SELECT c, count(*) AS k FROM un JOIN cm ON node = src GROUP BY 1) SELECT round(((SELECT sum(k) FROM kk)::DOUBLE * (SELECT sum(k) FROM kk) - (SELECT sum(k * k) FROM kk)) / ((SELECT sum(k) FROM kk)::DOUBLE * (SELECT sum(k) FROM kk)), 9) + 0.0 AS modularity""",
    "h12_cycle_breaks": EDGES + """, pt(path) AS (SELECT [src, dst] FROM ed WHERE dst >= src UNION ALL SELECT list_append(path, ed.dst) FROM pt JOIN ed ON path[-1] = ed.src WHERE path[1] <> path[-1] AND len(path) <= 4 AND (ed.dst = path[1] OR (ed.dst > path[1] AND NOT list_contains(path, ed.dst)))),
      cy AS (SELECT path, unnest(range(1, len(path))) AS k FROM pt WHERE path[1] = path[-1]), dg AS (SELECT src, count(*) AS dependencies FROM ed GROUP BY 1), bs AS (SELECT path, min((dependencies, k, path[k], path[k + 1])) AS b FROM cy JOIN dg ON src = path[k] GROUP BY 1)
      SELECT array_to_string(path, ',') AS path, b[3] AS src, b[4] AS dst, b[1] AS dependencies, 'Source has only ' || b[1] || ' dependencies' AS reason FROM bs""",
    "h12_feedback_edges": FEEDBACK,
    "h13_strong_components_all": HANDOVERS + " SELECT node, component FROM co",
    "h13_shortest_paths": EDGES + ", lv(node, distance) AS (SELECT 0, 0 UNION SELECT dst, distance + 1 FROM lv JOIN ed ON node = src WHERE distance < 30) SELECT node::INTEGER AS node, min(distance)::INTEGER AS distance FROM lv GROUP BY 1",
    "h13_topological": CLOSURE + """, bad AS (SELECT DISTINCT a.dst AS node FROM cl a JOIN cl b ON a.src = b.src AND b.src = b.dst UNION SELECT src FROM cl WHERE src = dst), ly(node, layer) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM ed) AND n_nationkey NOT IN (SELECT node FROM bad)
      UNION SELECT dst, layer + 1 FROM ly JOIN ed ON node = src WHERE dst NOT IN (SELECT node FROM bad) AND layer < 40) SELECT n_nationkey AS node, max(layer)::INTEGER AS layer FROM nation LEFT JOIN ly ON node = n_nationkey GROUP BY 1""",
}
