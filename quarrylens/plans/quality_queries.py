"""Queries of code metrics, debt, coverage, compliance and requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import quality as q
from quarrylens.operators import taint
from quarrylens.plans.common import rounded, rounded_sql, t

# Sources: one small module for each supplier; its number makes the branches, attributes and bases.


def _sources(s, d):
    k = F.col("s_suppkey")
    text = F.concat(
        F.format_string("class C%d(%s):\n", k, F.when(k % 4 == 0, F.lit("object")).otherwise(F.format_string("C%d", k - k % 4))),
        F.lit("    def first(self, x):\n        self.a = x\n"), F.when(k % 2 == 0, F.lit("        if x and self.b:\n            return 1\n")).otherwise(F.lit("")),
        F.lit("        return self.a\n\n    def second(self):\n"), F.when(k % 3 == 0, F.lit("        return self.c\n")).otherwise(F.lit("        return self.a\n")),
    )
    return t(s, d, "supplier").select(F.format_string("m%d.py", k).alias("path"), text.alias("text"), k.alias("k"))


def h14(s, d):
    return rounded(q.class_metrics(q.class_rows(_sources(s, d))))


# Attributes: a in first (with b for even numbers), c or a in second. One pair of methods, which shares a unless the second uses c.
H14 = rounded_sql("""SELECT 'm' || k || '.py' AS path, 'C' || k AS class_name, (2 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END)::INTEGER AS wmc, 2::INTEGER AS rfc, 1::INTEGER AS cbo, CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END AS lcom_ck,
  greatest(0.0, least(1.0, 2 - (2 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE / (1 + (k % 2 = 0)::INTEGER + (k % 3 = 0)::INTEGER))) AS lcom_hs,
  (CASE WHEN k % 4 = 0 THEN 1 WHEN k - k % 4 IN (SELECT s_suppkey FROM supplier) THEN 2 ELSE 1 END)::INTEGER AS dit,
  CASE WHEN k % 4 = 0 THEN (SELECT count(*) FROM supplier x WHERE x.s_suppkey % 4 <> 0 AND x.s_suppkey - x.s_suppkey % 4 = k) ELSE 0 END AS noc
  FROM (SELECT s_suppkey AS k FROM supplier)""", "lcom_ck", "lcom_hs")


def h15(s, d):
    return rounded(q.function_metrics(_sources(s, d)))


# Names and constants by function: self, x, self.a = x, and with the branch x, self, 1; operators: return, and if, and, return.
H15 = rounded_sql("""SELECT 'm' || k || '.py' AS path, f.name, f.line_number, CASE WHEN f.name = 'first' AND k % 2 = 0 THEN 3 ELSE 1 END::INTEGER AS cyclomatic, CASE WHEN f.name = 'first' AND k % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS cognitive,
  CASE WHEN f.name = 'second' THEN 2 WHEN k % 2 = 0 THEN 5 ELSE 3 END::INTEGER AS loc, CASE WHEN f.name = 'second' THEN 2 * log2(2) WHEN k % 2 = 0 THEN 10 * log2(6) ELSE 4 * log2(3) END AS halstead_volume, 0.0::DOUBLE AS comment_percentage
  FROM (SELECT s_suppkey AS k, unnest([{'name': 'first', 'line_number': 2}, {'name': 'second', 'line_number': CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 6 END}]) AS f FROM supplier)""", "halstead_volume", "comment_percentage")


def h16(s, d):
    """Functions from orders: price makes the volume, the date the lines."""
    rows = t(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("halstead_volume"), (F.col("o_orderkey") % 40).cast("int").alias("cyclomatic"), F.dayofyear("o_orderdate").alias("loc"), (F.col("o_custkey") % 100).cast("double").alias("comment_percentage"))
    return rounded(q.maintainability(rows).select("o_orderkey", "maintainability_index", "level"))


H16 = rounded_sql("""SELECT o_orderkey, mi AS maintainability_index, CASE WHEN mi >= 85 THEN 'excellent' WHEN mi >= 70 THEN 'good' WHEN mi >= 50 THEN 'moderate' WHEN mi >= 25 THEN 'poor' ELSE 'critical' END AS level FROM (
  SELECT o_orderkey, greatest(0.0, least(100.0, 171 - 5.2 * ln(greatest(o_totalprice, 1.0)) - 0.23 * (o_orderkey % 40) - 16.2 * ln(dayofyear(o_orderdate)) + 50.0 * sin(sqrt(2.4 * greatest((o_custkey % 100)::DOUBLE, 0.1))))) AS mi FROM orders)""", "maintainability_index")


def _items(s, d):
    return t(s, d, "lineitem").select(F.col("l_returnflag").alias("debt_type"), F.concat(F.lit("f"), F.col("l_suppkey")).alias("file_path"), F.col("l_quantity").alias("effort_hours"), F.col("l_discount").alias("business_impact"), F.col("l_tax").alias("interest_rate"))


H17_ROI = rounded_sql("""SELECT debt_type, effort_hours, benefit, benefit / greatest(effort_hours, 0.1) AS roi, CASE WHEN benefit > 0 THEN least(3 / (benefit / greatest(effort_hours, 0.1)), 999.0) ELSE 999.0 END AS payback_months FROM (
  SELECT l_returnflag AS debt_type, sum(l_quantity) AS effort_hours, sum(l_discount * l_tax) AS benefit FROM lineitem GROUP BY ROLLUP (l_returnflag))""", "effort_hours", "benefit", "roi", "payback_months")
H17_PROJECTION = rounded_sql("""SELECT c AS current_hours, p AS projected_hours, 100 * (p - c) / greatest(c, 1.0) AS growth_percentage FROM (SELECT sum(l_quantity) AS c, sum(l_quantity * pow(1 + l_tax, 4.0)) AS p FROM lineitem)""", "current_hours", "projected_hours", "growth_percentage", digits=3)
H17_FILES = rounded_sql("SELECT 'f' || l_suppkey AS file_path, sum(l_quantity) AS effort_hours FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "effort_hours")


def h18(s, d):
    """Methods are parts, tests name them by customers."""
    methods = t(s, d, "part").select(F.concat(F.lit("Part"), F.col("p_partkey")).alias("name"), F.concat(F.lit("M"), F.col("p_size"), F.lit(".Part"), F.col("p_partkey")).alias("full_name"))
    c = F.col("c_custkey")
    tests = t(s, d, "customer").select(F.when(c % 3 == 0, F.concat(F.lit("test_part"), c)).when(c % 3 == 1, F.concat(F.lit("test_m"), c % 50, F.lit("_part"), c)).otherwise(F.concat(F.lit("check_part"), c)).alias("name"))
    return q.coverage_gaps(methods, tests)


H18 = """SELECT 'Part' || p_partkey AS name, 'M' || p_size || '.Part' || p_partkey AS full_name FROM part WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey AND (c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 50 = p_size)))"""


def _graded(s, d):
    """Findings from line items by part type; categories are the regions, with the part types of their nations' first letters."""
    e = F.col("l_quantity")
    findings = t(s, d, "lineitem").select(F.concat(F.lit("r"), F.col("l_suppkey") % 40).alias("rule"), F.when((F.col("l_suppkey") % 40 < 8) & (e > 49.9), "critical").when((F.col("l_suppkey") % 40 < 16) & (e > 49), "high").when((F.col("l_suppkey") % 40 < 24) & (e > 40), "medium").when((F.col("l_suppkey") % 40 < 32) & (e > 30), "low").otherwise("info").alias("severity"))
    n = t(s, d, "nation")
    categories = n.select(F.concat(F.lit("A"), F.col("n_nationkey")).alias("category_id"), F.col("n_name").alias("category_name"), F.when(F.col("n_nationkey") > 0, F.concat(F.lit("r"), F.col("n_nationkey") * 2)).alias("rule"))
    return q.compliance(findings, categories)


H20 = """SELECT *, CASE WHEN critical_count > 0 THEN 'F' WHEN high_count > 0 THEN 'D' WHEN medium_count > 0 OR low_count > 2 THEN 'C' WHEN low_count > 0 THEN 'B' ELSE 'A' END AS grade FROM (SELECT 'A' || n_nationkey AS category_id, n_name AS category_name,
  count(*) FILTER (WHERE r < 8 AND e > 49.9) AS critical_count, count(*) FILTER (WHERE r < 16 AND NOT (r < 8 AND e > 49.9) AND e > 49) AS high_count, count(*) FILTER (WHERE r < 24 AND NOT (r < 8 AND e > 49.9) AND NOT (r < 16 AND e > 49) AND e > 40) AS medium_count,
  count(*) FILTER (WHERE r < 32 AND NOT (r < 8 AND e > 49.9) AND NOT (r < 16 AND e > 49) AND NOT (r < 24 AND e > 40) AND e > 30) AS low_count FROM nation LEFT JOIN (SELECT l_suppkey % 40 AS r, l_quantity AS e FROM lineitem) ON r = n_nationkey * 2 AND n_nationkey > 0 GROUP BY 1, 2)"""


def h21(s, d):
    """A requirement for each brand, imports from parts."""
    brand = F.lower(F.regexp_replace("p_brand", "#", ""))
    p = t(s, d, "part").withColumn("b", brand)
    listed = p.where("p_size < 25").select("b").distinct().unionByName(s.createDataFrame([("never-used",)], "b string"))
    text = listed.agg(F.concat(F.lit("# all\n-r other.txt\n"), F.array_join(F.array_sort(F.collect_list(F.concat("b", F.lit("[x]>=1.0 ; y")))), "\n")).alias("text"))
    imports = p.where("p_size >= 20").select(F.when(F.col("p_size") == 50, F.lit("os")).when(F.col("p_size") == 49, F.lit("cv2")).otherwise(F.col("b")).alias("module"))
    return q.requirement_issues(q.parse_requirements(text), imports, s.createDataFrame([("os",)], "module string"), s.createDataFrame([("cv2", "opencv-python")], "module string, package string"))


H21 = """WITH r AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS package FROM part WHERE p_size < 25 UNION ALL SELECT 'never-used'),
i AS (SELECT CASE WHEN p_size = 49 THEN 'opencv-python' ELSE lower(replace(p_brand, '#', '')) END AS package, count(*) AS uses FROM part WHERE p_size >= 20 AND p_size <> 50 GROUP BY 1)
SELECT package, 'missing' AS issue, 'error' AS severity, uses FROM i WHERE package NOT IN (SELECT package FROM r) UNION ALL SELECT package, 'unused', 'warning', 0 FROM r WHERE package NOT IN (SELECT package FROM i)"""


def r18(s, d):
    """Orders as files: the tree before 1997 against that of today, in which some prices differ."""
    o = t(s, d, "orders")
    files = o.select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("path"), F.floor("o_totalprice").cast("string").alias("hash"), F.col("o_orderdate").alias("modified_at"))
    old = files.where("modified_at < timestamp_ntz '1997-01-01 00:00:00'").select("path", F.when(F.col("path").endswith("7"), "x").otherwise(F.col("hash")).alias("hash"))
    return q.new_code(files, old).withColumn("by", F.lit("reference")).unionByName(q.new_code(files, since="1998-01-01 00:00:00").withColumn("by", F.lit("date")))


R18 = """SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'new' ELSE 'modified' END AS state, 'reference' AS by FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' OR o_orderkey % 10 = 7
UNION ALL SELECT 'f' || o_orderkey, 'modified', 'date' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"""

def h19(s, d):
    """One module for each supplier, which hands its input to a function of another module and, if even, to the shell; in every third
    module that function cleans it."""
    k = F.col("s_suppkey")
    text = F.concat(
        F.format_string("from m%d import go as far\ndef go(v):\n    w = f'select {v}'\n", k - k % 5), F.when(k % 3 == 0, "    w = escape(w)\n").otherwise("    w = w + '!'\n"),
        F.lit("    cursor.execute(w)\ndef view(request):\n    x = request.args.get('q')\n    far(x)\n"), F.when(k % 2 == 0, "    os.system(x)\n").otherwise(""),
    )
    return taint.taint_flows(taint.taint_facts(t(s, d, "supplier").select(F.format_string("m%d.py", k).alias("path"), text.alias("text"))))


H19 = """SELECT 'm' || k || '.py' AS source_path, 'view' AS source_function, 7::INTEGER AS source_line, 'http_parameter' AS source_type, f.* FROM (SELECT s_suppkey AS k, unnest([
  {'sink_path': 'm' || (s_suppkey - s_suppkey % 5) || '.py', 'sink_function': 'go', 'sink_line': 5::INTEGER, 'sink_name': 'cursor.execute', 'sink_type': 'sql_query', 'severity': 'critical', 'cwe': 'CWE-89', 'owasp': 'A03:2021', 'sanitizers_present': false, 'steps': 5::INTEGER},
  {'sink_path': 'm' || s_suppkey || '.py', 'sink_function': 'view', 'sink_line': 9::INTEGER, 'sink_name': 'os.system', 'sink_type': 'shell_command', 'severity': 'critical', 'cwe': 'CWE-78', 'owasp': 'A03:2021', 'sanitizers_present': false, 'steps': 1::INTEGER}]) AS f FROM supplier)
  WHERE CASE WHEN f.sink_type = 'sql_query' THEN (k - k % 5) % 3 <> 0 AND k - k % 5 IN (SELECT s_suppkey FROM supplier) ELSE k % 2 = 0 END"""


QUERIES = {
    "h14_class_metrics": h14, "h15_complexity": h15, "h16_maintainability": h16,
    "h17_debt_roi": lambda s, d: rounded(q.debt_roi(_items(s, d))), "h17_projection": lambda s, d: rounded(q.debt_projection(_items(s, d), "year"), 3), "h17_most_indebted": lambda s, d: rounded(q.most_indebted(_items(s, d))),
    "h18_coverage_gaps": h18, "h19_taint": h19, "h20_compliance": _graded, "h20_overall": lambda s, d: q.overall_grade(_graded(s, d)), "h21_requirements": h21, "r18_new_code": r18,
}

ORACLES = {
    "h14_class_metrics": H14, "h15_complexity": H15, "h16_maintainability": H16, "h17_debt_roi": H17_ROI, "h17_projection": H17_PROJECTION, "h17_most_indebted": H17_FILES,
    "h18_coverage_gaps": H18, "h19_taint": H19, "h20_compliance": H20, "h20_overall": f"SELECT max(grade) AS overall_grade, count(*) AS categories FROM ({H20})", "h21_requirements": H21, "r18_new_code": R18,
}
