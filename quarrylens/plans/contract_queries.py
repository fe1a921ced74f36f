"""Queries of schemas and contracts, pages and their resources, files and dashboards."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarrylens.operators import history as h
from quarrylens.operators import schema as sc
from quarrylens.operators import slo, web
from quarrylens.plans.common import rounded, rounded_sql, scratch, t
from quarrylens.plans.record_queries import LINKS, TRACKED, snapshots, tracked
from quarrylens.sources import readers


def f07(s, d):
    """The JSON Schema of each table, and its columns in it."""
    tables = ("orders", "customer", "events", "embeddings")
    return s.createDataFrame([(name, json.dumps(sc.schema_of(t(s, d, name).schema), sort_keys=True)) for name in tables], "table_name string, json_schema string")


def _columns_schema(columns: dict) -> str:
    return json.dumps({"type": "object", "properties": columns}, sort_keys=True)


_NUMBER, _INTEGER, _TEXT, _TIME = {"type": "number"}, {"type": "integer"}, {"type": "string"}, {"type": "string", "format": "date-time"}
F07 = "SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', '{_columns_schema(columns)}')" for name, columns in {
        "orders": {"o_orderkey": _INTEGER, "o_custkey": _INTEGER, "o_orderstatus": _TEXT, "o_totalprice": _NUMBER, "o_orderdate": _TIME, "o_orderpriority": _TEXT},
        "customer": {"c_custkey": _INTEGER, "c_name": _TEXT, "c_nationkey": _INTEGER, "c_acctbal": _NUMBER, "c_mktsegment": _TEXT},
        "events": {"event_id": _INTEGER, "ts": _TIME, "user_id": _INTEGER, "event_type": _TEXT, "value": _NUMBER, "props": _TEXT},
        "embeddings": {"vec_id": _INTEGER, "embedding": {"type": "array", "items": _NUMBER}, "label": _INTEGER},
    }.items()
) + ") v(table_name, json_schema)"


def _avro(s, d):
    """user_id, old_schema, new_schema: records whose second field differs by user."""
    users = t(s, d, "events").select("user_id").distinct()
    u = F.col("user_id")
    record = lambda fields: F.concat(F.lit('{"type":"record","name":"R","fields":[{"name":"a","type":"int"}'), fields, F.lit("]}"))
    new = F.when(u % 4 == 0, F.lit(',{"name":"b","type":"long","default":0}')).when(u % 4 == 1, F.lit(',{"name":"b","type":"long"}')).when(u % 4 == 2, F.lit(',{"name":"c","type":["null","string"],"default":null}')).otherwise(F.lit(""))
    old = F.when(u % 3 == 0, F.lit(',{"name":"b","type":"int"}')).otherwise(F.lit(""))
    return users.select("user_id", record(old).alias("old_schema"), record(new).alias("new_schema"))


def f12(s, d):
    return sc.avro_compatibility(_avro(s, d)).drop("old_schema", "new_schema")


# The new schema reads the old unless it has b without default and the old has none; the old reads the new unless it has b and the new has none, or a long.
F12 = """SELECT user_id, backward, forward, backward AND forward AS "full" FROM (SELECT user_id, NOT (user_id % 4 = 1 AND user_id % 3 <> 0) AS backward, user_id % 3 <> 0 AS forward FROM (SELECT DISTINCT user_id FROM events))"""


def f13(s, d):
    u = F.col("user_id")
    kind = F.when(u % 5 == 0, F.lit('"strin"')).when(u % 5 == 1, F.lit('{"type":"enum","name":"E","symbols":[]}')).when(u % 5 == 2, F.lit('{"type":"fixed","name":"F"}')).otherwise(F.lit('{"type":"map","values":"long"}'))
    rows = t(s, d, "events").select("user_id").distinct().select("user_id", F.concat(F.lit('{"type":"record","name":"R","fields":[{"name":"a","type":'), kind, F.lit("}]}")).alias("avro"))
    return sc.avro_validation(rows).drop("avro")


F13 = "SELECT user_id, CASE user_id % 5 WHEN 0 THEN '$.a: unknown type strin' WHEN 1 THEN '$.a: no symbols' WHEN 2 THEN '$.a: no size' ELSE '' END AS problems, user_id % 5 > 2 AS is_valid FROM (SELECT DISTINCT user_id FROM events)"


def _proto(s, d, new: bool):
    """A message for each nation; in the new version some fields go, come or change."""
    n = t(s, d, "nation")
    k, one = F.col("n_nationkey"), lambda x: F.concat(F.lit("message M"), F.col("n_nationkey").cast("string"), F.lit(" { string name = 1; "), x, F.lit(" }"))
    body = F.when(k % 3 == 0, F.lit("int32 size = 2;")).when(k % 3 == 1, F.lit("repeated int64 size = 2;")).otherwise(F.lit("int64 length = 2; int64 more = 3;")) if new else F.lit("int64 size = 2;")
    return sc.proto_fields(n.select(one(body).alias("proto")))


def f14(s, d):
    return sc.proto_changes(_proto(s, d, False), _proto(s, d, True))


F14 = """SELECT 'M' || n_nationkey AS message_name, f.field_number, f.change, f.change <> 'renamed' AND f.change <> 'added' AS is_breaking FROM nation, (VALUES (0, 2, 'type changed'), (1, 2, 'label changed'), (2, 2, 'renamed'), (2, 3, 'added')) f(k, field_number, change) WHERE n_nationkey % 3 = f.k"""


def f14_problems(s, d):
    """Field numbers by supplier: twice, reserved or out of range."""
    k = F.col("s_suppkey")
    rows = t(s, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("message_name"), F.explode(F.array(F.lit(1), F.when(k % 3 == 0, 1).when(k % 3 == 1, 19500).otherwise(536870912))).alias("field_number"))
    return sc.proto_problems(rows)


F14_PROBLEMS = "SELECT 'S' || s_suppkey AS message_name, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 19500 ELSE 536870912 END::INTEGER AS field_number, CASE s_suppkey % 3 WHEN 0 THEN 'number used twice' WHEN 1 THEN 'number reserved' ELSE 'number out of range' END AS problem FROM supplier"


def _contract(s, d, new: bool):
    """Endpoints by nation, parameters by supplier: in the new contract those of one region go, and one in five parameters changes."""
    n, p = t(s, d, "nation"), t(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    k = F.col("s_suppkey")
    rows = n.join(p, "n_nationkey", "left").select("n_regionkey", F.concat(F.lit("/"), F.lower("n_name")).alias("path"), F.lit("get").alias("method"), F.concat(F.lit("p"), k.cast("string")).alias("parameter"), (k % 2 == 0).alias("required"), "s_suppkey")
    if new:
        rows = rows.where("n_regionkey <> 2 and (s_suppkey is null or s_suppkey % 5 <> 0)").withColumn("required", F.col("required") | (k % 5 == 1))
    return rows.select("path", "method", "parameter", "required")


def f15(s, d):
    return sc.endpoint_diff(_contract(s, d, False), _contract(s, d, True))


F15 = """WITH o AS (SELECT n_regionkey, '/' || lower(n_name) AS path, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey),
left_ AS (SELECT DISTINCT path FROM o WHERE n_regionkey <> 2 AND (s_suppkey IS NULL OR s_suppkey % 5 <> 0))
SELECT DISTINCT path, 'get' AS method, NULL::VARCHAR AS parameter, 'endpoint removed' AS change FROM o WHERE path NOT IN (SELECT path FROM left_)
UNION ALL SELECT path, 'get', 'p' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'parameter removed' ELSE 'parameter made required' END FROM o WHERE path IN (SELECT path FROM left_) AND s_suppkey IS NOT NULL AND (s_suppkey % 5 = 0 OR (s_suppkey % 5 = 1 AND s_suppkey % 2 = 1))"""


def _ddl(s, d, new: bool):
    """Tables of the nations, which point at their regions' tables, inline or apart, and at others; some with an index."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    inline = F.format_string("CREATE TABLE n%d (id BIGINT PRIMARY KEY, price DECIMAL(10, 2), region_id INT NOT NULL REFERENCES r%d(id)", k, r)
    apart = F.when(k % 2 == 0, F.lit(", a INT, b INT, FOREIGN KEY (a , b) REFERENCES pairs (x, y)")).otherwise(F.lit(""))
    index = F.when(k % 5 == 0, F.format_string("; CREATE UNIQUE INDEX IF NOT EXISTS i%d ON n%d (price,  id)", k, k)).when(k % 5 == 1, F.format_string("; create index i%d on n%d(price)", k, k)).otherwise(F.lit(""))
    return t(s, d, "nation").select(F.concat(inline, apart, F.lit(")"), F.when(k % 5 == 0, F.lit("")).otherwise(index) if new else index, F.lit("; -- end")).alias("ddl"))


def f08_keys(s, d):
    return sc.ddl_keys(_ddl(s, d, False))


def f10_keys(s, d):
    return sc.keys_diff(f08_keys(s, d), sc.ddl_keys(_ddl(s, d, True)))


F08_KEYS = """SELECT 'foreign key' AS kind, 'n' || n_nationkey AS table_name, 'region_id' AS key_columns, 'r' || n_regionkey AS target_table, 'id' AS target_columns, NULL::VARCHAR AS index_name FROM nation
UNION ALL SELECT 'foreign key', 'n' || n_nationkey, 'a,b', 'pairs', 'x,y', NULL FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT CASE n_nationkey % 5 WHEN 0 THEN 'unique index' ELSE 'index' END, 'n' || n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'price,id' ELSE 'price' END, NULL, NULL, 'i' || n_nationkey FROM nation WHERE n_nationkey % 5 < 2"""


def w07_health(s, d):
    """Checked links from line items: the quantity makes the status, the days to shipping the redirects."""
    code = F.when(F.col("l_quantity") < 5, F.lit(None)).when(F.col("l_quantity") < 10, 404).when(F.col("l_quantity") < 20, 301).otherwise(200)
    rows = t(s, d, "lineitem").select("l_suppkey", code.alias("status_code"), F.col("l_extendedprice").alias("response_ms"), (F.col("l_linenumber") % 3).alias("redirects"))
    return rounded(web.link_health(rows, "l_suppkey"))


W07_HEALTH = rounded_sql("""SELECT *, 100.0 * ok / checked AS health_score FROM (SELECT l_suppkey, count(*) AS checked, count(*) FILTER (WHERE l_quantity >= 20) AS ok, count(*) FILTER (WHERE l_quantity < 10) AS broken, count(*) FILTER (WHERE l_linenumber % 3 > 0) AS redirected,
  count(*) FILTER (WHERE l_linenumber % 3 > 1) AS redirect_chains, count(*) FILTER (WHERE l_extendedprice > 3000) AS slow FROM lineitem GROUP BY 1)""", "health_score")


def w08(s, d):
    """Pages with a JSON-LD block that the page's number makes."""
    k = F.col("page_id")
    made = F.when(k % 3 == 0, F.lit('{"@type": "Article", "headline": "x", "author": "y"}')).when(k % 3 == 1, F.lit('{"@type": "Person", "name": "z"}')).otherwise(F.lit("{no json"))
    pages = t(s, d, "pages").withColumn("html", F.concat("html", F.lit('<script type="application/ld+json">'), made, F.lit("</script>")))
    return web.structured_data(pages, "page_id")


W08 = """SELECT page_id, 0::INTEGER AS position, CASE page_id % 3 WHEN 0 THEN 'Article' WHEN 1 THEN 'Person' END AS schema_type, page_id % 3 < 2 AS is_json, CASE WHEN page_id % 3 = 0 THEN 'datePublished,image' ELSE '' END AS missing FROM pages"""


def w09(s, d):
    """The links of pages by kind of resource."""
    found = web.links(t(s, d, "pages"), "page_id").select("page_id", "position", "href", F.when(F.col("position") % 4 == 0, "fetch").when(F.col("position") % 4 == 1, "img").otherwise("other").alias("initiator"))
    return found.select("page_id", "position", web.resource_type(F.col("initiator"), F.col("href")).alias("resource_type"))


W09 = "WITH " + LINKS + r""" SELECT page_id, position, CASE WHEN position % 4 = 1 THEN 'image' WHEN ext IN ('js', 'mjs') THEN 'script' WHEN ext = 'css' THEN 'stylesheet' WHEN ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'svg', 'avif', 'ico') THEN 'image'
  WHEN ext IN ('woff', 'woff2', 'ttf', 'otf') THEN 'font' WHEN ext IN ('mp4', 'webm', 'mp3') THEN 'media' WHEN position % 4 = 0 THEN 'xhr' ELSE 'other' END AS resource_type FROM (SELECT page_id, position, lower(regexp_extract(href, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM lh)"""


def w10(s, d):
    k = F.col("page_id")
    header = F.when(k % 4 == 0, F.lit("default-src 'self'; script-src 'self' 'unsafe-inline'")).when(k % 4 == 1, F.lit("img-src *")).when(k % 4 == 2, F.lit("script-src *; object-src 'none'"))
    return web.csp_checks(t(s, d, "pages").select("page_id", header.alias("csp")), "csp").drop("csp")


W10 = """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 0 ELSE 2 END::BIGINT AS n_directives, CASE page_id % 4 WHEN 0 THEN 'unsafe-inline' WHEN 1 THEN 'no script-src,no object-src' WHEN 2 THEN 'wildcard' ELSE 'missing' END AS weaknesses,
  CASE page_id % 4 WHEN 1 THEN 60 WHEN 3 THEN 0 ELSE 80 END::INTEGER AS csp_score FROM pages"""


def w12(s, d):
    """Regions in masks of 8 by 8 that an embedding's signs make: number of regions and of marked pixels."""
    mask = F.transform(F.slice("embedding", 1, 64), lambda x: (x > 0).cast("int"))
    made = t(s, d, "embeddings").where(F.size("embedding") >= 64).select("vec_id", mask.alias("m")).withColumn("regions", web.label_regions("m", F.lit(8)))
    return made.select("vec_id", F.array_max("regions").cast("long").alias("n_regions"), F.size(F.filter("regions", lambda x: x > 0)).cast("long").alias("n_marked"))


W12 = """WITH RECURSIVE p AS (SELECT vec_id, i - 1 AS i FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE len(embedding) >= 64) WHERE embedding[i] > 0),
near AS (SELECT a.vec_id, a.i, b.i AS j FROM p a JOIN p b ON a.vec_id = b.vec_id AND (abs(a.i - b.i) = 8 OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8))),
reach(vec_id, i, j) AS (SELECT vec_id, i, i FROM p UNION SELECT r.vec_id, r.i, n.j FROM reach r JOIN near n ON r.vec_id = n.vec_id AND r.j = n.i),
low AS (SELECT vec_id, i, min(j) AS root FROM reach GROUP BY 1, 2)
SELECT e.vec_id, coalesce(n_regions, 0)::BIGINT AS n_regions, coalesce(n_marked, 0)::BIGINT AS n_marked FROM (SELECT vec_id FROM embeddings WHERE len(embedding) >= 64) e LEFT JOIN (SELECT vec_id, count(DISTINCT root) AS n_regions, count(*) AS n_marked FROM low GROUP BY 1) USING (vec_id)"""


def h01(s, d):
    """The Parquet files of the nations as a tree of files: is each there, with its size?"""
    return readers.source_tree(s, d, "nation.parquet").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), (F.col("size") > 0).alias("has_content"))


H01 = "SELECT 'nation.parquet' AS file, true AS has_content"


def s12(s, d):
    """Indicators of each service recorded in two batches, read back."""
    top = scratch(s, "sli")
    rows = t(s, d, "events").select(F.concat(F.lit("svc"), F.col("user_id") % 4).alias("service_name"), (F.col("event_type") != "error").cast("long").alias("good_events"), F.lit(1).cast("long").alias("total_events"))
    half = rows.groupBy("service_name").agg(F.sum("good_events").alias("good_events"), F.sum("total_events").alias("total_events"))
    slo.record(half, top)
    slo.record(half, top)
    return s.read.parquet(top).groupBy("service_name").agg(F.count("*").alias("batches"), F.sum("good_events").alias("good_events"), F.sum("total_events").alias("total_events"))


S12 = "SELECT 'svc' || (user_id % 4) AS service_name, 2::BIGINT AS batches, (2 * count(*) FILTER (WHERE event_type <> 'error'))::BIGINT AS good_events, (2 * count(*))::BIGINT AS total_events FROM events GROUP BY 1"


def r17(s, d):
    """The dashboard of a project: its newest issues, with the counts of its summary."""
    made = h.dashboard(tracked(s, d), snapshots(s, d), "p1")
    total = made["summary"].select("project_path", "total_open", "total_confirmed")
    return made["recent_issues"].select("project_path", "issue_id", "first_detected").join(F.broadcast(total), "project_path")  # one row, of one project


R17 = f"""SELECT * FROM (SELECT project_path, issue_id, first_detected FROM {TRACKED} WHERE project_path = 'p1' ORDER BY first_detected DESC, issue_id LIMIT 100),
(SELECT count(*) FILTER (WHERE status = 'open') AS total_open, count(*) FILTER (WHERE status = 'confirmed') AS total_confirmed FROM {TRACKED} WHERE project_path = 'p1')"""

QUERIES = {
    "f07_schema_of": f07, "f12_avro_compatibility": f12, "f13_avro_validation": f13, "f14_proto_changes": f14, "f14_proto_problems": f14_problems, "f15_contract_changes": f15, "f08_ddl_keys": f08_keys, "f10_keys_diff": f10_keys, "h01_source_tree": h01, "r17_dashboard": r17, "s12_record": s12,
    "w07_link_health": w07_health, "w08_structured_data": w08, "w09_resource_types": w09, "w10_csp": w10, "w12_regions": w12,
}

ORACLES = {
    "f07_schema_of": F07, "f12_avro_compatibility": F12, "f13_avro_validation": F13, "f14_proto_changes": F14, "f14_proto_problems": F14_PROBLEMS, "f15_contract_changes": F15, "f08_ddl_keys": F08_KEYS, "f10_keys_diff": f"SELECT *, 'dropped' AS change FROM ({F08_KEYS}) WHERE kind = 'unique index'", "h01_source_tree": H01, "r17_dashboard": R17, "s12_record": S12,
    "w07_link_health": W07_HEALTH, "w08_structured_data": W08, "w09_resource_types": W09, "w10_csp": W10, "w12_regions": W12,
}
