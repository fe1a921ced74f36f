"""Hand-worked cases of the operators: empty groups, constants, ties, cycles, open ends."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import anomaly, calculators, clones, graph, history, quality, quantiles, schema, slo, stats, text, tracing, trend, web
from quarrylens.plans import record_queries
from quarrylens.sources import readers

SPAN = "trace_id string, span_id string, parent_span_id string, seq long, service_name string, operation_name string, is_error boolean, start_ns long, end_ns long, duration_ms double"


def series(spark, values, key="m"):
    return spark.createDataFrame([(key, k, None if v is None else float(v)) for k, v in enumerate(values)], "metric string, seq long, value double")


def test_percentiles_interpolate(spark):
    r = stats.percentile_summary(series(spark, [10, 20, 30, 40, None]), ["metric"]).first()
    assert (r.sample_count, r.median, r.p75, r.mean) == (4, 25.0, 32.5, 25.0) and abs(r.std_dev - 125**0.5) < 1e-9
    with pytest.raises(ValueError):
        stats.single_percentile(series(spark, [1]), ["metric"], 101)


def test_apdex_bounds_are_inclusive(spark):
    r = stats.apdex(series(spark, [500, 500.1, 2000, 2000.1]), ["metric"]).first()
    assert (r.satisfied_count, r.tolerating_count, r.frustrated_count, r.score, r.rating) == (1, 2, 1, 0.5, "Poor")


def test_histogram_keeps_empty_buckets(spark):
    got = {r.label: r.n for r in stats.histogram(series(spark, [10, 10.5, 99999]), ["metric"]).collect()}
    assert len(got) == 11 and got["<=10"] == 1 and got["10-25"] == 1 and got[">10000"] == 1 and got["25-50"] == 0


def test_anchored_windows_start_again_after_a_gap(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:{s:02d}", 1.0) for m, s in ((0, 10), (0, 50), (1, 9), (1, 10), (5, 0), (5, 59))]
    df = spark.createDataFrame(rows, "k int, t string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = [(str(r.window_start)[11:], r.sample_count) for r in stats.anchored_windows(df, ["k"]).orderBy("window_start").collect()]
    assert got == [("00:00:10", 3), ("00:01:10", 1), ("00:05:00", 2)]


def test_constant_series_has_no_trend_and_no_anomaly(spark):
    df = series(spark, [5] * 20)
    r = stats.index_trend(df, ["metric"], "seq").first()
    assert (r.slope, r.confidence, r.direction, r.anomalies_detected) == (0.0, 0.0, "stable", 0)
    assert anomaly.detect_zscore(df, ["metric"], "seq", "seq").count() == 0 and anomaly.change_points(df, ["metric"], "seq").count() == 0


def test_baseline_severity_is_the_greater_string(spark):
    base = anomaly.baseline(series(spark, [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]), ["metric"])
    far = series(spark, [100])
    plain = anomaly.detect_with_baseline(far, base, ["metric"], "seq", "seq").first()
    assert plain.severity == "critical"
    near = anomaly.detect_with_baseline(series(spark, [28]), base, ["metric"], "seq", "seq").first()
    ranked = anomaly.detect_with_baseline(series(spark, [28]), base, ["metric"], "seq", "seq", ranked=True).first()
    assert near.severity == "medium" and ranked.severity == "high" or near.severity == ranked.severity


def test_t_p_values(spark):
    df = spark.createDataFrame([(2.0, 100.0), (2.228, 10.0), (0.0, 5.0), (1.0, 0.0)], "t double, d double")
    got = [r[0] for r in df.select(anomaly.t_p_value("t", "d")).collect()]
    assert abs(got[0] - 0.0455) < 1e-3 and abs(got[1] - 0.05) < 0.02 and got[3] == 1.0


def test_regression_needs_two_samples(spark):
    df = spark.createDataFrame([("m", 1.0, False), ("m", 9.0, True), ("x", 1.0, False)], "metric string, value double, after boolean")
    got = anomaly.regressions(df, ["metric"], "value", F.col("after")).collect()
    assert len(got) == 1 and got[0].p_value == 1.0 and not got[0].is_regression and got[0].quick_check


def test_forecast_of_a_line(spark):
    df = spark.createDataFrame([("m", f"2024-01-{d:02d}", float(d)) for d in range(1, 15)], "metric string, d string, value double").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    got = trend.linear_forecast(df, ["metric"]).orderBy("step").collect()
    assert [round(r.predicted_value, 6) for r in got] == [float(d) for d in range(15, 22)] and round(got[0].model_fit, 6) == 1.0
    assert trend.linear_forecast(df.where("value < 9"), ["metric"]).count() == 0


def test_open_incident_is_not_reported(spark):
    rows = [("s", f"2024-01-01 0{h}:00:00", c, w) for h, (c, w) in enumerate([(False, True), (True, False), (False, False), (False, True), (False, True)])]
    df = spark.createDataFrame(rows, "name string, t string, is_critical boolean, is_warning boolean").withColumn("calculated_at", F.col("t").cast("timestamp_ntz"))
    got = slo.incidents(df, ["name"]).collect()
    assert [(str(r.started_at)[11:16], str(r.ended_at)[11:16], r.severity) for r in got] == [("00:00", "02:00", "critical")]


def test_budget_without_failures_allowed(spark):
    got = slo.budget_columns(spark.createDataFrame([(100.0, 10, 9), (100.0, 10, 10), (99.0, 0, 0)], "target double, total_events long, good_events long")).collect()
    assert [r.budget_consumed_percent for r in got] == [100.0, 0.0, 0.0] and got[0].status == "breached" and got[2].current_sli == 100.0


@pytest.fixture
def spans(spark):
    rows = [("t", "a", None, 0, "web", "GET", False, 0, 100, 100.0), ("t", "b", "a", 1, "api", "x", False, 0, 40, 40.0), ("t", "c", "a", 2, "db", "y", True, 40, 90, 40.0), ("t", "d", "gone", 3, "db", "z", False, 5, 6, 1.0), ("u", "p", "q", 4, "s", "o", False, 0, 5, 5.0), ("u", "q", "p", 5, "s", "o", False, 0, 9, 9.0)]
    return spark.createDataFrame(rows, SPAN)


def test_spans_with_missing_and_cyclic_parents(spans):
    depth = {r.trace_id: r.depth for r in tracing.trace_depths(spans).collect()}
    assert depth == {"t": 2, "u": 2}
    path = [(r.trace_id, r.span_id) for r in tracing.critical_paths(spans).orderBy("trace_id", "depth").collect()]
    assert path == [("t", "a"), ("t", "b")]
    latest = [r.span_id for r in tracing.critical_paths(spans, latest=True, fall_back=True).where("trace_id = 't'").orderBy("depth").collect()]
    assert latest == ["a", "c"] and tracing.critical_paths(spans, fall_back=True).where("trace_id = 'u'").count() == 2
    edges = {(r.source_service, r.target_service): r.call_count for r in tracing.service_map(spans).collect()}
    assert edges == {("web", "api"): 1, ("web", "db"): 1}
    assert tracing.parallel_opportunity(spans).where("trace_id = 't'").first().parallelization_opportunity_ms == 40.0
    self_time = {r.span_id: r.self_time_ms for r in tracing.span_analysis(spans).collect()}
    assert self_time["a"] == 20.0 and self_time["p"] == 0.0


def test_critical_path_of_any_length(spark):
    """A chain of 200 spans, and beside it a shorter one that closes on itself."""
    chain = [("t", f"s{k}", f"s{k - 1}" if k else None, k, "web", "x", False, k, 1000 - k, float(1000 - k)) for k in range(200)]
    side = [("t", "z0", "s199", 200, "web", "x", False, 0, 1, 1.0), ("t", "z1", "z0", 201, "web", "x", False, 0, 1, 1.0), ("t", "z0", "z1", 202, "web", "x", False, 0, 1, 1.0)]
    got = tracing.critical_paths(spark.createDataFrame(chain + side, SPAN)).orderBy("depth").collect()
    assert [r.span_id for r in got] == [f"s{k}" for k in range(200)] + ["z0", "z1"]
    assert tracing.path_segments(spark.createDataFrame(chain, SPAN), 0.0).count() == 200


def test_graph_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    assert sorted((r.path, r.severity) for r in graph.cycles(edges).collect()) == [([1, 2, 3, 1], "high"), ([5, 5], "critical")]
    assert {r.node: r.component for r in graph.strong_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    nodes = spark.createDataFrame([(k,) for k in (1, 4, 9)], "node int")
    assert {r.node: r.depth for r in graph.depths(edges, nodes).collect()} == {1: -1, 4: -1, 9: 0}


def test_cycles_of_any_length(spark):
    ring = [(k, (k + 1) % 9) for k in range(9)]
    edges = spark.createDataFrame([*ring, (2, 7), (8, 20), (20, 21), (21, 22)], "src int, dst int")
    got = sorted((r.path, r.severity) for r in graph.cycles(edges).collect())
    assert got == [([0, 1, 2, 3, 4, 5, 6, 7, 8, 0], "low"), ([0, 1, 2, 7, 8, 0], "medium")]


def test_walks_longer_than_a_hundred_levels(spark):
    n = 108
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)], "src int, dst int")
    nodes = spark.range(n + 1).select(F.col("id").cast("int").alias("node"))
    assert {r.node: r.layer for r in graph.topological_levels(chain, nodes).collect()} == {k: k for k in range(n + 1)}
    assert {r.node: r.distance for r in graph.shortest_paths(chain, 0).collect()} == {k: k for k in range(n + 1)}


def test_calculators(spark):
    one = spark.range(1)
    assert [one.select(calculators.human_bytes(F.lit(v))).first()[0] for v in (0, 1023, 1024, 5 * 1024**3)] == ["0.00 B", "1023.00 B", "1.00 KB", "5.00 GB"]
    vitals = calculators.web_vitals(spark.createDataFrame([(2500.0, 0.3), (None, None)], "lcp_ms double, cls double")).collect()
    assert (vitals[0].overall_rating, vitals[0].score) == ("poor", 60.0) and (vitals[1].overall_rating, vitals[1].score) == ("good", 100.0)
    assert one.select(calculators.optimal_pool_size(F.lit(2), F.lit(100.0))).first()[0] == 5


def test_human_bytes_round_halves_to_even(spark):
    one = spark.range(1)
    values = (972928, 677504, 972672, 973184, -972928)
    assert [one.select(calculators.human_bytes(F.lit(v))).first()[0] for v in values] == ["%.2f KB" % (v / 1024) for v in values]


def test_gate_passes_missing_metrics(spark):
    conditions = spark.createDataFrame([("rating", "le", "B", True), ("none", "gt", "1", True), ("dup", "le", "3", False)], "metric string, op string, threshold string, error_on_fail boolean")
    metrics = spark.createDataFrame([("p", "rating", "C"), ("q", "dup", "4"), ("q", "rating", "A")], "project string, metric string, value string")
    assert {r.project: r.status for r in history.quality_gate(conditions, metrics, "project").collect()} == {"p": "failed", "q": "warning"}


def test_json_schema(spark):
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"enum": ["x", "y"]}, "c": {"type": "array", "maxItems": 1, "uniqueItems": True}}, "additionalProperties": False}
    rows = ['{"a": 1, "b": "x"}', '{"a": 0}', '{"b": "z"}', '{"a": 1, "d": 2}', '{"a": "t"}', '{"a": 1, "c": [1, 1]}', "no json"]
    got = [r.errors for r in schema.validate(spark.createDataFrame([(r,) for r in rows], "json string"), s).collect()]
    assert got == ["", "$.a:minimum", "$:required.a,$.b:enum", "$:additionalProperties", "$.a:type", "$.c:maxItems,$.c:uniqueItems", "$:json"]


def test_json_types_and_nesting(spark):
    s = {
        "properties": {"a": {"type": "string"}, "n": {"type": "integer"}, "l": {"items": {"type": "integer"}, "contains": {"minimum": 5}}, "t": {"items": [{"type": "integer"}, {"type": "string"}], "additionalItems": False}},
        "patternProperties": {"^x_": {"type": "boolean"}}, "propertyNames": {"maxLength": 3}, "additionalProperties": {"type": "null"}, "not": {"required": ["bad"]}, "oneOf": [{"required": ["a"]}, {"required": ["n"]}],
    }
    rows = {
        '{"a": "42"}': "", '{"a": 42}': "$.a:type", '{"n": "42"}': "$.n:type", '{"n": 4.5}': "$.n:type", '{"a": "", "l": [1, 7]}': "", '{"a": "", "l": [1, "x"]}': "$.l[]:type", '{"a": "", "t": [1, 2, 3]}': "$.t:additionalItems,$.t[1]:type",
        '{"a": "", "x_1": true}': "", '{"a": "", "x_1": 1}': "$./^x_/:type", '{"a": "", "long": null}': "$:propertyNames:maxLength", '{"a": "", "q": 1}': "$.*:type", '{"a": "", "n": 1}': "$:oneOf", '{"n": 1, "bad": null}': "$:not", '[1]': "$:oneOf,$:not", "": "$:json",
    }
    frame = spark.createDataFrame([(r,) for r in (*rows, None)], "json string")
    got = {r.json: set(r.errors.split(",")) for r in schema.validate(frame, s).collect()}
    assert got == {k: set(v.split(",")) for k, v in rows.items()} | {None: {"$:json"}}
    # The same rules on parsed values, which schemas that refer to themselves take.
    again = schema.validate(frame, {"allOf": [s], "definitions": {"node": {"properties": {"next": {"$ref": "#/definitions/node"}}}}, "$defs": {}} | {"properties": {"next": {"$ref": "#/definitions/node"}}})
    assert {r.json: set(r.errors.split(",")) for r in again.collect()} == got


def test_json_schema_grows_with_its_depth(spark):
    """Not with a power of it: each value is taken apart once."""
    nested = lambda depth: {"type": "object", "properties": {"a": nested(depth - 1)}} if depth else {"type": "integer", "maximum": 5}
    text = lambda depth, x: '{"a":' * depth + x + "}" * depth
    frame = spark.createDataFrame([(text(4, "9"),), (text(4, "5"),), (text(3, "5"),), ('{"a": null}',)], "json string")
    made = {depth: schema.validate(frame, nested(depth)) for depth in (2, 4)}
    size = {depth: len(df._jdf.queryExecution().analyzed().toString()) for depth, df in made.items()}
    assert size[4] < 4 * size[2]
    assert [r.errors for r in made[4].collect()] == ["$.a.a.a.a:maximum", "", "$.a.a.a:type", "$.a:type"]


def test_json_schema_that_refers_to_itself(spark):
    s = {"$ref": "#/definitions/node", "definitions": {"node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "next": {"$ref": "#/definitions/node"}}}}}
    deep = '{"v": 1, "next": ' * 60 + '{"v": "x"}' + "}" * 60
    got = [r.errors for r in schema.validate(spark.createDataFrame([(deep,), ('{"v": 1, "next": {"v": 2}}',), ('{"next": {}}',), ("no json",), (None,)], "json string"), s).collect()]
    assert got == ["$" + ".next" * 60 + ".v:type", "", "$:required.v,$.next:required.v", "$:json", "$:json"]


def test_json_profile_by_type(spark):
    rows = [('{"k": "42", "l": [1, [true]], "o": {"d": 2}}',), ('{"k": 42, "o": {}}',), ('{"k": null}',), ("no json",), (None,)]
    got = {r.path: (r.presence_count, r.types, r.required) for r in text.json_profile(spark.createDataFrame(rows, "j string"), "j").collect()}
    assert got == {
        "$": (3, "object", True), "$.k": (3, "integer,null,string", True), "$.l": (1, "array", False), "$.l[]": (2, "array,integer", False), "$.l[][]": (1, "boolean", False), "$.o": (2, "object", False), "$.o.d": (1, "integer", False),
    }


def test_rules_anchored_at_lines(spark):
    rules = [{"rule_id": "todo", "pattern": "^TODO", "severity": "low", "cwe": "x"}, {"rule_id": "end", "pattern": ";$", "severity": "low", "cwe": "x"}]
    docs = spark.createDataFrame([(1, "first\nTODO second\nthird;\nlast"), (2, "a TODO"), (3, None)], "id long, text string")
    assert sorted((r.id, r.line_number, r.rule_id) for r in text.scan_rules(docs, "id", rules).collect()) == [(1, 2, "todo"), (1, 3, "end")]


def test_code_metrics(spark):
    source = """
class Base:
    def one(self):
        return self.x

class Child(Base):
    def two(self, n):
        \"\"\"A word.\"\"\"
        for i in range(n):
            if i and self.y or n:
                while i:
                    break
        return [k for k in n if k]

    def three(self):
        return self.z
"""
    frame = spark.createDataFrame([("a.py", source), ("bad.py", "def"), ("none.py", None)], "path string, text string")
    got = {r.name: (r.cyclomatic, r.cognitive, r.loc) for r in quality.function_metrics(frame).collect()}
    # for 1, if 2, while 3, break 4, comprehension 1
    assert got == {"one": (1, 0, 2), "two": (8, 11, 7), "three": (1, 0, 2)}
    classes = {r.class_name: r for r in quality.class_metrics(quality.class_rows(frame)).collect()}
    assert (classes["Child"].dit, classes["Base"].noc, classes["Child"].lcom_ck, classes["Child"].wmc) == (1, 1, 1.0, 9)


def test_percentiles_by_brackets(spark):
    """The way of groups that are too large for a buffer gives the numbers of the other: ties, constants, few values, nulls, no keys."""
    x = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double") / 7
    rows = spark.range(150_000).select(F.when(F.col("id") % 10 > 0, "a").when(F.col("id") % 20 == 0, "b").otherwise(F.lit(None)).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(4.0)).when(F.col("id") % 50 == 0, None).otherwise(x).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("few", 1.0), ("few", 3.0), ("null", None), ("one", -2.5)], "g string, v double"))
    qs = [0.0, 0.001, 0.25, 0.5, 0.95, 0.999, 1.0]
    for keys in (["g"], []):
        plain = {tuple(r[:-1]): r[-1] for r in quantiles.grouped(rows, keys, F.col("v"), qs, [F.count("*").alias("n")]).collect()}
        other = {tuple(r[:-1]): r[-1] for r in quantiles.grouped(rows, keys, F.col("v"), qs, [F.count("*").alias("n")], buffer_rows=10).collect()}
        assert plain.keys() == other.keys() and all(other[k] == (None if plain[k] is None else pytest.approx(plain[k], rel=1e-12)) for k in plain)


def test_long_series_in_parts(spark, monkeypatch):
    """Series that are cut into parts of their range get the same places and change points."""
    from quarrylens.operators import series as long_series

    x = F.pmod(F.xxhash64("id"), F.lit(977))
    rows = spark.range(3_000).select((F.col("id") % 3).alias("g"), F.timestamp_seconds(F.col("id") * x).cast("timestamp_ntz").alias("ts"), (x + F.when(F.col("id") > 1500, 900).otherwise(0)).cast("double").alias("value"), "id")
    rows = rows.dropDuplicates(["g", "ts"]).unionByName(spark.createDataFrame([(9, None, 1.0, -1), (None, None, 1.0, -2)], "g long, ts timestamp_ntz, value double, id long"))
    rows = rows.cache()

    def found():
        return (
            sorted((r.id, r.place) for r in long_series.numbered(rows, ["g"], "ts", "place").collect()),
            sorted((r.g, r["index"], round(r.magnitude, 6)) for r in anomaly.change_points(rows.where("g is not null"), ["g"], "ts", threshold=0.8).collect()),
            sorted((repr(r.g), round(r.slope, 9), r.data_points) for r in stats.index_trend(rows, ["g"], "ts").collect()),
        )

    whole = found()
    monkeypatch.setattr(long_series, "ORDERED_BYTES", -1)
    monkeypatch.setattr(anomaly, "STRETCH", 25)
    assert found() == whole and len(whole[1]) > 3


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_clone_families_against_plain_patterns(spark):
    import hashlib
    import re
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = text.blocks(docs, "doc_id")
    want = defaultdict(list)
    for r in found.collect():
        t = re.sub(r"\s+", " ", re.sub(r"([^\w\s])", r" \1 ", r.block)).strip(" ")
        for pattern, put in ((r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", "IDENT"), (r"\b\d+\.?\d*\b", "NUM"), ('"[^"]*"', "STR"), ("'[^']*'", "STR"), ("#.*$", ""), ("//.*$", ""), (r"\s+", "")):
            t = re.sub(pattern, put, t)
        want[hashlib.md5(t.encode()).hexdigest()].append(r.doc_id)
    got = {r.hash: (r.blocks, r.texts) for r in text.clone_families(found, "doc_id").collect()}
    assert len(got) > 0 and got == {k: (len(v), len(set(v))) for k, v in want.items() if len(v) >= 2}


def test_avro_and_proto(spark):
    old = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "int"}]}
    new = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"], "default": None}]}
    assert schema.avro_incompatibilities(old, new) == [] and schema.avro_incompatibilities(new, old) != []
    assert schema.avro_problems(new) == [] and schema.avro_problems({"type": "enum", "name": "E", "symbols": []}) != []
    a = schema.proto_fields(spark.createDataFrame([("message M { string a = 1; repeated int32 b = 2; } // x",)], "proto string"))
    b = schema.proto_fields(spark.createDataFrame([("message M { bytes a = 1; int32 c = 19001; int32 d = 19001; }",)], "proto string"))
    assert {(r.field_number, r.change) for r in schema.proto_changes(a, b).collect()} == {(1, "type changed"), (2, "removed"), (19001, "added")}
    assert {r.problem for r in schema.proto_problems(b).collect()} == {"number used twice"}


def test_text_and_web(spark):
    found = text.string_format(F.col("s"))
    rows = [("2024-01-05T10:00:00", "date-time"), ("2024-01-05", "date"), ("a@b.co", "email"), ("HTTPS://x", "uri"), ("1.2.3.4", "ipv4"), ("zz", None)]
    assert [r[0] for r in spark.createDataFrame([(r[0],) for r in rows], "s string").select(found).collect()] == [r[1] for r in rows]
    html = '<html><head><title>T</title><meta name="Description" content="d"><link rel="canonical" href="/x"></head><a href="#a">x</a><a href="mailto:a@b.c">y</a><a href="//other.org/z">z</a><a href="p?q=1"> <b>w</b> </a>'
    pages = spark.createDataFrame([(1, "https://site.org/dir/page", html), (2, "https://site.org", None)], "page_id int, url string, html string")
    tags = {r.page_id: r for r in web.meta_rules(web.meta_tags(pages)).collect()}
    assert tags[1].description == "d" and "canonical relative" in tags[1].issues and tags[2].title is None
    links = {r.position: (r.link_type, r.link_url) for r in web.link_types(web.links(pages, "page_id")).collect()}
    assert links == {0: ("anchor", "https://site.org/dir/page#a"), 1: ("mailto", "mailto:a@b.c"), 2: ("external", "https://other.org/z"), 3: ("internal", "https://site.org/dir/p?q=1")}
    mask = spark.createDataFrame([([1, 0, 1, 1, 0, 0], 3)], "m array<int>, w int").select(web.label_regions("m", "w")).first()[0]
    assert mask == [1, 0, 2, 1, 0, 0]


def test_near_clones_against_brute_force(spark):
    import random
    from collections import Counter
    from difflib import SequenceMatcher

    rng = random.Random(6)
    bases = [[rng.choice(["a", "7", "+", "(", ")", "=", "[", "]", ";", ":"]) for _ in range(40)] for _ in range(6)]
    rows = []
    for k in range(70):
        words = list(bases[k % 6])
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice("*/%&|<>!~^")
        rows.append((k, 1, " ".join(words[: rng.randrange(32, 41)])))
    df = spark.createDataFrame([*rows, (90, 1, rows[0][2])], "doc_id long, start_line int, block string")
    norm = {r.doc_id: r.tokens for r in df.select("doc_id", F.trim(F.regexp_replace(text.normalised(F.col("block")), r"\s+", " ")).alias("tokens")).collect()}
    held = Counter(x.replace(" ", "") for x in norm.values())
    ratio = lambda x, y: SequenceMatcher(None, norm[x].split(), norm[y].split()).ratio()
    want, used = [], set()
    ids = [doc for doc in sorted(norm) if norm[doc] and held[norm[doc].replace(" ", "")] == 1]
    for x in ids:
        if x in used:
            continue
        mine = [(y, r) for y in ids if y > x and y not in used and (r := ratio(x, y)) >= text.NEAR]
        used.update([x, *(y for y, _ in mine)])
        want.extend([(x, x, 1.0)] * bool(mine) + [(y, x, round(r, 9)) for y, r in mine])
    for batch in (clones.BATCH, 16):  # in one batch, and in batches of 16, 32 and 64
        got = sorted((r.doc_id, r.class_doc_id, round(r.similarity, 9)) for r in clones.near_clones(df, "doc_id", batch=batch).collect())
        assert len(want) > 20 and got == sorted(want)
    assert clones.near_clones(df.limit(0), "doc_id").count() == 0


def test_matched_runs_are_those_of_difflib():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    for _ in range(150):
        a = [rng.choice("aaaaab.,;") for _ in range(rng.randrange(1, 90))]
        b = [x if rng.random() < 0.8 else rng.choice("ab.,") for x in a][rng.randrange(2) :] or ["a"]
        total = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert clones.matched(a, b, 0) == total <= clones.common_subsequence(masks, len(a), b)
        assert clones.matched(a, b, total + 1) == -1 and clones.matched(a, b, total) == total


def test_tiles_of_blocks_against_difflib(monkeypatch):
    import random
    from difflib import SequenceMatcher

    import pandas as pd

    rng = random.Random(9)
    words = lambda n, rare: [rng.choice(rare) if rng.random() < 0.04 else rng.choice("IIIIIIII.,") for _ in range(n)]
    rare = [f"w{k}" for k in range(30)]
    bases = [words(n, rare if k % 3 else ["I"]) for k, n in enumerate([150, 198, 205, 240, 420, 260])]
    texts = []
    for k in range(48):
        x = list(bases[k % 6])
        for _ in range(rng.randrange(0, 40)):
            x[rng.randrange(len(x) * 8 * (k % 2) // 9, len(x))] = rng.choice([".", "I", *rare[:5]])
        texts.append(x[: len(x) - rng.randrange(0, 12)])
    table = pd.DataFrame({"place": range(len(texts)), "n": [len(x) for x in texts], "tokens": [" ".join(x) for x in texts]})
    want = [(a, b, r) for b in range(len(texts)) for a in range(b) if (r := SequenceMatcher(None, texts[a], texts[b]).ratio()) >= 0.85]
    assert any(len(texts[b]) >= 200 for _, b, _ in want) and any(len(texts[b]) < 200 for _, b, _ in want)
    assert sorted(clones.tile_pairs(table, table, 0.85)) == sorted(want)
    # Long blocks of the same few tokens are told apart without a sequence comparison; each pair took one before.
    texts = [words(250, ["I"]) for _ in range(60)]
    table = pd.DataFrame({"place": range(60), "n": 250, "tokens": [" ".join(x) for x in texts]})
    monkeypatch.setattr(clones, "common_subsequence", None)
    assert clones.tile_pairs(table, table, 0.85) == []


def test_first_runs_of_many_texts_at_once():
    import random

    import numpy as np

    rng = random.Random(12)
    for _ in range(30):
        y = [rng.choice([0, 0, 0, 0, 1, 2, 5, 9]) for _ in range(rng.randrange(1, 120))]
        texts = [[rng.choice([0, 0, 0, 1, 2, 3, 5]) for _ in range(rng.randrange(1, 150))] for _ in range(20)] + [y, [7]]
        sizes = np.array([len(x) for x in texts])
        got = clones.first_runs(np.array(y), np.concatenate([np.array(x) for x in texts]), np.cumsum(sizes) - sizes, sizes)
        for x, i, j, size in zip(texts, *got, strict=True):
            want = clones.longest_run(clones.places_of(y), x, 0, len(x), 0, len(y))
            assert size == want[2] and (not size or (i, j) == want[:2])


def test_blocks_with_common_words_against_difflib(monkeypatch):
    import random
    from difflib import SequenceMatcher

    import pandas as pd

    rng = random.Random(21)
    texts = []
    for n, share in ((60, 0.02), (180, 0.01), (199, 0.1), (230, 0.01), (320, 0.004), (320, 0.1), (560, 0.01)):
        rare = [f"r{k}" for k in range(12)]
        base = [rng.choice(rare) if rng.random() < share else rng.choice("IIIIIIIII.,") for _ in range(n)]
        for k in range(20):
            x = list(base)
            for _ in range(rng.randrange(0, n // 8 if n < 200 else 7)):  # near the end, near the beginning, or anywhere
                at = (rng.randrange(len(x) // 2, len(x)), rng.randrange(0, len(x) // 4), rng.randrange(len(x)))[k % 3]
                x[at : at + rng.randrange(2)] = [rng.choice(["I", ".", "!", rare[k % 12]])]
            texts.append(x)
    table = pd.DataFrame({"place": range(len(texts)), "n": [len(x) for x in texts], "tokens": [" ".join(x) for x in texts]}).sample(frac=1, random_state=3)
    want = [(a, b, r) for b in range(len(texts)) for a in range(b) if (r := SequenceMatcher(None, texts[a], texts[b]).ratio()) >= 0.85]
    assert sum(len(texts[b]) >= 200 for _, b, _ in want) > 20 and sum(len(texts[b]) < 200 for _, b, _ in want) > 50
    assert sorted(clones.tile_pairs(table, table, 0.85)) == sorted(want)
    assert sorted(clones.tile_pairs(table[:70], table[70:], 0.85)) == sorted(x for x in want if x[0] in set(table["place"][:70]) and x[1] in set(table["place"][70:]))
    # Long blocks that share only a few tokens and a short beginning are not taken in pairs; each pair was before.
    texts = [["I"] * 20 + ["."] * (k % 4 + 1) + [rng.choice("IIIIIIIII.,") for _ in range(250)] for k in range(60)]
    for x in texts:
        x[rng.randrange(40, 120)] = x[rng.randrange(150, 250)] = "!"
    table = pd.DataFrame({"place": range(60), "n": [len(x) for x in texts], "tokens": [" ".join(x) for x in texts]})
    monkeypatch.setattr(clones, "run_bound", None)
    assert clones.tile_pairs(table, table, 0.85) == []


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"timestamp": "2024-01-01T00:00:00", "value": 1.5}, {"value": 2}]}')
    assert [(r.seq, r.value) for r in readers.values_from_json(spark, str(tmp_path / "a.json")).collect()] == [(0, 1.5), (1, 2.0)]
    assert [r.value for r in readers.values_from_text(spark.createDataFrame([("1, 2,x",)], "s string"), "s").collect()] == [1.0, 2.0, None]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("x = 1\n")
    (tmp_path / "src" / "n.txt").write_text("no")
    assert [r.text for r in readers.source_tree(spark, str(tmp_path / "src")).collect()] == ["x = 1\n"]


def test_ddl_of_few_files_is_read_in_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id AS p_partkey", "1 AS p_size", "'b' AS p_brand", "concat('n', id) AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = record_queries.f08(spark, str(tmp_path))
    tasks = made.select("table_name", F.spark_partition_id().alias("task"))
    assert tasks.count() == 200 and tasks.select("task").distinct().count() > 1


def test_ddl_tokens_are_runs(spark):
    """Strings, quoted names, lone dashes and slashes stay in the run about them; only marks and comments are tokens of their own."""
    sql = "a-b/c 'x, y' \"q;\" `r` [s] -- t, u\n, /* ( */ v"
    got = spark.range(1).select(F.regexp_extract_all(F.lit(sql), F.lit(schema._SQL_TOKEN), F.lit(0))).first()[0]
    assert got == ["a-b/c 'x, y' \"q;\" `r` [s] ", "-- t, u", "\n", ",", " ", "/* ( */", " v"]


def test_roots_and_leaves_take_no_figures(spark, monkeypatch):
    """The links of the service map are enough; its percentiles are not worked out for them."""
    rows = [("t", "a", None, 0, "web", "x", False, 0, 1, 1.0), ("t", "b", "a", 1, "api", "x", False, 0, 1, 1.0), ("t", "c", "b", 2, "api", "x", False, 0, 1, 1.0), ("t", "d", "c", 3, "db", "x", False, 0, 1, 1.0)]
    spans = spark.createDataFrame(rows, SPAN)
    with monkeypatch.context() as m:
        m.setattr(tracing, "grouped", None)
        got = tracing.roots_and_leaves(spans, tracing.service_links(spans))
    assert {(r.service_name, r.kind) for r in got.collect()} == {("web", "root"), ("db", "leaf")}
    whole = tracing.service_map(spans).select("source_service", "target_service")
    assert whole.exceptAll(tracing.service_links(spans)).isEmpty() and whole.count() == 2


def counted_spans(spark):
    """9 traces of a session and two calls, and how many rows have been read of them."""
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    k, part = F.col("id") % 9, F.floor(F.col("id") / 9)
    spans = spark.range(27).select(F.udf(counted, "long").asNondeterministic()(F.col("id")).alias("seq"), k.cast("string").alias("trace_id"), F.concat_ws("_", part, k).alias("span_id"), F.when(part > 0, F.concat_ws("_", part - 1, k)).alias("parent_span_id"),
        F.concat(F.lit("s"), part).alias("service_name"), (k == 3).alias("is_error"), (F.col("id") * 1.5).alias("duration_ms"))
    return spans, read


def test_service_bottlenecks_read_segments_once(spark, monkeypatch):
    spans, read = counted_spans(spark)
    segments = spans.select("service_name", F.col("duration_ms").alias("contribution_ms"), "seq")
    want = sorted(map(tuple, tracing.service_bottlenecks(segments).collect()))
    before = read.value
    monkeypatch.setattr(tracing, "STORED_ROWS", 5)
    assert sorted(map(tuple, tracing.service_bottlenecks(segments.where("seq >= 0")).collect())) == want and read.value - before == 27


def test_service_map_joins_calls_once(spark, monkeypatch):
    spans, read = counted_spans(spark)
    want = sorted(map(tuple, tracing.service_map(spans).collect()))
    assert [w[:4] for w in want] == [("s0", "s1", 9, 1), ("s1", "s2", 9, 1)]
    before = read.value
    monkeypatch.setattr(tracing, "STORED_ROWS", 5)
    assert sorted(map(tuple, tracing.service_map(spans.where("seq >= 0")).collect())) == want and read.value - before == 2 * 27


def test_apm_report_gathers_traces_once(spark, monkeypatch):
    spans, read = counted_spans(spark)
    want = tracing.apm_report(spans).collect()
    before = read.value
    monkeypatch.setattr(tracing, "STORED_ROWS", 5)
    assert tracing.apm_report(spans.where("seq >= 0")).collect() == want and read.value - before == 27
