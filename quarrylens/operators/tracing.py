"""Spans, traces, service maps and critical paths.

A span has trace_id, span_id, parent_span_id, seq (input order), service_name, operation_name, is_error, start_ns, end_ns and
duration_ms. Walks along parents have any length; they end where they close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarrylens.functions.numeric import ratio
from quarrylens.operators.quantiles import at_levels, grouped
from quarrylens.operators.series import settled, stored

#: Rows of a stored frame up to which percentiles keep all distinct values of a group in one buffer; reading it again is cheap.
STORED_ROWS = 1_000_000
SLOW_SPAN_MS, SLOW_TRACE_MS = 100.0, 1000.0


def span_analysis(spans: DataFrame, slow_ms: float = SLOW_SPAN_MS) -> DataFrame:
    """Children are found by span id over the whole batch."""
    children = spans.where(F.col("parent_span_id").isNotNull()).groupBy(F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("child_count"), F.sum("duration_ms").alias("total_child_duration_ms"))
    made = spans.join(children, "span_id", "left").withColumns({"child_count": F.coalesce("child_count", F.lit(0)), "total_child_duration_ms": F.coalesce("total_child_duration_ms", F.lit(0.0))})
    return made.withColumn("self_time_ms", F.greatest(F.lit(0.0), F.col("duration_ms") - F.col("total_child_duration_ms"))).withColumn("is_slow", F.col("duration_ms") > slow_ms).withColumn("slowness_factor", F.col("duration_ms") / slow_ms)


def slow_spans(spans: DataFrame, slow_ms: float = SLOW_SPAN_MS) -> DataFrame:
    """P3."""
    return spans.where(F.col("duration_ms") > slow_ms).orderBy(F.desc("duration_ms"), "seq")


def error_spans(spans: DataFrame) -> DataFrame:
    """P4."""
    return spans.where("is_error")


def span_statistics(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, total, mean, range, sigma and percentiles; over no spans zeros."""
    d, p = F.col("duration_ms"), {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = [F.count("*").alias("span_count"), zero(F.sum(d)).alias("total_ms"), zero(F.avg(d)).alias("mean_ms"), zero(F.min(d)).alias("min_ms"), zero(F.max(d)).alias("max_ms"), zero(F.stddev_pop(d)).alias("std_dev_ms")]
    made = grouped(spans, keys or [], d, list(p.values()), each)
    for k, n in enumerate(p):
        made = made.withColumn(n, zero(F.col("_p")[k]))
    return made.drop("_p")


def service_metrics(spans: DataFrame) -> DataFrame:
    """A row for each service (operation_name null) and for each of its operations, from one pass."""
    d = F.col("duration_ms")
    figures = [
        F.count("*").alias("request_count"), F.count_if(F.col("is_error")).alias("error_count"), F.sum(d).alias("total_duration_ms"), F.avg(d).alias("avg_duration_ms"),
        F.min(d).alias("min_duration_ms"), F.max(d).alias("max_duration_ms"), F.min("start_ns").alias("_a"), F.max("end_ns").alias("_z"),
    ]
    made = at_levels(spans, [["service_name", "operation_name"], ["service_name"]], d, [0.5, 0.95, 0.99], figures)
    period = F.greatest((F.col("_z") - F.col("_a")) / 1e9, F.lit(1.0))
    made = made.withColumn("error_rate", F.col("error_count") / F.col("request_count")).withColumn("throughput_per_second", F.col("request_count") / period).withColumn("is_total", F.col("_level") == 1)
    for k, n in enumerate(("p50", "p95", "p99")):
        made = made.withColumn(f"{n}_duration_ms", F.col("_p")[k])
    return made.drop("_level", "_p", "_a", "_z")


def traces(spans: DataFrame) -> DataFrame:
    """P10: the root is the first span without parent; a trace lasts as long as its root, else as its longest span."""
    root = F.when(F.col("parent_span_id").isNull(), F.struct("seq", "span_id", "duration_ms"))
    made = spans.groupBy("trace_id").agg(F.min(root).alias("_root"), F.count_distinct("service_name").alias("service_count"), F.count("*").alias("span_count"), F.count_if(F.col("is_error")).alias("error_count"), F.max("duration_ms").alias("_longest"))
    return made.select("trace_id", F.col("_root.span_id").alias("root_span_id"), "service_count", "span_count", "error_count", F.coalesce("_root.duration_ms", "_longest").alias("total_duration_ms"))


def health_score(error_rate: Column, p99: Column, slow_ms: float = SLOW_TRACE_MS, error_weight: float = 30.0, latency_weight: float = 20.0) -> Column:
    """P11. The error penalty is full at an error rate of one percent."""
    late = F.when(p99 > slow_ms * 5, latency_weight).when(p99 > slow_ms * 2, latency_weight / 2).when(p99 > slow_ms, latency_weight / 4).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.least(error_rate * 100 * error_weight, F.lit(30.0)) - late))


def apm_report(spans: DataFrame, slow_ms: float = SLOW_TRACE_MS) -> DataFrame:
    """One row over all traces."""
    figures = [
        F.count("*").alias("trace_count"), F.coalesce(F.sum("span_count"), F.lit(0)).alias("span_count"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("_e"), F.count_if(F.col("total_duration_ms") > slow_ms).alias("slow_traces"),
        F.count_if(F.col("error_count") > 0).alias("error_traces"), F.coalesce(F.avg("total_duration_ms"), F.lit(0.0)).alias("overall_avg_latency_ms"),
    ]
    t = stored(traces(spans).select("span_count", "error_count", "total_duration_ms"))  # walks over spans are not repeated by percentiles
    t = grouped(t, [], F.col("total_duration_ms"), [0.99], figures, STORED_ROWS).withColumn("overall_p99_latency_ms", F.coalesce(F.col("_p")[0], F.lit(0.0))).drop("_p")
    t = t.withColumn("overall_error_rate", ratio("_e", "span_count")).drop("_e")
    return t.withColumn("health_score", health_score(F.col("overall_error_rate"), F.col("overall_p99_latency_ms"), slow_ms))


def top_traces(spans: DataFrame, slow_ms: float = SLOW_TRACE_MS, errors: bool = False, n: int = 10) -> DataFrame:
    """The first n slow traces, or those with errors, by trace_id."""
    t = traces(spans)
    return t.where(F.col("error_count") > 0 if errors else F.col("total_duration_ms") > slow_ms).orderBy("trace_id").limit(n)


def _calls(spans: DataFrame) -> DataFrame:
    """source_service, target_service, is_error, duration_ms: calls between different services."""
    parents = spans.groupBy("span_id").agg(F.max_by("service_name", "seq").alias("source_service")).withColumnRenamed("span_id", "parent_span_id")
    calls = spans.where(F.col("parent_span_id").isNotNull()).join(parents, "parent_span_id").where(F.col("source_service") != F.col("service_name"))
    return calls.select("source_service", F.col("service_name").alias("target_service"), "is_error", "duration_ms")


def service_links(spans: DataFrame) -> DataFrame:
    """source_service, target_service (materialised) of the service map, without its figures."""
    return settled(_calls(spans).select("source_service", "target_service").distinct())


def service_map(spans: DataFrame) -> DataFrame:
    """Calls between different services. A span id means its last span, over all traces."""
    calls = stored(_calls(spans))  # the join with the parents is not repeated by percentiles
    made = grouped(calls, ["source_service", "target_service"], F.col("duration_ms"), [0.99], [F.count("*").alias("call_count"), F.count_if(F.col("is_error")).alias("error_count"), F.avg("duration_ms").alias("avg_latency_ms")], STORED_ROWS)
    return made.withColumn("p99_latency_ms", F.col("_p")[0]).drop("_p")


def roots_and_leaves(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """Services that nothing calls, and services that call nothing."""
    services = settled(spans.select("service_name").distinct())
    roots = services.join(edges.select(F.col("target_service").alias("service_name")).distinct(), "service_name", "left_anti").withColumn("kind", F.lit("root"))
    leaves = services.join(edges.select(F.col("source_service").alias("service_name")).distinct(), "service_name", "left_anti").withColumn("kind", F.lit("leaf"))
    return roots.unionByName(leaves)


def _child_ranks(spans: DataFrame, latest: bool) -> DataFrame:
    """trace_id, span_id (parent), next_id: the child that the critical path takes.

    The longest child; with latest, the child that ends last if that is strictly later than the longest one's end (P24). Ties
    go to the child that comes first.
    """
    kids = spans.where(F.col("parent_span_id").isNotNull())
    longest = F.max_by(F.struct("span_id", "end_ns"), F.struct("duration_ms", -F.col("seq")))
    made = kids.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(longest.alias("_l"), F.max_by(F.struct("span_id", "end_ns"), F.struct("end_ns", -F.col("seq"))).alias("_e"))
    pick = F.when(F.col("_e.end_ns") > F.col("_l.end_ns"), F.col("_e.span_id")).otherwise(F.col("_l.span_id")) if latest else F.col("_l.span_id")
    return made.select("trace_id", "span_id", pick.alias("next_id"))


def critical_paths(spans: DataFrame, latest: bool = False, fall_back: bool = False) -> DataFrame:
    """trace_id, depth (0 at the root), span_id along each trace's critical path.

    Each trace's chosen edges are gathered into a map, and the walk from the root folds over it, so a path of any length takes
    one shuffle by trace. fall_back starts traces without a parentless span at their earliest span.
    """
    root = F.min(F.when(F.col("parent_span_id").isNull(), F.struct("seq", "span_id")))["span_id"]
    if fall_back:
        root = F.coalesce(root, F.min(F.struct("start_ns", "seq", "span_id"))["span_id"])
    starts = spans.groupBy("trace_id").agg(root.alias("root")).where("root is not null")
    steps = _child_ranks(spans, latest).groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("span_id", "next_id"))).alias("_next"))

    def ahead(path: Column, last: Column) -> Column:
        """path, next: the span after the last one, null where the path ends or closes; past the end the fold does no look-ups."""
        follows = F.try_element_at("_next", last)
        return F.struct(path.alias("path"), F.when(~F.array_contains(path, follows), follows).alias("next"))

    walk = F.aggregate(
        F.sequence(F.lit(1), F.size("_next")),
        ahead(F.array(F.col("root").cast("string")), F.col("root")),
        lambda at, _: F.when(at["next"].isNull(), at).otherwise(ahead(F.concat(at["path"], F.array(at["next"])), at["next"])),
        lambda at: at["path"],
    )
    return starts.join(steps, "trace_id", "left").select("trace_id", F.posexplode(F.when(F.col("_next").isNull(), F.array("root")).otherwise(walk)).alias("depth", "span_id"))


def path_segments(spans: DataFrame, least_percent: float = 5.0) -> DataFrame:
    """Self time of each span on the critical path, kept from `least_percent` of the trace on, and for the root."""
    path = critical_paths(spans, latest=True, fall_back=True)
    on = path.join(spans, ["trace_id", "span_id"])
    length = spans.groupBy("trace_id").agg(((F.max("end_ns") - F.min("start_ns")) / 1e6).alias("trace_duration_ms"))
    nxt = F.coalesce(F.lead("duration_ms").over(W.partitionBy("trace_id").orderBy("depth")), F.lit(0.0))
    made = on.withColumn("contribution_ms", F.greatest(F.lit(0.0), F.col("duration_ms") - nxt)).join(length, "trace_id")
    made = made.withColumn("contribution_percent", ratio(100 * F.col("contribution_ms"), "trace_duration_ms"))
    return made.where((F.col("contribution_percent") >= least_percent) | (F.col("depth") == 0)).select("trace_id", "depth", "span_id", "service_name", "operation_name", "contribution_ms", "contribution_percent", "trace_duration_ms")


def parallel_opportunity(spans: DataFrame) -> DataFrame:
    """P25: for siblings that run one after the other, the shorter of each two."""
    kids = spans.where(F.col("parent_span_id").isNotNull())
    order = W.partitionBy("trace_id", "parent_span_id").orderBy("start_ns", "seq", "duration_ms")
    made = kids.withColumn("_s", F.lead("start_ns").over(order)).withColumn("_d", F.lead("duration_ms").over(order))
    save = F.when(F.col("_s") >= F.col("end_ns"), F.least("duration_ms", "_d")).otherwise(0.0)
    return made.groupBy("trace_id").agg(F.sum(save).alias("parallelization_opportunity_ms"))


def critical_path_results(spans: DataFrame) -> DataFrame:
    """A row for each trace: durations, bottleneck, opportunity."""
    seg = path_segments(spans)
    made = seg.groupBy("trace_id").agg(
        F.max("trace_duration_ms").alias("total_duration_ms"), F.sum("contribution_ms").alias("critical_path_duration_ms"), F.count("*").alias("segments"), F.max_by(F.struct("service_name", "operation_name"), F.struct("contribution_ms", -F.col("depth"))).alias("_b")
    )
    made = made.join(parallel_opportunity(spans), "trace_id", "left")
    return made.select("trace_id", "total_duration_ms", "critical_path_duration_ms", "segments", F.col("_b.service_name").alias("bottleneck_service"), F.col("_b.operation_name").alias("bottleneck_operation"), F.coalesce("parallelization_opportunity_ms", F.lit(0.0)).alias("parallelization_opportunity_ms"))


def common_bottlenecks(segments: DataFrame, n: int = 5) -> DataFrame:
    """P26."""
    return segments.groupBy("service_name", "operation_name").agg(F.avg("contribution_ms").alias("avg_contribution_ms")).orderBy(F.desc("avg_contribution_ms"), "service_name", "operation_name").limit(n)


def service_bottlenecks(segments: DataFrame) -> DataFrame:
    """P27."""
    c = F.col("contribution_ms")
    segments = stored(segments.select("service_name", "contribution_ms"))  # critical paths are not walked again by percentiles
    made = grouped(segments, ["service_name"], c, [0.5, 0.99], [F.sum(c).alias("total_contribution_ms"), F.avg(c).alias("avg_contribution_ms"), F.max(c).alias("max_contribution_ms"), F.count("*").alias("occurrence_count")], STORED_ROWS)
    return made.withColumn("p50_contribution_ms", F.col("_p")[0]).withColumn("p99_contribution_ms", F.col("_p")[1]).drop("_p")


def compare_traces(segments: DataFrame, a: str, b: str) -> DataFrame:
    """Operations whose share of two traces' critical paths differs by more than 1 ms. The last segment of an operation counts."""
    side = lambda t, n: segments.where(F.col("trace_id") == t).groupBy("service_name", "operation_name").agg(F.max_by("contribution_ms", "depth").alias(n))
    both = side(a, "time_a_ms").join(side(b, "time_b_ms"), ["service_name", "operation_name"], "full").fillna(0.0, ["time_a_ms", "time_b_ms"])
    made = both.withColumn("difference_ms", F.col("time_b_ms") - F.col("time_a_ms")).withColumn("change_percent", ratio(100 * F.col("difference_ms"), "time_a_ms"))
    return made.where(F.abs("difference_ms") > 1.0).orderBy(F.desc(F.abs("difference_ms")), "service_name", "operation_name")


@F.pandas_udf(LongType())
def chain_depth(ids, parents):
    """The longest chain of parents among the spans of each trace; a chain ends at a missing parent or where it closes."""
    import pandas as pd

    def longest(span_ids, parent_ids) -> int:
        parent = dict(zip(span_ids, parent_ids, strict=True))
        known: dict[str, int] = {}
        for span in parent:
            walk, on_walk = [], set()
            while span is not None and span in parent and span not in known and span not in on_walk:
                walk.append(span)
                on_walk.add(span)
                span = parent[span]
            if span in on_walk:  # a cycle: all spans on it have its length
                size = len(walk) - walk.index(span)
                for x in walk[-size:]:
                    known[x] = size
                walk = walk[:-size]
            base = known.get(span, 0)
            for k, x in enumerate(reversed(walk), 1):
                known[x] = base + k
        return max(known.values(), default=0)

    return pd.Series([longest(a, b) for a, b in zip(ids, parents, strict=True)], dtype="int64")


def trace_depths(spans: DataFrame) -> DataFrame:
    """Wall duration, services, errors and the longest chain of parents of each trace."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "span_id", "parent_span_id")))
    made = spans.groupBy("trace_id").agg(
        ((F.max("end_ns") - F.min("start_ns")) / 1e6).alias("total_duration_ms"), F.count_distinct("service_name").alias("service_count"), F.count("*").alias("span_count"), F.count_if(F.col("is_error")).alias("error_count"), ordered.alias("_s")
    )
    return made.withColumn("depth", chain_depth(F.col("_s.span_id"), F.col("_s.parent_span_id"))).drop("_s")


# Parsing of exported traces: one JSON document a row in column json.

OTLP = """struct<resourceSpans: array<struct<resource: struct<attributes: array<struct<key: string, value: struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>>>>,
  scopeSpans: array<struct<scope: struct<name: string>, spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string,
  status: struct<code: string, message: string>, attributes: array<struct<key: string, value: struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>>>>>>>>>>"""
_JAEGER = """array<struct<processes: map<string, struct<serviceName: string>>, spans: array<struct<traceID: string, spanID: string, operationName: string, processID: string, startTime: bigint, duration: bigint,
  references: array<struct<refType: string, spanID: string>>, tags: array<struct<key: string, value: string>>>>>>"""
JAEGER = f"struct<data: {_JAEGER}, traces: {_JAEGER}, {_JAEGER[len('array<struct<') : -2]}>"
ZIPKIN = "array<struct<traceId: string, id: string, parentId: string, name: string, kind: string, timestamp: bigint, duration: bigint, localEndpoint: struct<serviceName: string>, tags: map<string, string>>>"
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
SPAN_COLUMNS = ("trace_id", "span_id", "parent_span_id", "operation_name", "service_name", "start_ns", "end_ns", "duration_ms", "status_code", "kind", "is_error")


def _as_spans(df: DataFrame) -> DataFrame:
    return df.withColumn("is_error", F.col("status_code") == "ERROR").select(*SPAN_COLUMNS)


def attribute_value(value: Column) -> Column:
    """A typed attribute as text."""
    return F.coalesce(value["stringValue"], value["intValue"], value["boolValue"].cast("string"), value["doubleValue"].cast("string"))


def parse_otlp(df: DataFrame, json: str = "json") -> DataFrame:
    """P17."""
    rs = df.select(F.explode(F.from_json(json, OTLP)["resourceSpans"]).alias("r"))
    attr = lambda key: F.get(F.filter("r.resource.attributes", lambda a: a["key"] == key), F.lit(0))["value"]
    service = F.coalesce(attribute_value(attr("service.name")), attribute_value(attr("service_name")), F.lit("unknown"))
    spans = rs.select(service.alias("service_name"), F.explode("r.scopeSpans").alias("ss")).select("service_name", F.explode("ss.spans").alias("s"))
    code = F.col("s.status.code")
    status = F.when(code.isin("0", "UNSET"), "UNSET").when(code == "1", "OK").when(code == "2", "ERROR").when(code.rlike("^[0-9]+$"), "UNSET").otherwise(F.coalesce(code, F.lit("UNSET")))
    a, z = F.coalesce(F.col("s.startTimeUnixNano").cast("long"), F.lit(0)), F.coalesce(F.col("s.endTimeUnixNano").cast("long"), F.lit(0))
    kind = F.coalesce(F.get(F.array(*map(F.lit, KINDS)), F.coalesce("s.kind", F.lit(0))), F.lit("INTERNAL"))
    return _as_spans(spans.select(
        F.coalesce("s.traceId", F.lit("")).alias("trace_id"), F.coalesce("s.spanId", F.lit("")).alias("span_id"), F.nullif("s.parentSpanId", F.lit("")).alias("parent_span_id"), F.coalesce("s.name", F.lit("unknown")).alias("operation_name"),
        "service_name", a.alias("start_ns"), z.alias("end_ns"), ((z - a) / 1e6).alias("duration_ms"), status.alias("status_code"), kind.alias("kind")))


def parse_jaeger(df: DataFrame, json: str = "json") -> DataFrame:
    """P18."""
    j = F.from_json(json, JAEGER)
    docs = df.select(F.explode(F.coalesce(j["data"], j["traces"], F.array(F.struct(j["processes"].alias("processes"), j["spans"].alias("spans"))))).alias("d"))
    spans = docs.select("d.processes", F.explode("d.spans").alias("s"))
    last = lambda key: F.try_element_at(F.transform(F.filter("s.tags", lambda a: a["key"] == key), lambda a: a["value"]), F.lit(-1))
    parent = F.get(F.filter("s.references", lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]
    a, us = F.coalesce("s.startTime", F.lit(0)) * 1000, F.coalesce("s.duration", F.lit(0))
    status = F.when((last("error") == "true") | (last("otel.status_code") == "ERROR"), "ERROR").otherwise("UNSET")
    service = F.coalesce(F.try_element_at("processes", F.coalesce("s.processID", F.lit("p1")))["serviceName"], F.lit("unknown"))
    return _as_spans(spans.select(
        F.coalesce("s.traceID", F.lit("")).alias("trace_id"), F.coalesce("s.spanID", F.lit("")).alias("span_id"), parent.alias("parent_span_id"), F.coalesce("s.operationName", F.lit("unknown")).alias("operation_name"), service.alias("service_name"),
        a.alias("start_ns"), (a + us * 1000).alias("end_ns"), (us / 1000).alias("duration_ms"), status.alias("status_code"), F.coalesce(F.upper(last("span.kind")), F.lit("INTERNAL")).alias("kind")))


def parse_zipkin(df: DataFrame, json: str = "json") -> DataFrame:
    """P19."""
    spans = df.select(F.explode(F.from_json(json, ZIPKIN)).alias("s"))
    a, us = F.coalesce("s.timestamp", F.lit(0)) * 1000, F.coalesce("s.duration", F.lit(0))
    error = F.coalesce(F.try_element_at("s.tags", F.lit("error")), F.lit("")) != ""
    return _as_spans(spans.select(
        F.coalesce("s.traceId", F.lit("")).alias("trace_id"), F.coalesce("s.id", F.lit("")).alias("span_id"), F.col("s.parentId").alias("parent_span_id"), F.coalesce("s.name", F.lit("unknown")).alias("operation_name"),
        F.coalesce("s.localEndpoint.serviceName", F.lit("unknown")).alias("service_name"), a.alias("start_ns"), (a + us * 1000).alias("end_ns"), (us / 1000).alias("duration_ms"), F.when(error, "ERROR").otherwise("UNSET").alias("status_code"), F.upper(F.coalesce("s.kind", F.lit("INTERNAL"))).alias("kind")))


def detect_format(json: str = "json") -> Column:
    """The format of a single span's JSON object, by its keys."""
    keys = F.json_object_keys(json)
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(keys, n))
    return F.when(has("traceId", "spanId", "startTimeUnixNano"), "otlp").when(has("traceId", "spanId", "startTime"), "jaeger").when(has("localEndpoint"), "zipkin").otherwise("generic")


def parse_generic(df: DataFrame, json: str = "json") -> DataFrame:
    """Spans with plain field names, one object a row."""
    f = lambda *names: F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))
    a, z = F.coalesce(f("start_time_unix_nano").cast("long"), F.lit(0)), F.coalesce(f("end_time_unix_nano").cast("long"), F.lit(0))
    return _as_spans(df.select(
        F.coalesce(f("trace_id", "traceId"), F.lit("")).alias("trace_id"), F.coalesce(f("span_id", "spanId"), F.lit("")).alias("span_id"), f("parent_span_id", "parentSpanId").alias("parent_span_id"), F.coalesce(f("operation_name", "name"), F.lit("unknown")).alias("operation_name"),
        F.coalesce(f("service_name"), F.lit("unknown")).alias("service_name"), a.alias("start_ns"), z.alias("end_ns"), F.coalesce(f("duration_ms").cast("double"), (z - a) / 1e6).alias("duration_ms"), F.coalesce(f("status_code", "status"), F.lit("UNSET")).alias("status_code"), F.coalesce(f("kind"), F.lit("INTERNAL")).alias("kind")))


def parse_spans(df: DataFrame, json: str = "json", extra: dict | None = None) -> DataFrame:
    """Single spans of mixed formats. extra maps further formats to (condition, parser from DataFrame to spans)."""
    kind = detect_format(json)
    for name, (condition, _) in (extra or {}).items():
        kind = F.when(condition, name).otherwise(kind)
    marked = df.withColumn("_format", kind)
    wrap = {
        "otlp": lambda d: parse_otlp(d.select(F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":['), json, F.lit("]}]}]}")).alias(json)), json),
        "jaeger": lambda d: parse_jaeger(d.select(F.concat(F.lit('{"spans":['), json, F.lit("]}")).alias(json)), json),
        "zipkin": lambda d: parse_zipkin(d.select(F.concat(F.lit("["), json, F.lit("]")).alias(json)), json),
        "generic": lambda d: parse_generic(d, json),
    } | {name: parser for name, (_, parser) in (extra or {}).items()}
    made = None
    for name, parser in wrap.items():
        part = parser(marked.where(F.col("_format") == name))
        made = part if made is None else made.unionByName(part)
    return made
