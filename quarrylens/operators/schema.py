"""JSON Schema validation as expressions, catalogue differences, and generated rows."""

from __future__ import annotations

import functools
import json as _json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.text import FORMATS, kind_of_schema


class _Recursive(Exception):
    """A schema that refers to itself has no finite expression."""


def _resolved(ref: str, root: dict) -> dict:
    for part in ref.lstrip("#/").split("/"):
        root = root[part.replace("~1", "/").replace("~0", "~")]
    return root


def _canonical(value: object) -> Column:
    return F.to_json(F.parse_json(F.lit(_json.dumps(value))))


#: Keyword of a string, number, array or object -> is a value (as string, double, array or map) in breach of it.
_BOUNDS = {
    "string": {"minLength": lambda x, v: F.length(x) < v, "maxLength": lambda x, v: F.length(x) > v, "pattern": lambda x, v: ~x.rlike(v)},
    "number": {
        "minimum": lambda x, v: x < v, "maximum": lambda x, v: x > v, "exclusiveMinimum": lambda x, v: x <= v,
        "exclusiveMaximum": lambda x, v: x >= v, "multipleOf": lambda x, v: x % v != 0,
    },
    "array": {"minItems": lambda x, v: F.size(x) < v, "maxItems": lambda x, v: F.size(x) > v},
    "object": {"minProperties": lambda x, v: F.size(x) < v, "maxProperties": lambda x, v: F.size(x) > v},
}
_AS = {"string": "string", "number": "double", "array": "array<variant>", "object": "map<string,variant>"}

#: A value (one of _bound) -> the numbers of the keywords that it breaks.
Check = Callable[[Column], Column]


def _bound(values: Column) -> Column:
    """Variants, missing ones left out, each with its JSON type and as array and object (null if it is none). Each step is taken once
    for a value, however often the checks below refer to it; written into one another they would grow with a power of the depth."""
    typed = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("of")))
    kinds = F.transform(typed, lambda x: F.struct(x["v"].alias("v"), kind_of_schema(x["of"]).alias("kind")))
    as_ = lambda x, kind: F.when(x["kind"] == kind, F.try_variant_get(x["v"], "$", _AS[kind])).alias(kind)
    return F.transform(kinds, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), as_(x, "array"), as_(x, "object")))


def _of(x: Column, kind: str) -> Column:
    """A value as one of a JSON type; null if it is of another."""
    if kind in ("array", "object"):
        return x[kind]
    is_kind = x["kind"].isin("integer", "number") if kind == "number" else x["kind"] == kind
    return F.when(is_kind, F.try_variant_get(x["v"], "$", _AS[kind]))


def _passes(check: Check | None, x: Column) -> Column:
    return F.lit(True) if check is None else F.size(check(x)) == 0


def _checks(schema: dict | bool, path: str, root: dict, names: list[str], within: tuple[str, ...] = ()) -> Check | None:
    """The check of a schema, whose keywords are put to names in schema order; none if it has no keywords."""
    if isinstance(schema, bool):
        if schema:
            return None
        names.append(f"{path}:false")
        return lambda x, n=len(names) - 1: F.array(F.lit(n))
    if "$ref" in schema:
        if schema["$ref"] in within:
            raise _Recursive(schema["$ref"])
        return _checks(_resolved(schema["$ref"], root), path, root, names, (*within, schema["$ref"]))
    own: list[Check] = []
    nested: list[Check] = []

    def add(bad: Callable[[Column], Column], name: str) -> None:
        own.append(lambda x, n=len(names): F.when(bad(x), F.lit(n)))
        names.append(f"{path}:{name}")

    def below(sub: dict | bool, at: str, into: list[str] | None = None) -> Check | None:
        return _checks(sub, at, root, names if into is None else into, within)

    def each(get: Callable[[Column], Column], sub: dict | bool, at: str) -> None:
        """The check of the values of an array that get makes of a value."""
        check = below(sub, at)
        if check is not None:
            nested.append(lambda x: F.coalesce(F.flatten(F.transform(_bound(get(x)), check)), F.array().cast("array<int>")))

    kinds = schema.get("type")
    if kinds:
        wanted = {kinds} if isinstance(kinds, str) else set(kinds)
        wanted |= {"integer"} if "number" in wanted else set()
        add(lambda x: ~x["kind"].isin(*wanted), "type")
    if "enum" in schema:
        add(lambda x: ~F.to_json(x["v"]).isin(*map(_canonical, schema["enum"])), "enum")
    if "const" in schema:
        add(lambda x: F.to_json(x["v"]) != _canonical(schema["const"]), "const")
    for kind, words in _BOUNDS.items():
        for word, breaks in words.items():
            if word in schema:
                add(lambda x, kind=kind, word=word, breaks=breaks: breaks(_of(x, kind), schema[word]), word)
    if schema.get("format") in dict(FORMATS):
        add(lambda x: ~_of(x, "string").rlike("(?i)" + dict(FORMATS)[schema["format"]]), "format")
    items, entries = (lambda x: _of(x, "array")), (lambda x: F.map_entries(_of(x, "object")))
    keys = lambda x: F.map_keys(_of(x, "object"))
    if schema.get("uniqueItems"):
        add(lambda x: F.size(items(x)) != F.size(F.array_distinct(F.transform(items(x), lambda i: F.to_json(i)))), "uniqueItems")
    if isinstance(schema.get("items"), list):
        listed, rest = schema["items"], schema.get("additionalItems", True)
        for k, sub in enumerate(listed):
            each(lambda x, k=k: F.array(F.get(items(x), k)), sub, f"{path}[{k}]")
        if rest is False:
            add(lambda x: F.size(items(x)) > len(listed), "additionalItems")
        elif isinstance(rest, dict):
            each(lambda x: F.slice(items(x), F.lit(len(listed) + 1), F.greatest(F.size(items(x)) - len(listed), F.lit(0))), rest, f"{path}[]")
    elif "items" in schema:
        each(items, schema["items"], f"{path}[]")
    if "contains" in schema:
        held = below(schema["contains"], path, [])
        add(lambda x: ~F.exists(_bound(items(x)), lambda i: _passes(held, i)), "contains")
    properties, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
    for name in schema.get("required", []):
        add(lambda x, name=name: ~F.array_contains(keys(x), name), f"required.{name}")
    for name, sub in properties.items():
        each(lambda x, name=name: F.array(F.try_element_at(_of(x, "object"), F.lit(name))), sub, f"{path}.{name}")
    for pattern, sub in patterns.items():
        each(lambda x, p=pattern: F.transform(F.filter(entries(x), lambda e: e["key"].rlike(p)), lambda e: e["value"]), sub, f"{path}./{pattern}/")
    known = lambda key: key.isin(*properties) if properties else F.lit(False)
    other = lambda key: ~functools.reduce(lambda a, p: a | key.rlike(p), patterns, known(key))
    if schema.get("additionalProperties") is False:
        add(lambda x: F.exists(keys(x), other), "additionalProperties")
    elif isinstance(schema.get("additionalProperties"), dict):
        each(lambda x: F.transform(F.filter(entries(x), lambda e: other(e["key"])), lambda e: e["value"]), schema["additionalProperties"], f"{path}.*")
    if "propertyNames" in schema:
        each(lambda x: F.transform(keys(x), lambda k: k.cast("variant")), schema["propertyNames"], f"{path}:propertyNames")
    nested.extend(c for c in [below(sub, path) for sub in schema.get("allOf", [])] if c is not None)
    if "anyOf" in schema:
        subs = [below(sub, path, []) for sub in schema["anyOf"]]
        add(lambda x: ~functools.reduce(lambda a, c: a | _passes(c, x), subs, F.lit(False)), "anyOf")
    if "oneOf" in schema:
        ones = [below(sub, path, []) for sub in schema["oneOf"]]
        add(lambda x: functools.reduce(lambda a, c: a + _passes(c, x).cast("int"), ones, F.lit(0)) != 1, "oneOf")
    if "not" in schema:
        no = below(schema["not"], path, [])
        add(lambda x: _passes(no, x), "not")
    if not own and not nested:
        return None
    return lambda x: F.concat(F.array_compact(F.array(*(check(x) for check in own), F.lit(None).cast("int"))), *(check(x) for check in nested))


def _violations(schema: dict | bool, value: object, path: str, root: dict) -> Iterator[str]:
    """What _checks finds, on a parsed value: the way of schemas that refer to themselves."""
    if isinstance(schema, bool):
        yield from () if schema else (f"{path}:false",)
        return
    if "$ref" in schema:
        yield from _violations(_resolved(schema["$ref"], root), value, path, root)
        return
    ok = lambda sub, x: next(_violations(sub, x, path, root), None) is None
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else {str: "string", list: "array", dict: "object"}[type(value)]
    kinds = schema.get("type")
    if kinds and kind not in (wanted := [kinds] if isinstance(kinds, str) else kinds) and not (kind == "integer" and "number" in wanted):
        yield f"{path}:type"
    same = lambda x: _json.dumps(x, sort_keys=True) == _json.dumps(value, sort_keys=True)
    if "enum" in schema and not any(map(same, schema["enum"])):
        yield f"{path}:enum"
    if "const" in schema and not same(schema["const"]):
        yield f"{path}:const"
    size = len(value) if isinstance(value, (str, list, dict)) else 0
    bounds = {
        "string": {"minLength": lambda v: size < v, "maxLength": lambda v: size > v, "pattern": lambda v: not re.search(v, value)},
        "number": {"minimum": lambda v: value < v, "maximum": lambda v: value > v, "exclusiveMinimum": lambda v: value <= v, "exclusiveMaximum": lambda v: value >= v, "multipleOf": lambda v: value % v != 0},
        "array": {"minItems": lambda v: size < v, "maxItems": lambda v: size > v}, "object": {"minProperties": lambda v: size < v, "maxProperties": lambda v: size > v},
    }
    yield from (f"{path}:{word}" for word, breaks in bounds.get("number" if kind == "integer" else kind, {}).items() if word in schema and breaks(schema[word]))
    if kind == "string" and (form := dict(FORMATS).get(schema.get("format"))) and not re.search(form, value, re.IGNORECASE):
        yield f"{path}:format"
    if kind == "array":
        if schema.get("uniqueItems") and len({_json.dumps(x, sort_keys=True) for x in value}) < size:
            yield f"{path}:uniqueItems"
        listed, rest = (schema["items"], schema.get("additionalItems", True)) if isinstance(schema.get("items"), list) else ([], schema.get("items", True))
        for k, x in enumerate(value):
            if k >= len(listed) and rest is False and listed:
                yield f"{path}:additionalItems"
                break
            yield from _violations(listed[k] if k < len(listed) else rest, x, f"{path}[{k}]" if k < len(listed) else f"{path}[]", root)
        if "contains" in schema and not any(ok(schema["contains"], x) for x in value):
            yield f"{path}:contains"
    if kind == "object":
        properties, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        yield from (f"{path}:required.{n}" for n in schema.get("required", []) if n not in value)
        for name, sub in properties.items():
            yield from _violations(sub, value[name], f"{path}.{name}", root) if name in value else ()
        for pattern, sub in patterns.items():
            for name in (n for n in value if re.search(pattern, n)):
                yield from _violations(sub, value[name], f"{path}./{pattern}/", root)
        others = [n for n in value if n not in properties and not any(re.search(p, n) for p in patterns)]
        if schema.get("additionalProperties") is False and others:
            yield f"{path}:additionalProperties"
        elif isinstance(schema.get("additionalProperties"), dict):
            for name in others:
                yield from _violations(schema["additionalProperties"], value[name], f"{path}.*", root)
        for name in value if "propertyNames" in schema else ():
            yield from _violations(schema["propertyNames"], name, f"{path}:propertyNames", root)
    for sub in schema.get("allOf", []):
        yield from _violations(sub, value, path, root)
    if "anyOf" in schema and not any(ok(sub, value) for sub in schema["anyOf"]):
        yield f"{path}:anyOf"
    if "oneOf" in schema and sum(ok(sub, value) for sub in schema["oneOf"]) != 1:
        yield f"{path}:oneOf"
    if "not" in schema and ok(schema["not"], value):
        yield f"{path}:not"


def validate(df: DataFrame, schema: dict, json: str = "json") -> DataFrame:
    """the columns of df, is_valid, and errors: path and keyword of each violation, each once, comma-joined in schema order.

    The schema becomes one expression over the text as VARIANT, in which each value is taken apart once, so JSON types are told apart as they are written ("42" is a
    string). A schema that refers to itself, to any depth, is followed in Arrow batches instead. Text that is no JSON, or null, is one error.
    """
    names: list[str] = []
    try:
        check = _checks(schema, "$", schema, names)
    except _Recursive:

        @F.pandas_udf("array<string>")
        def walked(texts):
            def errors(text):
                try:
                    return list(dict.fromkeys(_violations(schema, _json.loads(text), "$", schema)))
                except (ValueError, TypeError):
                    return ["$:json"]

            return texts.map(errors, na_action=None)

        found = walked(json)
    else:
        v = F.col("_v")
        broken = F.flatten(F.transform(_bound(F.array(v)), check)) if check else F.array().cast("array<int>")
        named = F.transform(F.array_sort(F.array_distinct(broken)), lambda n: F.get(F.array(*map(F.lit, names), F.lit(None).cast("string")), n))
        df, found = df.withColumn("_v", F.try_parse_json(json)), F.when(v.isNull(), F.array(F.lit("$:json"))).otherwise(F.array_distinct(named))
    return df.withColumn("errors", F.array_join(found, ",")).withColumn("is_valid", F.col("errors") == "").drop("_v")


_TYPES = {T.StringType: "string", T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "number", T.DoubleType: "number", T.DecimalType: "number"}


def schema_of(kind: T.DataType) -> dict:
    """the JSON Schema of a Spark type."""
    if isinstance(kind, T.StructType):
        out = {"type": "object", "properties": {f.name: schema_of(f.dataType) for f in kind}}
        required = [f.name for f in kind if not f.nullable]
        return out | ({"required": required} if required else {})
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": schema_of(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": schema_of(kind.valueType)}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date-time"}
    if isinstance(kind, T.DateType):
        return {"type": "string", "format": "date"}
    return {"type": _TYPES.get(type(kind), "string")}


#: Tokens of SQL: comments, single marks, runs of anything else with strings and quoted names in them, of up to 100 pieces.
_SQL_TOKEN = r"(?s)--[^\n]*|/\*.*?\*/|[(),;]|(?:[^-/'\"`\[(),;]++|'(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"|`[^`]*+`|\[[^\]]*+\]|-(?!-)|/(?!\*)){1,100}+|."
#: Marks that the lexer puts in: end of a statement, start and end of its outermost parentheses, comma in these.
_END, _OPEN, _CLOSE, _COMMA = "\u0001", "\u0002", "\u0003", "\u0004"
_NAME = r'(?:\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[^\]]*\]|[^\s"`\[(),.;\x02]+)'


def lexed(sql: Column) -> Column:
    """SQL text without comments, in which only what parts statements and columns is marked: a fold over its tokens keeps the depth
    of parentheses, so that commas and semicolons inside strings, quoted names and nested parentheses part nothing."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state, x):
        depth, out = state["depth"], state["out"]
        put = F.when(x.startswith("--") | x.startswith("/*"), F.lit(" ")).when((x == ";") & (depth == 0), F.lit(_END)).when((x == "(") & (depth == 0), F.lit(_OPEN)).when((x == ")") & (depth == 1), F.lit(_CLOSE)).when((x == ",") & (depth == 1), F.lit(_COMMA)).otherwise(x)
        new = F.when(x == "(", depth + 1).when(x == ")", F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        return F.struct(new.alias("depth"), F.concat(out, put).alias("out"))

    clean = F.regexp_replace(sql, "[\u0001-\u0004]", " ")
    return F.aggregate(F.regexp_extract_all(clean, F.lit(_SQL_TOKEN), F.lit(0)), start, step, lambda s: s["out"])


def unquoted(name: Column) -> Column:
    """A name of one or more parts without its quotes; doubled quotes inside are one."""
    part = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')).when(x.rlike(r"^[`\[]"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(_NAME), F.lit(0)), part), ".")


def parse_ddl(df: DataFrame, ddl: str = "ddl") -> DataFrame:
    """F8: table_name, position, column_name, column_type, not_null, of the CREATE TABLE statements in a column of SQL text."""
    one = df.select(F.explode(F.split(lexed(F.col(ddl)), _END)).alias("s"))
    head = rf"(?is)^\s*create\s+(?:\w+\s+)*?table\s+(?:if\s+not\s+exists\s+)?({_NAME}(?:\s*\.\s*{_NAME})*)\s*{_OPEN}([^{_CLOSE}]*)"
    made = one.where(F.col("s").rlike(head)).select(unquoted(F.regexp_extract("s", head, 1)).alias("table_name"), F.posexplode(F.split(F.regexp_extract("s", head, 2), _COMMA)).alias("position", "c"))
    cols = made.withColumn("c", F.trim(F.regexp_replace("c", r"^\s+|\s+$", ""))).where(~F.col("c").rlike(r"(?i)^(primary|foreign|unique|constraint|check|index|key)\b") & (F.col("c") != ""))
    kind = F.regexp_extract("c", rf"(?s)^{_NAME}\s+(\w+(?:\s?\([^)]*\))?)", 1)
    bare = F.regexp_replace("c", r"'(?:[^']|'')*+'", "''")
    return cols.select("table_name", "position", unquoted(F.regexp_extract("c", f"^{_NAME}", 0)).alias("column_name"), F.upper(F.regexp_replace(kind, r"\s+", " ")).alias("column_type"), bare.rlike(r"(?i)\bnot\s+null\b|\bprimary\s+key\b").alias("not_null"))


def ddl_keys(df: DataFrame, ddl: str = "ddl") -> DataFrame:
    """F8: kind (foreign key, index, unique index), table_name, key_columns, and what a foreign key points at (target_table,
    target_columns) or an index is called (index_name), of the statements in a column of SQL text."""
    one = df.select(F.explode(F.split(F.regexp_replace(ddl, r"--[^\n]*", ""), ";")).alias("s"))
    tidy = lambda c: F.regexp_replace(F.trim(c), r"\s*,\s*", ",")
    name = r'["`\[]?([\w.]+)["`\]]?'
    table = F.regexp_extract("s", rf"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?{name}", 1)
    apart, inline = rf"(?is)foreign\s+key\s*\(([^)]*)\)\s*references\s+{name}\s*\(([^)]*)\)", rf'(?is)(?<=[(,])\s*["`\[]?(\w+)["`\]]?[^,()]*(?:\([^)]*\))?[^,()]*\sreferences\s+{name}\s*\(([^)]*)\)'
    tables = one.where(F.col("s").rlike(r"(?is)create\s+table")).select(table.alias("table_name"), "s")

    def foreign(pattern: str, texts: DataFrame) -> DataFrame:
        each = texts.select("table_name", F.explode(F.regexp_extract_all("s", F.lit(pattern), 0)).alias("k"))
        lone = pattern.replace("(?<=[(,])", "")
        return each.select(F.lit("foreign key").alias("kind"), "table_name", tidy(F.regexp_extract("k", lone, 1)).alias("key_columns"), F.regexp_extract("k", lone, 2).alias("target_table"), tidy(F.regexp_extract("k", lone, 3)).alias("target_columns"), F.lit(None).cast("string").alias("index_name"))

    index = rf"(?is)create\s+(unique\s+)?index\s+(?:if\s+not\s+exists\s+)?{name}\s+on\s+{name}\s*\(([^)]*)\)"
    indexes = one.where(F.col("s").rlike(index)).select(
        F.when(F.regexp_extract("s", index, 1) != "", "unique index").otherwise("index").alias("kind"), F.regexp_extract("s", index, 3).alias("table_name"), tidy(F.regexp_extract("s", index, 4)).alias("key_columns"),
        F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("target_columns"), F.regexp_extract("s", index, 2).alias("index_name"),
    )
    without = tables.withColumn("s", F.regexp_replace("s", apart, "x"))
    return foreign(apart, tables).unionByName(foreign(inline, without)).unionByName(indexes)


def keys_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """keys and indexes (as ddl_keys gives them) added or dropped between two catalogues."""
    by = ["kind", "table_name", "key_columns", "target_table", "target_columns", "index_name"]
    counted = old.select(*by, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(new.select(*by, F.lit(0).alias("_old"), F.lit(1).alias("_new"))).groupBy(*by).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return counted.where("_old <> _new").withColumn("change", F.when(F.col("_new") == 1, "added").otherwise("dropped")).drop("_old", "_new")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """columns (table_name, column_name, column_type) added, dropped or modified between two catalogues."""
    a = old.select("table_name", "column_name", F.col("column_type").alias("old_type"))
    b = new.select("table_name", "column_name", F.col("column_type").alias("new_type"))
    both = a.join(b, ["table_name", "column_name"], "full").where(~F.col("old_type").eqNullSafe(F.col("new_type")))
    return both.withColumn("change", F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped").otherwise("modified"))


def endpoint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, method, parameter, required of two contracts -> breaking changes: a removed endpoint or parameter, a new required parameter, one made required."""
    a, b = old.select("path", "method", "parameter", F.col("required").alias("was")), new.select("path", "method", "parameter", F.col("required").alias("now"))
    gone = a.select("path", "method").distinct().join(b.select("path", "method").distinct(), ["path", "method"], "left_anti").withColumn("parameter", F.lit(None).cast("string")).withColumn("change", F.lit("endpoint removed"))
    kept = a.select("path", "method").distinct().join(b.select("path", "method").distinct(), ["path", "method"])
    both = a.where("parameter is not null").join(b.where("parameter is not null"), ["path", "method", "parameter"], "full").join(kept, ["path", "method"])
    change = F.when(F.col("now").isNull(), "parameter removed").when(F.col("was").isNull() & F.col("now"), "required parameter added").when(~F.col("was") & F.col("now"), "parameter made required")
    return gone.unionByName(both.withColumn("change", change).where("change is not null").select("path", "method", "parameter", "change"))


#: From -> to types that a reader may widen (fixed values of the Avro specification).
AVRO_PROMOTIONS = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"}, "string": {"bytes"}, "bytes": {"string"}}


def avro_incompatibilities(writer: object, reader: object, path: str = "$") -> list[str]:
    """why a reader's schema cannot read what a writer's schema wrote."""
    if isinstance(writer, list):
        return [e for w in writer for e in avro_incompatibilities(w, reader, path)]
    if isinstance(reader, list):
        tried = [avro_incompatibilities(writer, r, path) for r in reader]
        return [] if any(not t for t in tried) else [f"{path}: no branch of the reader's union fits"]
    w = writer if isinstance(writer, dict) else {"type": writer}
    r = reader if isinstance(reader, dict) else {"type": reader}
    a, b = w["type"], r["type"]
    if a != b:
        return [] if b in AVRO_PROMOTIONS.get(a, ()) else [f"{path}: {a} is not readable as {b}"]
    out: list[str] = []
    if a in ("record", "enum", "fixed"):
        full = lambda x: ".".join(filter(None, (x.get("namespace"), x.get("name"))))
        if full(w) != full(r) and not {full(w), w.get("name")} & set(r.get("aliases", [])):
            out.append(f"{path}: {full(w)} is not the reader's {full(r)}, nor an alias of it")
    if a == "record":
        fields = {f["name"]: f for f in w.get("fields", [])}
        for f in r.get("fields", []):
            names = [f["name"], *f.get("aliases", [])]
            match = next((fields[n] for n in names if n in fields), None)
            if match is not None:
                out += avro_incompatibilities(match["type"], f["type"], f"{path}.{f['name']}")
            elif "default" not in f:
                out.append(f"{path}.{f['name']}: missing, without default")
    elif a == "array":
        out += avro_incompatibilities(w["items"], r["items"], f"{path}[]")
    elif a == "map":
        out += avro_incompatibilities(w["values"], r["values"], f"{path}{{}}")
    elif a == "enum" and "default" not in r:
        out += [f"{path}: symbol {s} is unknown to the reader" for s in w.get("symbols", []) if s not in r.get("symbols", [])]
    elif a == "fixed" and w.get("size") != r.get("size"):
        out.append(f"{path}: sizes differ")
    return out


def avro_compatibility(df: DataFrame, old: str = "old_schema", new: str = "new_schema") -> DataFrame:
    """F12 over rows of schema pairs: backward (new reads old), forward (old reads new), full."""

    @F.pandas_udf("struct<backward:boolean,forward:boolean>")
    def verdict(a, b):
        import pandas as pd

        rows = [(_json.loads(x), _json.loads(y)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"backward": [not avro_incompatibilities(x, y) for x, y in rows], "forward": [not avro_incompatibilities(y, x) for x, y in rows]})

    return df.withColumn("_v", verdict(old, new)).select("*", "_v.backward", "_v.forward", (F.col("_v.backward") & F.col("_v.forward")).alias("full")).drop("_v")


def avro_problems(schema: object, path: str = "$") -> list[str]:
    """structure, names and defaults of an Avro schema."""
    primitive = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}
    if isinstance(schema, list):
        return [p for s in schema for p in avro_problems(s, path)]
    if isinstance(schema, str):
        return [] if schema in primitive or schema[:1].isupper() or "." in schema else [f"{path}: unknown type {schema}"]
    kind, out = schema.get("type"), []
    if kind in ("record", "enum", "fixed") and not str(schema.get("name", "")).replace("_", "a").isidentifier():
        out.append(f"{path}: bad or missing name")
    if kind == "record":
        names = [f.get("name") for f in schema.get("fields", [])]
        out += [f"{path}.{n}: twice" for n in {n for n in names if names.count(n) > 1}]
        for f in schema.get("fields", []):
            out += avro_problems(f.get("type", "?"), f"{path}.{f.get('name')}")
            if f.get("default", 0) is None and not (f.get("type") == "null" or isinstance(f.get("type"), list) and f["type"][0] == "null"):
                out.append(f"{path}.{f.get('name')}: null default of a type that is not null first")
    elif kind == "enum":
        symbols = schema.get("symbols", [])
        out += [f"{path}: no symbols"] * (not symbols) + [f"{path}: symbols repeat"] * (len(set(symbols)) < len(symbols))
    elif kind == "array":
        out += avro_problems(schema.get("items", "?"), f"{path}[]")
    elif kind == "map":
        out += avro_problems(schema.get("values", "?"), f"{path}{{}}")
    elif kind == "fixed":
        out += [] if isinstance(schema.get("size"), int) else [f"{path}: no size"]
    elif isinstance(kind, (dict, list)):
        out += avro_problems(kind, path)
    elif kind not in primitive:
        out.append(f"{path}: unknown type {kind}")
    return out


def avro_validation(df: DataFrame, avro: str = "avro") -> DataFrame:
    """F13 over rows of schemas: problems, comma-joined, and is_valid."""

    @F.pandas_udf("string")
    def found(texts):
        def one(text):
            try:
                return ",".join(avro_problems(_json.loads(text)))
            except (ValueError, TypeError):
                return "$: no JSON"

        return texts.map(one, na_action=None)

    return df.withColumn("problems", found(avro)).withColumn("is_valid", F.col("problems") == "")


def proto_fields(df: DataFrame, proto: str = "proto") -> DataFrame:
    """message_name, field_number, field_name, field_type, label, of the top-level messages in a column of protobuf text."""
    clean = F.regexp_replace(F.regexp_replace(proto, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    messages = df.select(F.explode(F.regexp_extract_all(clean, F.lit(r"(?s)message\s+\w+\s*\{[^{}]*\}"), 0)).alias("m"))
    fields = messages.select(F.regexp_extract("m", r"message\s+(\w+)", 1).alias("message_name"), F.explode(F.regexp_extract_all("m", F.lit(r"(?:repeated |optional |required )?[\w.]+\s+\w+\s*=\s*\d+"), 0)).alias("f"))
    return fields.select("message_name", F.regexp_extract("f", r"=\s*(\d+)", 1).cast("int").alias("field_number"), F.regexp_extract("f", r"(\w+)\s*=", 1).alias("field_name"), F.regexp_extract("f", r"([\w.]+)\s+\w+\s*=", 1).alias("field_type"), F.coalesce(F.nullif(F.regexp_extract("f", r"^(repeated|optional|required) ", 1), F.lit("")), F.lit("singular")).alias("label"))


def proto_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """fields (as proto_fields gives them) removed, or whose type, label or name changed under their number."""
    a = old.select("message_name", "field_number", F.struct("field_name", "field_type", "label").alias("a"))
    b = new.select("message_name", "field_number", F.struct("field_name", "field_type", "label").alias("b"))
    both = a.join(b, ["message_name", "field_number"], "full")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a.field_type") != F.col("b.field_type"), "type changed").when(F.col("a.label") != F.col("b.label"), "label changed").when(F.col("a.field_name") != F.col("b.field_name"), "renamed")
    return both.withColumn("change", change).where("change is not null").select("message_name", "field_number", "change", F.col("change").isin("removed", "type changed", "label changed").alias("is_breaking"))


def proto_problems(fields: DataFrame) -> DataFrame:
    """numbers used twice, out of range or reserved by the format."""
    n = F.col("field_number")
    counted = fields.groupBy("message_name", "field_number").agg(F.count("*").alias("uses"))
    problem = F.when(F.col("uses") > 1, "number used twice").when((n < 1) | (n > 536870911), "number out of range").when(n.between(19000, 19999), "number reserved")
    return counted.withColumn("problem", problem).where("problem is not null").select("message_name", "field_number", "problem")


def mock_rows(spark: SparkSession, schema: dict, n: int, seed: int = 42) -> DataFrame:
    """F16: n rows for an object schema, the same for the same seed and any number of partitions."""
    h = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1 << 40))

    def value(name: str, s: dict) -> Column:
        lo, hi = s.get("minimum", 0), s.get("maximum", 1000)
        if "enum" in s:
            return F.element_at(F.array(*map(F.lit, s["enum"])), (h(name) % len(s["enum"]) + 1).cast("int"))
        kind, form, low = s.get("type"), s.get("format"), name.lower()
        if kind == "integer":
            return F.lit(int(lo)) + h(name) % (int(hi) - int(lo) + 1)
        if kind == "number":
            return F.lit(float(lo)) + h(name) / float(1 << 40) * (hi - lo)
        if kind == "boolean":
            return h(name) % 2 == 0
        if kind == "array":
            return F.transform(F.sequence(F.lit(1), F.lit(s.get("minItems", 3))), lambda i: F.concat(F.lit(name), i.cast("string")))
        if form == "date-time":
            return F.date_format(F.timestamp_seconds(1_700_000_000 + h(name) % 31_536_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if form == "date":
            return F.date_format(F.timestamp_seconds(1_700_000_000 + h(name) % 31_536_000), "yyyy-MM-dd")
        if form == "email" or "email" in low:
            return F.concat(F.lit("user"), h(name).cast("string"), F.lit("@example.com"))
        if form == "uuid":
            return F.regexp_replace(F.md5(F.concat_ws("-", F.lit(seed), F.lit(name), "id").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        if form == "uri" or "url" in low:
            return F.concat(F.lit("https://example.com/"), h(name).cast("string"))
        return F.concat(F.lit(f"{name}_"), h(name).cast("string"))

    return spark.range(n).select("id", *(value(k, s).alias(k) for k, s in schema["properties"].items()))
