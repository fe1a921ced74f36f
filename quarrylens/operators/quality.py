"""Code metrics from source texts, and roll-ups of debt, coverage, compliance and requirements.

Sources are parsed with Python's own parser in Arrow batches; every figure after that is an expression or an aggregate.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.graph import topological_levels

#: Weights of complexity, volume, lines and comments, by language (fixed values).
WEIGHTS = {"python": (0.23, 5.2, 16.2, 50.0), "java": (0.25, 5.5, 16.2, 50.0), "javascript": (0.20, 4.8, 16.2, 50.0)}
LEVELS = ((85, "excellent"), (70, "good"), (50, "moderate"), (25, "poor"))
#: Quarters of a horizon (fixed values).
QUARTERS = {"sprint": 0.2, "quarter": 1.0, "year": 4.0}
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_OPERATOR_NODES = (ast.If, ast.While, ast.For, ast.Return, ast.Yield)
FUNCTION_ROW = "name string, line_number int, cyclomatic int, cognitive int, loc int, halstead_volume double, comment_percentage double"
METHOD = "struct<name:string,complexity:int,attributes:array<string>,calls:array<string>>"
CLASS_ROW = f"class_name string, line_number int, bases array<string>, methods array<{METHOD}>, attributes array<string>, uses array<string>"


def decisions(node: ast.AST, plain: bool = False) -> int:
    """Decision points in a tree; plain leaves out conditions of comprehensions, assertions and cases."""
    n = 0
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + (0 if plain else len(x.ifs))
        elif not plain and isinstance(x, ast.Assert):
            n += 1
        elif not plain and isinstance(x, ast.Match):
            n += len(x.cases)
    return n


class Cognitive:
    """Cognitive complexity: breaks of the flow cost one more for each level they are nested in."""

    def __init__(self) -> None:
        self.in_sequence = False

    def all(self, nodes: list[ast.AST], depth: int) -> int:
        return sum(self.of(x, depth) for x in nodes)

    def inside(self, node: ast.AST, depth: int) -> int:
        return self.all(list(ast.iter_child_nodes(node)), depth)

    def of(self, x: ast.AST, depth: int) -> int:
        if isinstance(x, ast.If):
            n = 1 + depth + self.all(x.body, depth + 1)
            for y in x.orelse:
                if not isinstance(y, ast.If):
                    n += self.of(y, depth)
                    continue
                # A chain is followed one step; what its second step alone holds, other than a third, counts on this level.
                n += 1 + depth + self.all(y.body, depth + 1) + self.all([z for z in y.orelse if not isinstance(z, ast.If)], depth)
            return n
        if isinstance(x, (ast.For, ast.While)):
            return 1 + depth + self.all(x.body, depth + 1) + self.all(x.orelse, depth)
        if isinstance(x, ast.Try):
            return self.all(x.body, depth + 1) + sum(1 + depth + self.all(h.body, depth + 1) for h in x.handlers) + self.all(x.finalbody, depth)
        if isinstance(x, ast.BoolOp):
            first = 0 if self.in_sequence else 1 + depth
            self.in_sequence = True
            n = first + self.inside(x, depth)
            self.in_sequence = False
            return n
        if isinstance(x, (ast.Break, ast.Continue)):
            return 1 + depth
        if isinstance(x, ast.Lambda):
            return self.inside(x, depth + 1)
        if isinstance(x, (ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)):
            return 1 + depth + self.inside(x, depth + 1)
        if isinstance(x, ast.IfExp):
            return 1 + depth + self.inside(x, depth)
        if isinstance(x, ast.Match):
            return 1 + depth + sum(2 + depth + self.all(c.body, depth + 1) for c in x.cases)
        return self.inside(x, depth)


def halstead_volume(node: ast.AST) -> float:
    """Length times the logarithm of the vocabulary of operators and operands."""
    import math

    operators, operands = [], []
    for x in ast.walk(node):
        if isinstance(x, ast.Name):
            operands.append(x.id)
        elif isinstance(x, ast.Constant):
            operands.append(str(x.value))
        elif isinstance(x, (ast.BinOp, ast.UnaryOp, ast.BoolOp)):
            operators.append(type(x.op))
        elif isinstance(x, ast.Compare):
            operators.extend(map(type, x.ops))
        elif isinstance(x, _OPERATOR_NODES):
            operators.append(type(x))
    words = len(set(operators)) + len(set(operands))
    return (len(operators) + len(operands)) * math.log2(words) if words else 0.0


def _parsed(text: str | None) -> ast.AST | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def _functions(tree: ast.AST) -> Iterator[tuple]:
    for x in ast.walk(tree):
        if isinstance(x, FUNCTION):
            lines = (x.end_lineno or x.lineno) - x.lineno + 1
            doc = ast.get_docstring(x)
            share = min(100.0 * len(doc.split("\n")) / max(lines, 1), 100.0) if doc else 0.0
            yield x.name, x.lineno, 1 + decisions(x), Cognitive().inside(x, 0), lines, halstead_volume(x), share


def _dotted(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _classes(tree: ast.AST) -> Iterator[tuple]:
    for c in (x for x in ast.walk(tree) if isinstance(x, ast.ClassDef)):
        methods, attributes, uses = [], set(), set()
        for m in (x for x in c.body if isinstance(x, FUNCTION)):
            own = {x.attr for x in ast.walk(m) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self"}
            calls = {n for x in ast.walk(m) if isinstance(x, ast.Call) and (n := _dotted(x.func))}
            names = {x.name for x in c.body if isinstance(x, FUNCTION)}
            methods.append({"name": m.name, "complexity": 1 + decisions(m), "attributes": sorted(own - names), "calls": sorted(calls)})
            attributes |= own - names
            uses |= {n for n in calls if n[:1].isupper() and n != c.name}
        bases = [n for b in c.bases if (n := _dotted(b))]
        yield c.name, c.lineno, bases, methods, sorted(attributes), sorted(uses | set(bases))


def _extracted(sources: DataFrame, key: str, text: str, find, row: str) -> DataFrame:
    """key and the rows that find gives for each text; texts that do not parse give none."""
    names = [part.strip().split(" ")[0] for part in _columns(row)]

    def run(batches):
        import pandas as pd

        for batch in batches:
            made = [(k, *r) for k, t in zip(batch[key], batch[text], strict=True) if (tree := _parsed(t)) is not None for r in find(tree)]
            yield pd.DataFrame(made, columns=[key, *names])

    return sources.select(key, text).mapInPandas(run, f"{key} {dict(sources.dtypes)[key]}, {row}")


def _columns(row: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for k, c in enumerate(row):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(row[last:k])
            last = k + 1
    return [*parts, row[last:]]


def function_metrics(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Name, line, cyclomatic and cognitive complexity, lines, Halstead volume and share of documentation of each function."""
    return _extracted(sources, key, text, _functions, FUNCTION_ROW)


def class_rows(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Bases, methods (complexity, attributes, calls), attributes and used classes of each class."""
    return _extracted(sources, key, text, _classes, CLASS_ROW)


def class_metrics(classes: DataFrame, key: str = "path") -> DataFrame:
    """WMC, RFC, CBO, both lacks of cohesion, depth of inheritance and number of children of each class of class_rows.

    Classes are told apart by name; the depth goes through the deepest base, and counts a
    base that is not among them as one step. Pairs of
    methods are compared within their class, which one source file bounds.
    """
    attributes = F.transform("methods", lambda m: m["attributes"])
    n = F.size("methods")
    apart = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.size(F.filter(F.slice(attributes, i + 1, F.greatest(n - i, F.lit(0))), lambda x: ~F.arrays_overlap(x, F.element_at(attributes, i)))))
    pairs = n * (n - 1) / 2
    touched = F.aggregate(attributes, F.lit(0), lambda a, x: a + F.size(x))
    hs = (n - touched / F.size("attributes")) / (n - 1)
    made = classes.select(
        key, "class_name", F.aggregate("methods", F.lit(0), lambda a, m: a + m["complexity"]).alias("wmc"), F.size(F.array_distinct(F.flatten(F.concat(F.array(F.transform("methods", lambda m: m["name"])), F.transform("methods", lambda m: m["calls"]))))).alias("rfc"),
        F.size("uses").alias("cbo"), F.when(n >= 2, apart / pairs).otherwise(0.0).alias("lcom_ck"), F.when((n > 1) & (F.size("attributes") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), hs))).otherwise(0.0).alias("lcom_hs"),
    )
    edges = classes.select(F.explode("bases").alias("src"), F.col("class_name").alias("dst")).distinct()
    known = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    # A layer is the longest way from a class without bases; classes on a cycle of bases have none.
    depth = topological_levels(edges, known).select(F.col("node").alias("class_name"), F.col("layer").alias("dit"))
    children = edges.groupBy(F.col("src").alias("class_name")).agg(F.count("*").alias("noc"))
    return made.join(depth, "class_name", "left").join(children, "class_name", "left").withColumn("dit", F.coalesce("dit", F.lit(0))).withColumn("noc", F.coalesce("noc", F.lit(0)))


def maintainability(functions: DataFrame, language: str = "python") -> DataFrame:
    """The columns of functions with maintainability_index (0 to 100) and its level."""
    by_complexity, by_volume, by_lines, by_comments = WEIGHTS[language]
    volume, lines, comments = F.greatest(F.col("halstead_volume"), F.lit(1.0)), F.greatest(F.col("loc"), F.lit(1)), F.greatest(F.col("comment_percentage"), F.lit(0.1))
    raw = 171 - by_volume * F.log(volume) - by_complexity * F.col("cyclomatic") - by_lines * F.log(lines) + by_comments * F.sin(F.sqrt(2.4 * comments))
    made = functions.withColumn("maintainability_index", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    level = F.coalesce(*(F.when(F.col("maintainability_index") >= least, name) for least, name in LEVELS), F.lit("critical"))
    return made.withColumn("level", level)


def _benefit() -> Column:
    return F.sum(F.col("business_impact") * F.col("interest_rate"))


def debt_roi(items: DataFrame) -> DataFrame:
    """Effort, benefit, return and months to pay back by debt type, and over all (debt_type null), of items (debt_type, effort_hours, business_impact, interest_rate)."""
    made = items.rollup("debt_type").agg(F.grouping("debt_type").alias("_g"), F.sum("effort_hours").alias("effort_hours"), _benefit().alias("benefit"))
    made = made.where("_g = 1 or debt_type is not null").withColumn("roi", F.col("benefit") / F.greatest(F.col("effort_hours"), F.lit(0.1)))
    return made.withColumn("payback_months", F.when(F.col("roi") > 0, F.least(3 / F.col("roi"), F.lit(999.0))).otherwise(999.0)).drop("_g")


def debt_projection(items: DataFrame, horizon: str = "quarter") -> DataFrame:
    """Hours now and at the horizon, with each item's interest compounded by quarters."""
    hours = F.col("effort_hours")
    made = items.agg(F.coalesce(F.sum(hours), F.lit(0.0)).alias("current_hours"), F.coalesce(F.sum(hours * F.pow(1 + F.col("interest_rate"), F.lit(QUARTERS[horizon]))), F.lit(0.0)).alias("projected_hours"))
    return made.withColumn("growth_percentage", 100 * (F.col("projected_hours") - F.col("current_hours")) / F.greatest(F.col("current_hours"), F.lit(1.0)))


def most_indebted(items: DataFrame, n: int = 10) -> DataFrame:
    """The n files with most hours; ties by name."""
    return items.groupBy("file_path").agg(F.sum("effort_hours").alias("effort_hours")).orderBy(F.desc("effort_hours"), "file_path").limit(n)


def coverage_gaps(methods: DataFrame, tests: DataFrame) -> DataFrame:
    """Methods (name, full_name) that no test (name) names: not test_ and the name or full name (dots as underscores), nor
    either of them, among the names of tests with and without their test_."""
    lowered = F.lower("name")
    tested = F.when(F.col("name").startswith("test_"), F.lower(F.substring(F.col("name"), F.lit(6), F.length("name"))))
    names = tests.select(F.explode(F.array_compact(F.array(lowered, tested))).alias("_key")).distinct()
    full = F.replace(F.lower("full_name"), F.lit("."), F.lit("_"))
    keys = F.array(F.concat(F.lit("test_"), lowered), F.concat(F.lit("test_"), full), lowered, full)
    covered = methods.select("full_name", "name", F.explode(keys).alias("_key")).join(names, "_key", "left_semi").select("full_name", "name").distinct()
    return methods.join(covered, ["full_name", "name"], "left_anti")


def compliance(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings (rule, severity) rolled up to categories (category_id, category_name, rule; a row for each rule, or with a
    null rule for a category without): counts by severity and the grade, F to A; categories without findings have an A."""
    counted = findings.groupBy("rule").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")))
    made = categories.join(counted, "rule", "left").groupBy("category_id", "category_name").agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")))
    n = lambda s: F.col(f"{s}_count")
    grade = F.when(n("critical") > 0, "F").when(n("high") > 0, "D").when((n("medium") > 0) | (n("low") > 2), "C").when(n("low") > 0, "B").otherwise("A")
    return made.withColumn("grade", grade)


def overall_grade(graded: DataFrame) -> DataFrame:
    """The worst grade of all categories; A without any."""
    return graded.agg(F.coalesce(F.max("grade"), F.lit("A")).alias("overall_grade"), F.count("*").alias("categories"))


def parse_requirements(df: DataFrame, text: str = "text") -> DataFrame:
    """Package, version_spec and line of each requirement in texts of requirement files; comments and references to other files are left out."""
    lines = df.select(F.posexplode(F.split(text, "\n")).alias("_p", "_l")).select((F.col("_p") + 1).alias("line_number"), F.trim(F.regexp_replace("_l", r"^\s*(-e|--editable)\s+", "")).alias("_l"))
    lines = lines.where((F.col("_l") != "") & ~F.col("_l").rlike(r"^(#|-)")).withColumn("_l", F.trim(F.split(F.regexp_replace("_l", r"\[[^\]]*\]", ""), ";")[0]))
    spec = F.regexp_extract("_l", r"(===|~=|==|>=|<=|!=|>|<).*$", 0)
    return lines.select("line_number", F.lower(F.trim(F.regexp_replace("_l", r"(===|~=|==|>=|<=|!=|>|<).*$", ""))).alias("package"), F.nullif(F.trim(spec), F.lit("")).alias("version_spec")).where("package <> ''")


def requirement_issues(requirements: DataFrame, imports: DataFrame, standard: DataFrame, aliases: DataFrame) -> DataFrame:
    """Packages that are imported but not required (missing) or required but not imported (unused).

    requirements: package; imports: module; standard: module (of the standard library or the project itself); aliases: module,
    package (modules of another name than their package)."""
    used = imports.select(F.lower("module").alias("module")).groupBy("module").agg(F.count("*").alias("uses")).join(standard.select(F.lower("module").alias("module")).distinct(), "module", "left_anti")
    named = used.join(aliases.select(F.lower("module").alias("module"), F.lower("package").alias("_package")).distinct(), "module", "left")
    named = named.groupBy(F.coalesce("_package", "module").alias("package")).agg(F.sum("uses").alias("uses"))
    required = requirements.select(F.lower("package").alias("package")).distinct()
    missing = named.join(required, "package", "left_anti").select("package", F.lit("missing").alias("issue"), F.lit("error").alias("severity"), "uses")
    unused = required.join(named, "package", "left_anti").select("package", F.lit("unused").alias("issue"), F.lit("warning").alias("severity"), F.lit(0).cast("long").alias("uses"))
    return missing.unionByName(unused)


def new_code(files: DataFrame, reference: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """Path, state (new or modified) of the files (path, hash, modified_at) that belong to the new-code period.

    Against a reference (path, hash: the tree at the last analysis, at the branch point or at a version) a file is new if it was
    not there and modified if its hash differs. Without one, files modified at or after `since` count as modified; without that, none."""
    if reference is not None:
        made = files.join(reference.select("path", F.col("hash").alias("_was"), F.lit(True).alias("_there")), "path", "left")
        state = F.when(F.col("_there").isNull(), "new").when(~F.col("hash").eqNullSafe(F.col("_was")), "modified")
        return made.select("path", state.alias("state")).where("state is not null")
    if since is None:
        return files.where(F.lit(False)).select("path", F.lit("modified").alias("state"))
    return files.where(F.col("modified_at") >= F.lit(since).cast("timestamp_ntz")).select("path", F.lit("modified").alias("state"))
