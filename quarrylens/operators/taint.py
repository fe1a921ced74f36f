"""Taint flows over source texts: facts of definitions, uses and calls from a parser, propagation by joins across functions and files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.graph import levels
from quarrylens.operators.series import stored

#: What brings in data from outside, by kind; first match wins (fixed values).
SOURCES = (
    ("request.args", "http_parameter"), ("request.form", "http_parameter"), ("request.json", "http_parameter"), ("request.data", "http_parameter"), ("request.GET", "http_parameter"),
    ("request.POST", "http_parameter"), ("request.values", "http_parameter"), ("request.params", "http_parameter"), ("request.cookies", "cookie"), ("request.headers", "header"),
    ("os.environ", "env_var"), ("os.getenv", "env_var"), ("environ.get", "env_var"), ("input", "user_input"), ("sys.argv", "command_line_arg"), ("args.parse_args", "command_line_arg"),
    ("parser.parse_args", "command_line_arg"), ("argparse.parse_args", "command_line_arg"),
)
#: Calls that must not get such data, by kind; first match wins (fixed values).
SINKS = (
    ("sql_query", ("cursor.execute", "cursor.executemany", "session.execute", "db.execute", "connection.execute", "conn.execute", "engine.execute", "db.query")),
    ("shell_command", ("os.system", "os.popen", "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output", "subprocess.check_call")),
    ("eval_exec", ("eval", "exec")),
    ("file_path", ("open", "pathlib.Path", "Path")),
    ("template_render", ("render_template", "template.render", "jinja2.Template", "Environment.get_template")),
    ("ldap_query", ("ldap.search", "ldap.search_s", "connection.search")),
    ("html_output", ("render", "make_response")),
    ("file_write", ("write", "writelines")),
    ("redirect", ("redirect", "HttpResponseRedirect")),
    ("log_output", ("logger.info", "logger.debug", "logger.warning", "logger.error", "logging.info", "logging.debug", "logging.warning", "logging.error")),
)
#: Severity, CWE and OWASP category of each kind (fixed values).
KINDS = {
    "sql_query": ("critical", "CWE-89", "A03:2021"), "shell_command": ("critical", "CWE-78", "A03:2021"), "eval_exec": ("critical", "CWE-95", "A03:2021"), "file_path": ("high", "CWE-22", "A01:2021"),
    "template_render": ("high", "CWE-94", "A03:2021"), "ldap_query": ("high", "CWE-90", "A03:2021"), "html_output": ("medium", "CWE-79", "A03:2021"), "file_write": ("medium", "CWE-73", "A01:2021"),
    "redirect": ("medium", "CWE-601", "A01:2021"), "log_output": ("medium", "CWE-117", "A09:2021"),
}
#: A call whose name holds one of these cleans what it returns (fixed values).
SANITISERS = (
    "sql.escape", "escape_string", "quote_plus", "escape", "sanitize", "sanitize_sql", "parameterize", "html.escape", "escape_html", "bleach.clean", "clean", "markupsafe.escape", "Markup.escape",
    "shlex.quote", "quote", "escape_shell", "validate", "validate_input", "sanitize_input", "clean_input",
)

FACT = "kind string, src string, dst string, name string, chain string, pos int, line int, scope string, beside array<string>"
MODULE = "<module>"
#: Facts from which on a frame is handed over; a frame for each text costs more than parsing it.
FRAME_ROWS = 10_000


def chain(node: ast.AST) -> str:
    """Names joined by dots; without what is no name."""
    if isinstance(node, ast.Attribute):
        inner = chain(node.value)
        return f"{inner}.{node.attr}" if inner else node.attr
    return node.id if isinstance(node, ast.Name) else ""


class Facts:
    """The facts of one text. A node is a version of a variable, a parameter, an argument, what a call returns, or what a function does."""

    def __init__(self, path: str):
        self.path, self.rows = path, []

    def add(self, kind: str, scope: str = "", **fields) -> None:
        self.rows.append({"kind": kind, "scope": scope, **fields})

    def module(self, tree: ast.Module) -> None:
        top = Scope(self, MODULE, "")
        top.body(tree.body)
        for name, k in top.versions.items():  # functions see what is left at the end
            self.add("edge", MODULE, src=top.node(name, k), dst=f"{self.path}::{MODULE}::{name}", line=0)

    def imported(self, x: ast.Import | ast.ImportFrom) -> None:
        base = ""
        if isinstance(x, ast.ImportFrom):
            around = self.path.removesuffix(".py").split("/")[: -x.level] if x.level else []
            base = ".".join([*around, *([x.module] if x.module else [])])
        for a in x.names:
            whole = isinstance(x, ast.Import)
            self.add("import", name=a.asname or a.name, chain=a.name if whole else base, src=None if whole else a.name, line=x.lineno)


class Scope:
    """One function or the top of a text, in the order of its statements."""

    def __init__(self, facts: Facts, name: str, cls: str):
        self.facts, self.name, self.cls, self.versions = facts, name, cls, {}

    def node(self, name: str, k: int | str) -> str:
        return f"{self.facts.path}::{self.name}::{name}#{k}"

    def function(self, x: ast.FunctionDef | ast.AsyncFunctionDef, cls: str) -> None:
        inner = Scope(self.facts, f"{cls}.{x.name}" if cls else x.name, cls)
        names = [a.arg for a in (*x.args.posonlyargs, *x.args.args)]
        skip = int(bool(cls) and names[:1] in (["self"], ["cls"]))
        for pos, name in enumerate(names + [a.arg for a in x.args.kwonlyargs]):
            inner.versions[name] = 0
            self.facts.add("param", inner.name, dst=inner.node(name, 0), name=name, pos=pos - skip if pos < len(names) else -1, line=x.lineno)
        inner.body(x.body)

    def body(self, statements: list[ast.stmt]) -> None:
        for s in statements:
            self.statement(s)

    def statement(self, s: ast.stmt) -> None:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(s, "")
        elif isinstance(s, ast.ClassDef):
            for y in s.body:
                if isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    self.function(y, s.name)
                else:
                    self.statement(y)
        elif isinstance(s, (ast.Import, ast.ImportFrom)):
            self.facts.imported(s)
        elif isinstance(s, ast.Assign):
            self.assign(s.targets, s.value, s.lineno)
        elif isinstance(s, (ast.AnnAssign, ast.AugAssign)) and s.value is not None:
            self.assign([s.target], s.value, s.lineno, adds=isinstance(s, ast.AugAssign))
        elif isinstance(s, ast.Return) and s.value is not None:
            self.flow(s.value, f"{self.facts.path}::{self.name}::return", s.lineno)
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            self.assign([s.target], s.iter, s.lineno)
            self.body([*s.body, *s.orelse])
        else:
            for field in ast.iter_child_nodes(s):
                self.part(field)

    def part(self, x: ast.AST) -> None:
        if isinstance(x, ast.stmt):
            self.statement(x)
        elif isinstance(x, ast.withitem) and x.optional_vars is not None:
            self.assign([x.optional_vars], x.context_expr, x.context_expr.lineno)
        elif isinstance(x, ast.expr):
            self.uses(x)
        else:  # handlers, cases
            for y in ast.iter_child_nodes(x):
                self.part(y)

    def assign(self, targets: list[ast.expr], value: ast.expr, line: int, adds: bool = False) -> None:
        names = [n.id for t in targets for n in ([t] if isinstance(t, ast.Name) else t.elts if isinstance(t, (ast.Tuple, ast.List)) else []) if isinstance(n, ast.Name)]
        through = chain(value.func) if isinstance(value, ast.Call) and not adds else None
        found = self.uses(value)
        for name in names:
            old = self.versions.get(name)
            self.versions[name] = new = 0 if old is None else old + 1
            at = self.node(name, new)
            if old is not None:
                self.facts.add("edge", self.name, src=self.node(name, old), dst=at, chain=through, line=line)
            self.link(found, at, line, through, name)

    def flow(self, value: ast.expr, at: str, line: int) -> None:
        self.link(self.uses(value), at, line, chain(value.func) if isinstance(value, ast.Call) else None, "")

    def link(self, found: tuple[list[str], list[str]], at: str, line: int, through: str | None, name: str) -> None:
        for src in found[0]:
            self.facts.add("edge", self.name, src=src, dst=at, chain=through, line=line)
        for c in found[1]:
            self.facts.add("source", self.name, dst=at, chain=c, line=line, name=name)

    def uses(self, x: ast.AST) -> tuple[list[str], list[str]]:
        """Nodes whose data the value holds, and chains of names that may be sources; calls in it are recorded."""
        if isinstance(x, ast.Name):
            if x.id in self.versions:
                return [self.node(x.id, self.versions[x.id])], []
            return ([f"{self.facts.path}::{MODULE}::{x.id}"] if self.name != MODULE else []), []
        if isinstance(x, ast.Attribute):
            inner = self.uses(x.value)
            return inner[0], [*inner[1], c] if (c := chain(x)) and c.count(".") else inner[1]
        if isinstance(x, (ast.Subscript, ast.Await, ast.Starred, ast.FormattedValue)):
            if isinstance(x, ast.Subscript):
                self.uses(x.slice)
            return self.uses(x.value)
        if isinstance(x, ast.Call):
            return self.call(x)
        parts = [self.uses(y) for y in ast.iter_child_nodes(x) if isinstance(y, (ast.expr, ast.comprehension, ast.keyword))]
        if isinstance(x, ast.IfExp):
            parts = parts[1:]
        if isinstance(x, (ast.JoinedStr, ast.BinOp, ast.IfExp, ast.BoolOp, ast.Tuple, ast.List)):
            return [n for p in parts for n in p[0]], [c for p in parts for c in p[1]]
        return [], []

    def call(self, x: ast.Call) -> tuple[list[str], list[str]]:
        called = chain(x.func)
        base = self.uses(x.func) if isinstance(x.func, ast.Attribute) else ([], [])
        at = f"{self.name}::{x.lineno}:{x.col_offset}"
        back = f"{self.facts.path}::{at}::call"
        if self.cls and called.startswith("self.") and called.count(".") == 1:
            target = self.cls + called[4:]
        else:
            target = called
        values = [(k, None, v) for k, v in enumerate(x.args)] + [(-1, k.arg, k.value) for k in x.keywords]
        beside = [chain(v.func) for _, _, v in values if isinstance(v, ast.Call)]
        self.facts.add("call", self.name, dst=back, chain=called, name=target, pos=None, line=x.lineno, beside=beside)
        for pos, name, v in values:
            arg = f"{self.facts.path}::{at}::{pos if name is None else name}"
            self.flow(v, arg, x.lineno)
            self.facts.add("arg", self.name, src=arg, dst=back, chain=called, name=name, pos=pos, line=x.lineno)
        return [*base[0], back], [*base[1], *([called] if called else [])]


def taint_facts(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path and FACT of each text (materialised); texts that do not parse, and null ones, have none."""
    import pandas as pd

    names = ["path", *(f.split()[0] for f in FACT.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for p, t in zip(batch["path"], batch["text"], strict=True):
                try:
                    tree = ast.parse(t)
                except (SyntaxError, ValueError, RecursionError, TypeError):
                    continue
                facts = Facts(p)
                facts.module(tree)
                rows += [tuple({"path": p, **r}.get(n) for n in names) for r in facts.rows]
                if len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    chosen = sources.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path is not null and text is not null")
    # Parsing costs time and not bytes, by which a small file would be one task.
    chosen = chosen.repartition(max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), sources.sparkSession.sparkContext.defaultParallelism))
    return stored(chosen.mapInPandas(run, f"path string, {FACT}"))


def named(c: Column, pattern: str, inner: bool = False) -> Column:
    """Is a chain the pattern, or does it go on from it (or, with inner, end with it), at whole names?"""
    found = (c == pattern) | c.startswith(pattern + ".")
    return found | c.endswith("." + pattern) if inner else found


def first_of(c: Column, kinds: tuple, inner: bool = False) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(kinds):
        out = F.when(named(c, pattern, inner), kind).otherwise(out)
    return out


def call_edges(facts: DataFrame) -> DataFrame:
    """src, dst: from arguments to the parameters of what is called, and from what it returns to the call.

    A name is looked up in its own text, then by its imports, in every text whose path ends in the module's name."""
    params = facts.where("kind = 'param'").select("path", F.col("scope").alias("function"), F.col("dst").alias("param"), F.col("name").alias("pname"), F.col("pos").alias("ppos"))
    returns = facts.where("kind = 'edge' OR kind = 'source'").where(F.col("dst").endswith("::return")).select("path", F.col("scope").alias("function"), F.col("dst").alias("back")).distinct()
    calls = facts.where("kind = 'call'").select("path", F.col("dst").alias("call"), F.col("name").alias("target"))
    calls = stored(calls.where("target <> ''"))
    imports = facts.where("kind = 'import'").select("path", F.col("name").alias("local"), F.col("chain").alias("module"), F.col("src").alias("original"))
    plain = calls.join(imports.where("original is not null"), (calls["path"] == imports["path"]) & (calls["target"] == F.col("local"))).select("call", "module", F.col("original").alias("function"))
    head, tail = F.regexp_extract("target", r"^(.*)\.[^.]+$", 1), F.substring_index("target", ".", -1)
    whole = F.when(F.col("original").isNull(), F.col("module")).otherwise(F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "original"))
    dotted = calls.withColumn("_head", head).where("_head <> ''").join(imports, (calls["path"] == imports["path"]) & (F.col("_head") == F.col("local"))).select("call", whole.alias("module"), tail.alias("function"))
    module = F.split(F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "^/+", ""), "/")
    files = facts.select("path").distinct().withColumn("_m", module)
    files = files.select(F.col("path").alias("other"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_m")), lambda k: F.array_join(F.slice("_m", k, F.size("_m")), "."))).alias("module"))
    far = plain.unionByName(dotted).join(files, "module").select("call", "other", "function")
    near = calls.select("call", F.col("path").alias("other"), F.col("target").alias("function"))
    called = stored(near.unionByName(far).distinct())
    args = facts.where("kind = 'arg'").select(F.col("dst").alias("call"), F.col("src").alias("arg"), "name", "pos")
    fits = F.when(F.col("name").isNotNull(), F.col("name") == F.col("pname")).otherwise((F.col("pos") >= 0) & (F.col("pos") == F.col("ppos")))
    into = called.join(params, (F.col("other") == params["path"]) & (called["function"] == params["function"])).select("call", "param", "pname", "ppos").join(args, "call").where(fits).select(F.col("arg").alias("src"), F.col("param").alias("dst"))
    out = called.join(returns, (F.col("other") == returns["path"]) & (called["function"] == returns["function"])).select(F.col("back").alias("src"), F.col("call").alias("dst"))
    return into.unionByName(out)


def taint_flows(facts: DataFrame, sources: tuple = SOURCES, sinks: tuple = SINKS, sanitisers: tuple = SANITISERS) -> DataFrame:
    """One row for each source and call it reaches: source_path, source_function, source_line, source_type, sink_path,
    sink_function, sink_line, sink_name, sink_type, severity, cwe, owasp, sanitizers_present (is another argument cleaned?), steps.

    Data flows through assignments, f-strings, operators, methods of a value, arguments and returned values, and stays in a
    variable until a cleaned value is assigned to it, as branches are not told apart. What a call of an unknown function returns
    is clean. Names match as a whole. Sources and sinks are found first; walks keep to edges from which a sink can be reached."""
    cleaned = F.lit(False)
    for s in sanitisers:
        cleaned = cleaned | F.coalesce(F.col("chain").contains(s), F.lit(False))
    inner = facts.where("kind = 'edge'").where(~cleaned).select("src", "dst")
    edges = stored(inner.unionByName(call_edges(facts)).distinct())
    starts = facts.where("kind = 'source'").where(~cleaned).withColumn("source_type", first_of(F.col("chain"), sources)).where("source_type is not null")
    starts = starts.groupBy("dst").agg(F.min(F.struct("line", "source_type", "path", "scope")).alias("s")).select(F.col("dst").alias("origin"), F.col("s.path").alias("source_path"), F.col("s.scope").alias("source_function"), F.col("s.line").alias("source_line"), F.col("s.source_type").alias("source_type"))
    patterns = tuple((p, kind) for kind, found in sinks for p in found)
    ends = facts.where("kind = 'arg'").withColumn("sink_type", first_of(F.col("chain"), patterns, inner=True)).where("sink_type is not null")
    ends = stored(ends.select(F.col("src").alias("node"), F.col("dst").alias("call"), F.col("path").alias("sink_path"), F.col("scope").alias("sink_function"), F.col("line").alias("sink_line"), F.col("chain").alias("sink_name"), "sink_type"))
    back = levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends.select(F.lit(0).alias("origin"), "node")).select(F.col("node").alias("dst"))
    useful = stored(edges.join(back, "dst", "left_semi"))
    starts = stored(starts.join(back.select(F.col("dst").alias("origin")), "origin", "left_semi"))
    reached = levels(useful, starts.select("origin", F.col("origin").alias("node")))
    beside = facts.where("kind = 'call'").select(F.col("dst").alias("call"), F.exists("beside", lambda x: F.exists(F.array(*map(F.lit, sanitisers)), lambda s: x.contains(s))).alias("sanitizers_present"))
    hits = reached.join(ends, "node").groupBy("origin", "call", "sink_path", "sink_function", "sink_line", "sink_name", "sink_type").agg(F.min("level").alias("steps"))
    of = lambda k: F.element_at(F.create_map(*(F.lit(v) for kind, x in KINDS.items() for v in (kind, x[k]))), F.col("sink_type"))
    made = hits.join(starts, "origin").join(beside, "call", "left")
    return made.select("source_path", "source_function", "source_line", "source_type", "sink_path", "sink_function", "sink_line", "sink_name", "sink_type", of(0).alias("severity"), of(1).alias("cwe"), of(2).alias("owasp"), F.coalesce("sanitizers_present", F.lit(False)).alias("sanitizers_present"), "steps")
