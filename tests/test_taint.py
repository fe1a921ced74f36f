"""Flows from sources to sinks within and across functions and files."""

from pyspark.sql import functions as F

from quarrylens.operators import taint

FILES = {
    "app/views.py": '''import os
from app.db import find as look
from . import helpers
from app.helpers import wrap, safe


def show(request):
    name = request.args.get("q")
    text = f"select {name}"
    cursor.execute(text)
    look(name)
    helpers.store(path=name)
    a = wrap(name)
    os.system(a)
    b = safe(name)
    os.system(b)
    name = escape(name)
    eval(name)


def clean_here():
    x = input()
    x = shlex.quote(x)
    os.system(x)
    os.system(input(), html.escape(x))


class Page:
    def read(self):
        return os.getenv("HOME")

    def write_out(self):
        where = self.read()
        where += "/x"
        if where:
            open(where)
''',
    "app/db.py": '''def find(key, n=0):
    conn.execute("x" + key)
    evaluate(key)
''',
    "app/helpers.py": '''import sys
TOP = sys.argv


def wrap(v):
    return deeper(v)


def deeper(v):
    return v.strip()


def safe(v):
    return escape(v)


def store(size=1, *, path):
    with open(path) as f:
        f.write(TOP[1])


def loop(a):
    b = request.form
    for k in range(3):
        a = loop(b)
    logger.info(a)
    return a
''',
    "app/broken.py": "def (:",
}


def test_flows_across_functions_and_files(spark):
    df = spark.createDataFrame([*FILES.items(), ("empty.py", ""), ("null.py", None), (None, "eval(input())")], "path string, text string")
    got = {(r.source_path[4:], r.source_line, r.source_type, r.sink_path[4:], r.sink_line, r.sink_type, r.sanitizers_present) for r in taint.taint_flows(taint.taint_facts(df)).collect()}
    v, h = "views.py", "helpers.py"
    q = (v, 8, "http_parameter")
    assert got == {
        (*q, v, 10, "sql_query", False), (*q, "db.py", 2, "sql_query", False), (*q, h, 18, "file_path", False), (*q, v, 14, "shell_command", False),
        (v, 25, "user_input", v, 25, "shell_command", True), (v, 30, "env_var", v, 36, "file_path", False), (h, 2, "command_line_arg", h, 19, "file_write", False),
        (h, 23, "http_parameter", h, 26, "log_output", False),
    }


def test_a_long_chain_and_no_flow(spark):
    text = "x0 = input()\n" + "".join(f"x{k + 1} = x{k} + 'a'\n" for k in range(40)) + "exec(x40)\n"
    rows = taint.taint_flows(taint.taint_facts(spark.createDataFrame([("a.py", text)], "path string, text string"))).collect()
    assert [(r.source_line, r.sink_line, r.severity, r.cwe, r.steps) for r in rows] == [(1, 42, "critical", "CWE-95", 41)]
    none = spark.createDataFrame([("a.py", "x = 1\nexec(x)\n")], "path string, text string")
    assert taint.taint_flows(taint.taint_facts(none)).count() == 0


def test_parsing_is_dealt_to_many_tasks(spark):
    """A small file of many texts is one partition, but not one task of the parser."""
    many = spark.range(40, numPartitions=1).select(F.format_string("m%d.py", "id").alias("path"), F.lit("import os\nos.system(input())\n").alias("text"))
    facts = taint.taint_facts(many)
    assert facts.select(F.input_file_name()).distinct().count() > 1
    assert facts.select("path").distinct().count() == 40 and facts.where("beside is not null").count() == 2 * 40 and taint.taint_flows(facts).count() == 40
