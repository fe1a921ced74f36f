"""Markup and URLs against Python's own parsers, SQL with quotes, depth of inheritance, aliases of Avro fields."""

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from quarrylens.operators import quality, schema, web

PAGES = [
    """<html><head><META NAME=viewport CONTENT=width=device-width><meta name='description' content="a > b &amp; c"><link rel=canonical href=https://x.org/p>
<title>One &lt;title&gt; &#233;&#x1F600;</title><!-- <meta name="keywords" content="hidden"> --><script>var s = '<a href="/no">no</a><meta name=robots content=none>';</script></head>
<body><a href=foo>x</a><a href = "bar?a=1&amp;b=2" title='>'>two <b>bold</b></a><A HREF='/abs' disabled>three</A><a name=n>none</a><a href>empty</a><!-- <a href="c">c</a> --><a href="../z">up""",
    """<base href="/b/c/"><a href="d">d</a><a href='HTTP://H.com/y'>case</a><a
 href="//Other.ORG/q">o</a><a href="#top">t</a><a href="mailto:a@b.c">m</a><style>a { content: "<a href=s>" }</style><a class=x href=it's>q</a><abbr href=no>no</abbr>""",
    "", "<a href=unclosed", "plain text < 3 > 2", "<a href='x'>a<a href='y'>b</a>",
]


class Reader(HTMLParser):
    """Tags of interest as Python reads them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.meta, self.canonical, self.base = [], {}, None, None

    def handle_starttag(self, tag, attrs):
        d = {}
        for k, v in attrs:
            d.setdefault(k, v or "")
        if tag == "a":
            self.links.append(d.get("href"))
        elif tag == "meta":
            self.meta.setdefault((d.get("name") or d.get("property") or "").lower(), d.get("content"))
        elif tag == "link" and "canonical" in d.get("rel", "").lower().split():
            self.canonical = self.canonical or d.get("href")
        elif tag == "base":
            self.base = self.base or d.get("href")


def test_markup_against_a_parser(spark):
    pages = spark.createDataFrame([(k, f"https://h.com/dir/page{k}.html?q=1", x) for k, x in enumerate(PAGES)], "page_id long, url string, html string")
    tags = {r.page_id: r for r in web.meta_tags(pages).collect()}
    links, types = {}, {}
    for r in web.link_types(web.links(pages, "page_id")).collect():
        links.setdefault(r.page_id, []).append((r.position, r.href))
        types[r.page_id, r.href] = (r.link_url, r.link_type)
    for k, x in enumerate(PAGES):
        want = Reader()
        want.feed(x)
        assert (tags[k].canonical, tags[k].viewport, tags[k].description, tags[k].keywords, tags[k].robots) == (want.canonical, *(want.meta.get(n) for n in ("viewport", "description", "keywords", "robots")))
        assert sorted(links.get(k, [])) == [(n, h) for n, h in enumerate(want.links) if h is not None], k
        page = f"https://h.com/dir/page{k}.html?q=1"
        base = urljoin(page, want.base) if want.base else page
        for h in want.links:
            if h is not None:
                full = urljoin(base, h) if h else base
                whole = urlsplit(full)
                assert types[k, h][0] == whole._replace(netloc=whole.netloc.lower()).geturl(), h  # which lowers the scheme
    assert tags[0].title == "One <title> é😀" and tags[1].title is None
    assert types[0, "../z"] == ("https://h.com/z", "internal") and types[1, "HTTP://H.com/y"] == ("http://h.com/y", "internal") and types[1, "//Other.ORG/q"] == ("https://other.org/q", "external") and types[1, "d"][0] == "https://h.com/b/c/d"


def test_resolution_against_urljoin(spark):
    bases = ["http://a/b/c/d;p?q", "https://h.com", "https://h.com/", "https://u:P@h.com:8080/x/y/z.html?k=v#f"]
    refs = "g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h mailto:a@b".split()
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = {(x.b, x.r): x.u for x in df.select("b", "r", web.resolved(F.col("r"), F.col("b")).alias("u")).collect()}
    assert {k: v for k, v in got.items() if v != urljoin(*k)} == {}
    dots = spark.createDataFrame([("http://a/b/../c/./d", "HTTP://X.org/a/../b"), ("http://a/b/../c/./d", "#s")], "b string, r string")  # where urljoin leaves them
    assert [r[0] for r in dots.select(web.resolved(F.col("r"), F.col("b"))).collect()] == ["http://x.org/b", "http://a/c/d#s"]


def test_ddl_with_quotes(spark):
    sql = """CREATE TABLE "b c" ("my col" INT DEFAULT 5, b TEXT DEFAULT 'x, y', c DECIMAL(10,2) CHECK (c IN (1, (2), 3)), [d e] VARCHAR(5) NOT NULL, f INT, PRIMARY KEY (f)); -- CREATE TABLE no (x INT);
    create table t2(a int not null, k text default 'it''s (not null'); SELECT ';' , 'create table x (y int)';"""
    got = sorted(tuple(r) for r in schema.parse_ddl(spark.createDataFrame([(sql,), (None,), ("",)], "ddl string")).collect())
    assert got == [
        ("b c", 0, "my col", "INT", False), ("b c", 1, "b", "TEXT", False), ("b c", 2, "c", "DECIMAL(10,2)", False), ("b c", 3, "d e", "VARCHAR(5)", True), ("b c", 4, "f", "INT", False),
        ("t2", 0, "a", "INT", True), ("t2", 1, "k", "TEXT", False),
    ]


def test_depth_goes_through_the_deepest_base(spark):
    source = "class A:\n    pass\nclass B(A):\n    pass\nclass D(A, B):\n    pass\nclass E(Unknown):\n    pass\nclass F(D, E):\n    pass\n"
    rows = quality.class_rows(spark.createDataFrame([("f.py", source)], "path string, text string"))
    assert {r.class_name: r.dit for r in quality.class_metrics(rows).collect()} == {"A": 0, "B": 1, "D": 2, "E": 1, "F": 3}


def test_avro_names_and_aliases():
    old = {"type": "record", "name": "R", "fields": [{"name": "x", "type": "int"}]}
    new = {"type": "record", "name": "R", "fields": [{"name": "y", "type": "long", "aliases": ["x"]}]}
    assert schema.avro_incompatibilities(old, new) == [] and len(schema.avro_incompatibilities(new, old)) == 1
    other = {**old, "name": "S"}
    assert len(schema.avro_incompatibilities(old, other)) == 1 and schema.avro_incompatibilities(old, {**other, "aliases": ["R"]}) == []
