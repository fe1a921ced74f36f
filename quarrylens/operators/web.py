"""Meta tags, links, structured data, security headers and images of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

OG = ("og:title", "og:description", "og:image", "og:url", "og:type")
TWITTER = ("twitter:card", "twitter:title", "twitter:description", "twitter:image")
NAMES = ("description", "keywords", "robots", "viewport")


#: An attribute: a name, and a value in double, single or no quotes, or none.
_ATTRIBUTE = r"[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+"
#: What stands in a tag behind its name, to its end: a `>` inside quotes does not end it.
_REST = rf"(?=[\s/>])(?:[\s/=]++|{_ATTRIBUTE})*+>"
#: Comments, and elements whose content is no markup; not closed, they reach to the end.
_COMMENT, _RAW = r"<!--.*?(?:-->|\z)", rf"<({{0}}){_REST}.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
#: Named character references that are decoded, beside numeric ones (fixed values).
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac"}
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);"


def decoded(text: Column) -> Column:
    """Text with its character references replaced; unknown ones stay."""
    named = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def one(x):
        hexadecimal = x.rlike("^&#[xX]")
        number = F.when(hexadecimal, F.conv(F.regexp_extract(x, "([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+);$", 1)).try_cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")
        return F.when(~x.rlike(f"^{_REFERENCE}$"), x).when(x.startswith("&#"), F.coalesce(letter, F.lit("\ufffd"))).otherwise(F.coalesce(F.try_element_at(named, F.regexp_extract(x, "^&([a-zA-Z]+);$", 1)), x))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"{_REFERENCE}|[^&]++|&"), F.lit(0)), one), "")).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of a tag with this name: decoded, '' if it has none, null without the attribute."""
    every = F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s/>]+", ""), F.lit(_ATTRIBUTE), F.lit(0))
    found = F.try_element_at(F.filter(every, lambda x: F.lower(F.regexp_extract(x, r"^[^\s/>=]+", 0)) == name), F.lit(1))
    value = F.regexp_replace(found, r"^[^\s/>=]+\s*=?\s*", "")
    return decoded(F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def _tags(html: str, name: str) -> Column:
    """The opening tags of a name, in order, outside comments and raw text."""
    raw = _RAW.format("script|style|textarea|title")
    every = F.regexp_extract_all(html, F.lit(rf"(?is){_COMMENT}|{raw}|<{name}{_REST}"), F.lit(0))
    return F.filter(every, lambda x: x.rlike(rf"(?is)^<{name}[\s/>]"))


def meta_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of pages but the markup, with title, canonical, and the named, og and twitter meta values (the first of each)."""
    keys = lambda m: F.lower(F.coalesce(_attribute(m, "name"), _attribute(m, "property"), F.lit("")))
    first = lambda n: F.try_element_at(F.transform(F.filter("_m", lambda m: m["key"] == n), lambda m: m["content"]), F.lit(1))
    canon = F.try_element_at(F.filter(F.transform("_k", lambda m: F.when(F.array_contains(F.split(F.lower(_attribute(m, "rel")), r"\s+"), "canonical"), _attribute(m, "href"))), lambda x: x.isNotNull()), F.lit(1))
    shown = F.regexp_replace(html, rf"(?is){_COMMENT}|{_RAW.format('script|style|textarea')}", "")
    title = rf"(?is)<title{_REST}(.*?)</title(?=[\s/>])"
    made = pages.withColumn("_m", F.transform(_tags(html, "meta"), lambda m: F.struct(keys(m).alias("key"), _attribute(m, "content").alias("content")))).withColumn("_k", _tags(html, "link"))
    made = made.withColumn("title", F.when(shown.rlike(title), F.trim(decoded(F.regexp_extract(shown, title, 1))))).withColumn("canonical", canon)
    for n in (*NAMES, *OG, *TWITTER):
        made = made.withColumn(n.replace(":", "_"), first(n))
    return made.drop("_m", "_k", html)


def meta_rules(tags: DataFrame) -> DataFrame:
    """Validity of title (30-60) and description (50-160), and the issues of each page as codes."""
    size = lambda c: F.length(c)
    t, d = F.col("title"), F.col("description")
    issue = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n)
    found = F.array_compact(F.array(
        issue(t.isNull(), "title missing"), issue(size(t) < 30, "title short"), issue(size(t) > 60, "title long"), issue(d.isNull(), "description missing"), issue(size(d) < 50, "description short"), issue(size(d) > 160, "description long"),
        issue(F.col("canonical").isNull(), "canonical missing"), issue(~F.col("canonical").startswith("http"), "canonical relative"), issue(F.lower("robots").contains("noindex"), "noindex"), issue(F.lower("robots").contains("nofollow"), "nofollow"),
        issue(F.col("viewport").isNull(), "viewport missing"), issue(~F.lower("viewport").contains("width=device-width"), "viewport fixed"), *(issue(F.col(n.replace(":", "_")).isNull(), f"{n} missing") for n in OG),
    ))
    valid = lambda c, lo, hi: F.coalesce(size(c).between(lo, hi), F.lit(False))
    return tags.withColumn("title_valid", valid(t, 30, 60)).withColumn("description_valid", valid(d, 50, 160)).withColumn("issues", F.array_join(found, ","))


def seo_score(rules: DataFrame) -> DataFrame:
    """100 less 25/15 for title and description missing/invalid, 10 for the canonical, up to 20 and 10 for og and twitter tags, 5 for a missing title or description."""
    part = lambda c, ok: F.when(F.col(c).isNull(), 25).when(~F.col(ok), 15).otherwise(0)
    present = lambda names: sum((F.col(n.replace(":", "_")).isNotNull().cast("int") for n in names), F.lit(0))
    missing = F.col("title").isNull().cast("int") + F.col("description").isNull().cast("int")
    score = 100.0 - part("title", "title_valid") - part("description", "description_valid") - F.when(F.col("canonical").isNull(), 10).otherwise(0) - (20 - present(OG) / len(OG) * 20) - (10 - present(TWITTER) / len(TWITTER) * 10) - 5 * missing
    return rules.withColumn("seo_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Key, position, href, text (up to 100 characters) of each a[href], and base_url: the page's, or that of its base[href]."""
    shown = F.regexp_replace(html, rf"(?is){_COMMENT}|{_RAW.format('script|style|textarea|title')}", "")
    tags = F.regexp_extract_all(shown, F.lit(rf"(?is)<a{_REST}.*?(?:</a(?=[\s/>])[^>]*+>|(?=<a[\s/>])|\z)"), F.lit(0))
    base = F.try_element_at(F.filter(F.transform(_tags(html, "base"), lambda x: _attribute(x, "href")), lambda x: x.isNotNull()), F.lit(1))
    read = pages.select(key, F.col(url).alias("page_url"), base.alias("_base"), tags.alias("_tags"))  # once, before they are used many times
    each = read.select(key, "page_url", F.when(F.col("_base").isNull(), F.col("page_url")).otherwise(resolved(F.col("_base"), F.col("page_url"))).alias("base_url"), F.posexplode("_tags").alias("position", "_t"))
    each = each.withColumn("href", F.trim(_attribute(F.regexp_extract("_t", rf"(?is)^<a{_REST}", 0), "href")))
    plain = F.regexp_replace("_t", rf"(?is){_COMMENT}|</?[a-z][^\s/>]*+{_REST}", "")
    text = F.substring(F.trim(F.regexp_replace(decoded(plain), r"\s+", " ")), 1, 100)
    return each.where(F.col("href").isNotNull()).select(key, "page_url", "base_url", "position", "href", text.alias("text"))


#: scheme, authority, path, query and fragment of a reference (the pattern of RFC 3986).
_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def without_dots(path: Column) -> Column:
    """A path without its dot segments: a fold over its segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1).isin(".", "..")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.element_at(segments, 1)), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.array_append(a, x)))
    return F.concat(F.array_join(kept, "/"), F.when(last, F.lit("/")).otherwise(F.lit("")))


def resolved(reference: Column, base: Column) -> Column:
    """A reference against a base by RFC 3986, with scheme and host in lower case, as a browser shows it."""
    part = lambda c, k: F.regexp_extract(c, _URL, k)
    has = lambda c, pattern: c.rlike(pattern)
    absolute, authority, query = has(reference, "^[a-zA-Z][a-zA-Z0-9+.-]*:"), has(reference, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"), has(reference, r"^[^#]*\?")
    path = part(reference, 3)
    folder = F.when((part(base, 2) != "") & (part(base, 3) == ""), F.lit("/")).otherwise(F.regexp_extract(part(base, 3), r"(?s)^(.*/)", 1))
    joined = F.when(absolute | authority | path.startswith("/"), path).when(path == "", part(base, 3)).otherwise(F.concat(folder, path))
    clean = F.when(joined.startswith("/"), without_dots(joined)).otherwise(joined)
    scheme = F.lower(F.when(absolute, part(reference, 1)).otherwise(part(base, 1)))
    host = F.when(authority, part(reference, 2)).when(absolute, F.lit("")).otherwise(part(base, 2))
    host = F.concat(F.regexp_extract(host, "^(.*@)?", 1), F.lower(F.regexp_replace(host, "^.*@", "")))
    asked = F.when(query, F.concat(F.lit("?"), part(reference, 4))).when(~absolute & ~authority & (path == "") & has(base, r"^[^#]*\?"), F.concat(F.lit("?"), part(base, 4))).otherwise(F.lit(""))
    mark = F.when(has(reference, "#"), F.concat(F.lit("#"), part(reference, 5))).otherwise(F.lit(""))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")), clean, asked, mark)


def link_types(found: DataFrame) -> DataFrame:
    """link_url (resolved against base_url), link_host and link_type."""
    h = F.lower("href")
    host = lambda c: F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    kind = F.when(h.startswith("#"), "anchor").when(h.startswith("mailto:"), "mailto").when(h.startswith("tel:"), "tel").when(h.startswith("javascript:"), "javascript")
    made = found.withColumn("link_url", resolved(F.col("href"), F.col("base_url"))).withColumn("link_host", host(F.col("link_url")))
    return made.withColumn("link_type", kind.when(F.col("link_host") == host(F.col("page_url")), "internal").when(F.lower("link_url").rlike("^https?:"), "external").otherwise("other")).drop("base_url")


def filter_links(typed: DataFrame, key: str, skip_types: tuple[str, ...] = ("mailto", "tel", "javascript"), skip_patterns: tuple[str, ...] = ()) -> DataFrame:
    """The first link of each URL on a page, without skipped types and patterns."""
    rest = [c for c in typed.columns if c not in (key, "link_url", "position")]
    first = typed.groupBy(key, "link_url").agg(F.min(F.struct("position", *rest)).alias("_x")).select(key, "link_url", "_x.*")
    made = first.where(~F.col("link_type").isin(*skip_types)) if skip_types else first
    for p in skip_patterns:
        made = made.where(~F.col("link_url").rlike("(?i)" + p))
    return made


def link_report(typed: DataFrame, key: str) -> DataFrame:
    """Counts by type and number of hosts of each page."""
    n = lambda k: F.count_if(F.col("link_type") == k)
    return typed.groupBy(key).agg(F.count("*").alias("total_links"), n("internal").alias("internal_links"), n("external").alias("external_links"), n("anchor").alias("anchor_links"), F.count_distinct(F.when(F.col("link_type") == "external", F.col("link_host"))).alias("external_hosts"))


def link_health(results: DataFrame, key: str) -> DataFrame:
    """W7 over checked links (status_code, response_ms, redirects): broken, redirected and slow ones, share of good ones."""
    code = F.col("status_code")
    made = results.groupBy(key).agg(F.count("*").alias("checked"), F.count_if(code.between(200, 299)).alias("ok"), F.count_if((code >= 400) | code.isNull()).alias("broken"), F.count_if(F.col("redirects") > 0).alias("redirected"), F.count_if(F.col("redirects") > 1).alias("redirect_chains"), F.count_if(F.col("response_ms") > 3000).alias("slow"))
    return made.withColumn("health_score", F.lit(100.0) * F.col("ok") / F.col("checked"))


#: Properties that each type must have (fixed values).
STRUCTURED = {"Article": ("headline", "author", "datePublished", "image"), "Product": ("name", "image", "offers"), "Organization": ("name", "url"), "BreadcrumbList": ("itemListElement",), "FAQPage": ("mainEntity",), "WebSite": ("name", "url"), "Person": ("name",), "Event": ("name", "startDate", "location"), "LocalBusiness": ("name", "address")}


def structured_data(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Each JSON-LD block: type, is it JSON, which required properties are missing."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    each = pages.select(key, F.posexplode(blocks).alias("position", "_j")).withColumn("schema_type", F.get_json_object("_j", "$.@type"))
    keys = F.coalesce(F.json_object_keys("_j"), F.array().cast("array<string>"))
    wanted = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in STRUCTURED.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("schema_type")), F.array().cast("array<string>"))
    return each.select(key, "position", "schema_type", F.get_json_object("_j", "$").isNotNull().alias("is_json"), F.array_join(F.array_except(wanted, keys), ",").alias("missing"))


def resource_type(initiator: Column, url: Column) -> Column:
    """By initiator, else by the extension of the path."""
    ext = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(initiator.isin("script"), "script").when(initiator.isin("css", "link") & (ext == "css"), "stylesheet").when(initiator == "img", "image").when(ext.isin("js", "mjs"), "script").when(ext == "css", "stylesheet").when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg", "avif", "ico"), "image").when(ext.isin("woff", "woff2", "ttf", "otf"), "font").when(ext.isin("mp4", "webm", "mp3"), "media").when(initiator.isin("fetch", "xmlhttprequest"), "xhr").otherwise("other")


def csp_checks(df: DataFrame, header: str) -> DataFrame:
    """The directives of a Content-Security-Policy, its weaknesses as codes and a score."""
    directives = F.filter(F.transform(F.split(header, ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    rule = lambda n: F.try_element_at(F.filter("_d", lambda x: x.startswith(n + " ") | (x == n)), F.lit(1))
    made = df.withColumn("_d", F.coalesce(directives, F.array().cast("array<string>")))
    script = F.coalesce(rule("script-src"), rule("default-src"), F.lit(""))
    found = F.array_compact(F.array(F.when(F.size("_d") == 0, "missing"), F.when((F.size("_d") > 0) & (script == ""), "no script-src"), F.when(script.contains("'unsafe-inline'"), "unsafe-inline"), F.when(script.contains("'unsafe-eval'"), "unsafe-eval"), F.when(script.rlike(r"(^|\s)\*(\s|$)"), "wildcard"), F.when((F.size("_d") > 0) & rule("object-src").isNull() & rule("default-src").isNull(), "no object-src")))
    made = made.withColumn("n_directives", F.size("_d").cast("long")).withColumn("weaknesses", F.array_join(found, ",")).withColumn("csp_score", F.greatest(F.lit(0), F.when(F.size("_d") == 0, 0).otherwise(100 - 20 * F.size(found))))
    return made.drop("_d")


def pixel_difference(a: Column, b: Column, tolerance: int = 0) -> Column:
    """Share of places where two arrays of equal length differ by more than the tolerance."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > tolerance)) / F.size(a)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; 0 if one is constant."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    prod = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    cov, va, vb = prod(a, b) - total(a) * total(b) / n, prod(a, a) - total(a) * total(a) / n, prod(b, b) - total(b) * total(b) / n
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(0.0)


def average_hash(pixels: Column) -> Column:
    """Up to 64 bits: is each pixel above the mean?"""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(pixels)
    return F.aggregate(F.slice(pixels, 1, 64), F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(F.when(v > mean, 1).otherwise(0).cast("long")))


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@F.pandas_udf(ArrayType(IntegerType()))
def label_regions(mask, width):
    """The number of each marked pixel's region (4-neighbours, in order of their first pixel, from 1), 0 for others."""
    import pandas as pd

    def one(bits, w: int) -> list[int]:
        label, n = [0] * len(bits), 0
        for start, on in enumerate(bits):
            if not on or label[start]:
                continue
            n += 1
            label[start], todo = n, [start]
            while todo:
                p = todo.pop()
                for q, ok in ((p - 1, p % w), (p + 1, (p + 1) % w), (p - w, p >= w), (p + w, p + w < len(bits))):
                    if ok and bits[q] and not label[q]:
                        label[q] = n
                        todo.append(q)
        return label

    return pd.Series([one(m, int(w)) for m, w in zip(mask, width, strict=True)])
