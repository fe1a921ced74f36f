"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form (case, punctuation, lines that claim a copyright, equivalent spellings), and the SHA-256
of the whole form is looked up by a hash join among the digests of known licence texts. Whole lines are looked up in the same
way, by a second hash join, because most documents carry their licence as a notice line; only lines with a word of `IN_NOTICES`,
which every known notice has, are hashed.

A text with a word of `IN_BODIES` is looked up a third time, in its body form, among the licence texts of license_texts.json,
each with and without its usual titles: lines are joined before spellings are made equal, so that neither wrapping nor comment
marks matter. text_digest stays that of the first form.

Defined results: a null or empty text, or one without a letter or digit of any script, has no digest and no licence; repeated
rows each keep their row, and so do rows without doc_id; ties cannot occur, as every known digest names one licence; a very
long text is one form like any other; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that claim a copyright (a sign or a year follows, marks of a comment may precede) are no part of a licence's identity.
CLAIM = r"(^|\n)[^a-z0-9\n]*?(copyright[^a-z0-9\n]*(\(c\)|©|[0-9]{4})|\(c\)[^a-z0-9\n]*[0-9]{4}|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{M}\p{N}\n]+"
#: A text has one of these if a spelling changes it.
SPELT = r" (licence|licenced|licensed|licences|sub license|(v|ver) ?[0-9]|version[0-9]|[0-9] 0|non commercial|favour|whilst)"
#: Each known notice has one of these in its canonical form (a test sees to it).
IN_NOTICES = ("licen", "reserved", "universal", "public domain", "warrant")
#: Equivalent spellings: pattern on padded words, replacement.
SPELLINGS = (
    (r" (licence|licenced|licensed) ", " license "),
    (r" (licences|licenses) ", " licenses "),
    (r" sub license ", " sublicense "),
    (r" (v|ver|version) ?([0-9])", " version $2"),
    (r" (v|ver|version) ?([0-9]) 0 ", " version $2 "),
    (r" ([0-9]) 0 ", " $1 "),
    (r" (non commercial|noncommercial) ", " noncommercial "),
    (r" (favour|favor) ", " favor "),
    (r" (whilst|while) ", " while "),
)

#: Known licence texts and notices (fixed values).
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    ),
)


def plain(text: Column) -> Column:
    """Lower case, without claims and punctuation; lines kept apart by single newlines, each word padded by one space."""
    t = F.regexp_replace(F.translate(text, UPPER, LOWER), CLAIM, "$1")
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(t, NOT_WORD, " "), r" ?\n[\n ]*", " \n "), F.lit(" "))


def spelt(form: Column) -> Column:
    """A plain form in equal spellings; most texts have none to change."""
    t = form
    for pattern, put in SPELLINGS:
        t = F.regexp_replace(t, pattern, put)
    return F.when(form.rlike(SPELT), t).otherwise(form)


def canonical(text: Column) -> Column:
    """The canonical form."""
    return spelt(plain(text))


RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(?=\n|$)"
#: Each text of license_texts.json has one of these words (a test sees to it), and no spelling changes them.
IN_BODIES = ("warrant", "conveying")


def body(text: Column) -> Column:
    """The body form: one line of words that does not depend on wrapping, comment marks or claims."""
    t = F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), CLAIM, "$1"), RESERVED, "$1")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^a-z0-9]+", " "), F.lit(" "))
    for pattern, put in (*SPELLINGS, (" https ", " http ")):
        t = F.regexp_replace(t, pattern, put)
    return flat(t)


def known_bodies() -> list[tuple[str, str]]:
    """(license, text) of license_texts.json, each without and with each of its titles."""
    known = json.loads(Path(__file__).with_name("license_texts.json").read_text("utf-8"))
    return [(k["license"], f"{title}\n{k['text']}") for k in known for title in ("", *k["titles"])]


def flat(form: Column) -> Column:
    """A canonical form as one line of words with single spaces."""
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def digest(words: Column) -> Column:
    return F.when(words != "", F.sha2(words, 256))


def known_digests(spark: SparkSession, known=KNOWN, form=lambda text: flat(canonical(text))) -> DataFrame:
    """license, digest: as many rows as texts in known, so it is safe to broadcast."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select(digest(form(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, text_digest, license (of the whole text), line_licenses (of whole lines, sorted, each once, comma-joined), n_license_lines."""
    spark = docs.sparkSession
    form = F.col("_form")
    lines = F.filter(F.transform(F.split(form, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("|".join(IN_NOTICES)))
    in_body = F.translate("text", UPPER, LOWER).rlike("|".join(IN_BODIES))
    forms = docs.select("doc_id", plain(F.col("text")).alias("_plain"), F.when(in_body, digest(body(F.col("text")))).alias("_body")).select("doc_id", "_body", spelt(F.col("_plain")).alias("_form"))
    # Digests only, numbered: rows need not differ in doc_id.
    rows = cut(forms.select("doc_id", "_body", digest(flat(form)).alias("text_digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("_lines")).withColumn("_row", F.monotonically_increasing_id()))
    digests = F.broadcast(known_digests(spark, known).withColumnRenamed("license", "_license"))  # as small as the list of known licences
    bodies = F.broadcast(known_digests(spark, known_bodies(), body).select(F.col("digest").alias("_body"), F.col("license").alias("_body_license")))  # as small as license_texts.json
    met = rows.where(F.size("_lines") > 0).select("_row", F.explode("_lines").alias("digest")).join(digests, "digest")
    by_row = met.groupBy(F.col("_row").alias("_of")).agg(F.array_join(F.array_sort(F.collect_set("_license")), ",").alias("_names"), F.count("*").alias("_n"))
    done = rows.join(digests.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(bodies, "_body", "left").join(by_row, F.col("_row") == F.col("_of"), "left")
    return done.select("doc_id", "text_digest", F.coalesce("_license", "_body_license").alias("license"), F.coalesce("_names", F.lit("")).alias("line_licenses"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_license_lines"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    t = f"translate({text}, '{UPPER}', '{LOWER}')"
    t = f"regexp_replace({t}, '{CLAIM}', '\\1', 'g')"
    t = f"' ' || regexp_replace(regexp_replace({t}, '{NOT_WORD}', ' ', 'g'), ' ?\\n[\\n ]*', chr(32) || chr(10) || chr(32), 'g') || ' '"
    for pattern, put in SPELLINGS:
        t = f"regexp_replace({t}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return t


def oracle() -> str:
    values = ",\n".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    flat_sql = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' ')"
    return f"""
WITH known_text(license, t) AS (VALUES {values}),
known AS (SELECT sha256({flat_sql.format("(" + _sql_canonical("t") + ")")}) AS digest, min(license) AS license FROM known_text GROUP BY 1),
rows AS (SELECT row_number() OVER () AS r, doc_id, {_sql_canonical("text")} AS form FROM documents),
line_hits AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n
  FROM (SELECT r, trim(unnest(string_split(form, chr(10))), ' ') AS line FROM rows) JOIN known ON sha256(line) = digest
  WHERE line <> '' GROUP BY r)
SELECT doc_id, CASE WHEN {flat_sql.format("form")} <> '' THEN sha256({flat_sql.format("form")}) END AS text_digest, license,
  coalesce(names, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM rows LEFT JOIN known ON {flat_sql.format("form")} <> '' AND sha256({flat_sql.format("form")}) = digest LEFT JOIN line_hits USING (r)
"""
