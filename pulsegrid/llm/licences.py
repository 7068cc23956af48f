"""Licence scans by canonical digest: whole texts, and lines, joined by digest with known licences."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Licence identifiers and the texts known for them.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def _stored() -> list[tuple[str, str]]:
    """What lies in ``licence_texts``: notices and SPDX lines, and whole texts, each file named by
    its licence and, where there are several, a variant."""
    found = []
    for file in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        if file.name == "notices.tsv":
            found += [tuple(line.split("\t")) for line in text.splitlines()]
        else:
            name = file.name.removesuffix(".txt")
            for variant in (".regents", ".reserved"):
                name = name.removesuffix(variant)
            found.append((name, text))
    return found


KNOWN += _stored()
#: Spellings taken as equal (after case and punctuation are gone).
EQUAL = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("ver", "version"), ("v", "version"), ("http", "https"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r©‘’“”–— "
_COPYRIGHT = r"^[ \t]*(copyright|\(c\)|\x{a9})([^a-z]|$)"


def _plain(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def canonical(text: Column) -> Column:
    """A lower-case line or text without punctuation, with one space around words and one spelling
    of each."""
    out = F.translate(text, _MARKS, " " * len(_MARKS))
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), " +", " ")
    for old, new in EQUAL:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def whole(text: Column) -> Column:
    """Canonical form of a text without its copyright lines."""
    lines = F.filter(F.split(_plain(text), "\n"), lambda x: ~x.rlike(_COPYRIGHT))
    return canonical(F.array_join(lines, " "))


def known_digests(known: DataFrame) -> DataFrame:
    """(license, digest) of ``known`` (license, text), each digest once: the first name of equals."""
    return (
        known.where("license is not null and text is not null")
        .groupBy(F.sha2(whole(F.col("text")), 256).alias("digest")).agg(F.min("license").alias("license"))
    )


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences of ``docs`` (doc_id, text) among ``known`` (license, text): rows (doc_id, license,
    whole, n_lines), whole if the entire text is that licence, n_lines the lines that are it.

    Case, punctuation, copyright lines and equivalent spellings make no difference. Null and empty
    texts have none; a line of no word is none. Repeated rows are counted together; a null doc_id is
    one of its own. Other columns are ignored. The join is on the digest; which side is sent is left
    to Spark, which knows their sizes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(
        F.filter(F.split(_plain(text), "\n"), lambda x: ~x.rlike(_COPYRIGHT)),
        lambda x: F.struct(canonical(x).alias("c"), F.lit(False).alias("whole")),
    )
    entire = F.array(F.struct(whole(text).alias("c"), F.lit(True).alias("whole")))
    parts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.concat(entire, lines)).alias("p")
    ).where("p.c <> ' '")
    digests = parts.select("doc_id", F.col("p.whole").alias("whole"), F.sha2(F.col("p.c"), 256).alias("digest"))
    return (
        digests.join(known_digests(known), "digest")
        .groupBy("doc_id", "license")
        .agg(F.max("whole").alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("n_lines"))
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(' ' || translate({text}, {_text(_MARKS)}, {_text(' ' * len(_MARKS))}) || ' ', ' +', ' ', 'g')"
    for old, new in EQUAL:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return out


def scan_sql() -> str:
    """The scan of ``documents`` for the built-in licences, as DuckDB SQL."""
    plain = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    kept = f"[x FOR x IN string_split({plain}, chr(10)) IF NOT regexp_matches(x, '{_COPYRIGHT}')]"
    values = ", ".join(f"({_text(n)}, {_text(t)})" for n, t in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({_canonical_sql(f"array_to_string({kept}, ' ')")}) AS digest, min(license) AS license
  FROM (VALUES {values}) k(license, text) GROUP BY 1
), kept AS (SELECT doc_id, {kept} AS lines FROM documents),
parts AS (
  SELECT doc_id, true AS whole, {_canonical_sql("array_to_string(lines, ' ')")} AS c FROM kept
  UNION ALL
  SELECT doc_id, false AS whole, {_canonical_sql("line")} AS c FROM (SELECT doc_id, unnest(lines) AS line FROM kept)
)
SELECT doc_id, license, bool_or(whole) AS whole, sum(CASE WHEN whole THEN 0 ELSE 1 END)::BIGINT AS n_lines
FROM (SELECT doc_id, whole, sha256(c) AS digest FROM parts WHERE c <> ' ') p JOIN known USING (digest)
GROUP BY doc_id, license"""
