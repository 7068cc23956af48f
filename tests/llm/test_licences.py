import duckdb
import pytest

from pulsegrid.llm import licences
from tests.llm.cases import SF, awkward, documents, empty, rows


def test_equivalent_texts(spark):
    mit = next(t for n, t in licences.KNOWN if n == "MIT" and "hereby" in t)
    docs = spark.createDataFrame(
        [
            (1, "Copyright (c) 2021 Somebody\n" + mit.upper().replace('"', "''"), "x"),
            (2, "prose here\nReleased under the M.I.T. Licence\nReleased  under: the MIT LICENCE.\n(c) 2020 me", "x"),
            (3, "copyrighted work released under the mit license", "x"), (4, None, "x"), (5, "", "x"), (6, "\n\n..", "x"),
            (None, "licensed under CC BY-NC 4.0", "x"), (2, "Released under the MIT License.", "x"),
        ],
        "doc_id long, text string, license string",
    )
    got = rows(licences.scan(docs, licences.known_licences(spark)), "doc_id", "license", "whole", "n_lines")
    assert got == sorted([(1, "MIT", True, 0), (2, "MIT", True, 2), (None, "CC-BY-NC-4.0", True, 1)], key=repr)


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_sql(spark, make):
    docs = make(spark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(con.execute(licences.scan_sql()).fetchall(), key=repr)
    got = rows(licences.scan(docs, licences.known_licences(spark)), "doc_id", "license", "whole", "n_lines")
    assert got == want


def test_no_known_licences(spark):
    assert licences.scan(documents(spark), licences.known_licences(spark).limit(0)).count() == 0
