import numpy as np
import pytest

from pulsegrid.llm import langid
from pulsegrid.llm.common import crc_fold
from tests.llm.cases import awkward, documents, empty


def test_held_out_accuracy(spark):
    docs = documents(spark)
    model = langid.train(docs.where(crc_fold() != 0).select("text", "lang"))
    got = langid.predict(docs, model).join(docs.where(crc_fold() == 0).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 20
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.85
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_texts(spark):
    docs = awkward(spark)
    model = langid.train(documents(spark).select("text", "lang"))
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (4, 5, 6, 11)] == ["und"] * 4
    assert by[7].lang_pred != "und"
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert langid.predict(empty(spark), model).count() == 0


@pytest.mark.parametrize("langs", [[], ["xx"]])
def test_few_languages(spark, langs):
    docs = spark.createDataFrame([(v, "some words") for v in langs] + [(None, "none")], "lang string, text string")
    model = langid.train(docs)
    got = langid.predict(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert got.lang_pred == (langs or ["und"])[0]


def test_hierarchy():
    rng = np.random.default_rng(0)
    langs = ["en", "de", "fr", "es"] * 30
    x = rng.random((120, 16)).astype(np.float32) * 0.2
    for k, v in enumerate(langs):
        x[k, ["en", "de", "fr", "es"].index(v)] += 1
    model = langid.LanguageModel.fit(x, langs, 16)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    table, bias = model.table()
    assert [model.decide(m)[0] for m in x @ table + bias] == langs


def test_sample_bound(spark):
    docs = spark.range(3000).selectExpr("concat('word ', id) text", "if(id % 3 = 0, 'en', 'fr') lang")
    got = langid.train(docs, per_language=50, size=64)
    assert got.languages == ["en", "fr"]


def test_copies_count_once(spark):
    docs = spark.range(400).selectExpr("concat('word ', id) text", "if(id % 2 = 0, 'en', 'fr') lang")
    copies = spark.range(4000).selectExpr("concat('word ', id % 2) text", "if(id % 2 = 0, 'en', 'fr') lang")
    one = langid.train(docs, per_language=50, size=64)
    two = langid.train(docs.unionByName(copies), per_language=50, size=64)
    assert np.array_equal(one.table()[0], two.table()[0])


def test_only_letters_count(spark):
    model = langid.train(documents(spark).select("text", "lang"))
    docs = spark.createDataFrame([(1, "½ ² ① 7"), (2, "東京 xqz 大阪 京都"), (3, "the words of it ½")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got[1] == "und" and got[2] != "und"
    kept = langid.keep_known(docs.selectExpr("*", "'' as lang"), model)
    assert [r.doc_id for r in kept.collect()] == [3]
