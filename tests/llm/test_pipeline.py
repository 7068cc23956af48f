import re

import pytest

import corpus_pipeline
from pulsegrid.llm.common import cut
from tests.llm import test_decontaminate as leaks
from tests.llm import test_overlap as copies
from tests.llm.cases import SF, awkward, documents, empty
from tests.llm.test_packing import CODER
from tests.llm.test_secrets import brute as secret_spans


def expected(rows, items):
    """(doc_id, text) that the first three stages keep."""
    left = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    groups = {}
    for (i, t), (_, g) in zip(left, copies.labelled(left)):
        groups.setdefault((i, t), g)
    left = [(i, t) for (i, t), g in groups.items() if i is None or i == g]
    keyed = [(k, t) for k, (_, t) in enumerate(left)]
    clean = {r[0] for r in leaks.brute(keyed, items) if r[2] == 0}
    return [left[k] for k, _ in keyed if k in clean]


def items_of(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def check_packing(got, left):
    """``got`` are the pieces of all texts of ``left`` and of no others."""
    sizes = {}
    for r in got:
        sizes.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert set(sizes) == {i for i, _ in left}
    for i, text in left:
        if not secret_spans(text)[3]:  # texts without a fixed secret keep their tokens, bar random strings
            assert any(n <= len(CODER.encode(text, add_special_tokens=False).ids) + 1 for n in sizes[i])


def test_stages_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    left = expected(docs, items_of(spark))
    assert 50 < len(left) < len(docs)
    got = corpus_pipeline.run(spark, SF).collect()
    check_packing(got, left)
    sizes = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(sizes.values())
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language id" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_and_empty_tables_pass_all_stages(spark, make):
    docs = made = cut(make(spark), "pipeline-test")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "pipeline-test")
        if name != "packing":
            assert docs.columns == made.columns
    left = expected([(r.doc_id, r.text) for r in made.collect()], items_of(spark))
    check_packing(docs.collect(), left)


def test_language_stage_keeps_only_learned_scripts(spark):
    known = documents(spark)
    odd = known.limit(1).selectExpr("1000001L as doc_id", "'東京 大阪 xy 京都' as text", "cast(null as string) as lang", "source", "n_chars")
    odd = odd.unionByName(odd.selectExpr("1000002L as doc_id", "'½ ² ①' as text", "lang", "source", "n_chars"))
    kept = corpus_pipeline.language_id(spark, known.unionByName(odd), SF)
    assert kept.where("doc_id > 1000000").count() == 0
    assert kept.count() == known.where("text rlike '[a-zA-Z]'").count()
