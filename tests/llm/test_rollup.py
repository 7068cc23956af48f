import re
from collections import Counter

import pytest

from pulsegrid.llm import rollup
from pulsegrid.session import scratch_path
from tests.llm.cases import awkward, documents, empty, rows
from tests.llm.test_packing import CODER


def brute(docs):
    """Counts after inserts, removal of later copies and the revision of what is left."""
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    n, t = Counter(), Counter()
    for r in docs:
        if r.doc_id is not None and r.doc_id > first[r.text]:
            continue
        sizes = {
            "words-1": len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")),
            "word_bpe_49k": len(CODER.encode(r.text or "", add_special_tokens=False).ids) + 1,
        }
        for k, v in sizes.items():
            n[r.source, r.lang, k] += 1
            t[r.source, r.lang, k] += v
    return sorted(((*k, n[k], t[k]) for k in n), key=repr)


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_batches_match_a_recount(spark, make):
    docs = make(spark)
    got = rollup.replayed(docs, scratch_path(spark, "rollup"))
    assert rows(got, "source", "lang", "tokenizer", "docs", "tokens") == brute(docs.collect())


def test_a_batch_counts_once_and_a_broken_one_is_redone(spark):
    table = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    add = spark.createDataFrame(
        [("insert", "a", None, "t", 5, None), ("insert", "a", None, "t", None, None), ("revise", "a", None, "t", 7, 5),
         ("insert", "b", "en", "t", 3, None), ("delete", "b", "en", "t", 3, None)],
        "op string, source string, lang string, tokenizer string, tokens long, old_tokens long",
    )
    rollup.deltas(add).write.parquet(f"{table.path}/batch=1/_temporary")  # an attempt that never ended
    assert table.commit("1", add) and not table.commit("1", add)
    assert rows(table.totals(["1", "2"]), "source", "docs", "tokens") == [("a", 2, 7)]
    assert table.totals([]).count() == 0


def test_unknown_change_is_refused(spark):
    bad = spark.createDataFrame(
        [("upsert", "a", "b", "t", 1, 1)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    )
    with pytest.raises(Exception, match="no such change"):
        rollup.deltas(bad).collect()
