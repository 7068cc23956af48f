import random
import re

import pytest

import corpus_pipeline
from pulsegrid.llm import overlap
from tests.llm import test_simhash as copies
from tests.llm.cases import SF, awkward, documents, empty


def grams(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def labelled(docs):
    """(doc_id, group), in order, by four-bit fingerprints or exact five-word Jaccard, all pairs compared."""
    sets = [grams(t) for _, t in docs]
    prints = [copies.plain_fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near = 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
            if group[i] != group[j] and (near or (prints[i] ^ prints[j]).bit_count() <= 4):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for (i, _), g in zip(docs, group):
        if i is not None:
            ids[g] = min(i, ids.get(g, i))
    return [(i, ids.get(g)) for (i, _), g in zip(docs, group)]


def brute(docs):
    return sorted(labelled(docs), key=repr)


def edited(spark):
    """Texts with a few words changed, and a large group of near copies that share a common line."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    line = "this line is found in very many of the texts of this table"
    docs = []
    for _ in range(20):
        base = [word() for _ in range(rng.randrange(30, 200))]
        for change in range(4):
            text = list(base)
            for _ in range(change * len(base) // 80):
                text[rng.randrange(len(text))] = word()
            docs.append(" ".join(text) + " " + line)
    base = [word() for _ in range(150)]
    for k in range(60):
        docs.append(" ".join([*base[: 100 + k % 3], word(), *base[100:], line]))
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")


@pytest.mark.parametrize("make", [awkward, documents, edited, empty])
def test_groups_match_brute_force_similarity(spark, make):
    docs = make(spark)
    got = sorted(((r.doc_id, r.component_id) for r in overlap.near_duplicates(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_stage_leaves_one_of_each_similar_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    for pair in ((1, 255), (643, 770), (709, 944), (582, 875)):  # seven to ten bits apart
        assert len(kept & set(pair)) <= 1


def test_a_repeated_id_is_judged_by_each_of_its_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words), (2, "something else that is kept"), (2, words + " end")]
    kept = overlap.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == [rows[0], rows[2]]
