import math
import re
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import brown
from pulsegrid.llm.common import crc_fold
from tests.llm.cases import awkward, documents, empty, rows


def split(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [None]


def brute(train, docs):
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        w = split(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, round(base, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [awkward, documents])
@pytest.mark.parametrize("table", [300_000, 40])
def test_base_matches_brute_force(spark, make, table):
    docs = make(spark)
    train = docs.where(crc_fold() != 1)
    model, vocab = brown.train(train, classes=8, words=30, groups=16, table=table, rounds=2)
    got = brown.score(docs, model, vocab)
    assert [(*r[:4], round(r[4], 6)) for r in rows(got, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score")] == brute(
        [r.text for r in train.collect()], [(r.doc_id, r.text) for r in docs.collect()]
    )


def test_classes_help_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, vocab = brown.train(docs.where(crc_fold() != 1))
    held = brown.score(docs.where(crc_fold() == 1), model, vocab).collect()
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held) > 100


def test_probabilities_of_a_class_add_up(spark):
    docs = documents(spark)
    model, vocab = brown.train(docs, classes=8, words=50, groups=16, rounds=1)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    mass, kinds = np.zeros(8), np.zeros(8)
    place = {h: k for k, h in enumerate(model.known.tolist())}
    for r in vocab.collect():
        k = place.get(r.h, -1)
        unit = k if 0 <= k < model.words else model.words + r.g
        mass[model.classes[unit]] += r.n
        kinds[model.classes[unit]] += 1
    assert np.allclose(10**model.emission, mass + 0.5 * (kinds + 1))


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    seq = [1 + 2 * rng.integers(10) + k % 2 for k in range(20000)]
    classes = np.concatenate([[0], 1 + rng.integers(0, 2, 20)])
    for _ in range(4):
        left, right = np.zeros((21, 3)), np.zeros((21, 3))
        for a, b in zip(seq, seq[1:]):
            right[a, classes[b]] += 1
            left[b, classes[a]] += 1
        classes = brown.exchange(left, right, classes)
    assert len(set(classes[1::2])) == len(set(classes[2::2])) == 1 and classes[1] != classes[2]


def test_nothing_to_learn_from(spark):
    model, vocab = brown.train(empty(spark), classes=4, words=5, groups=4)
    got = rows(brown.score(awkward(spark), model, vocab), "n_known", "train_tokens")
    assert set(got) == {(0, 0)}
    assert brown.score(empty(spark), model, vocab).count() == 0
