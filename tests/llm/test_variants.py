import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import variants
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.01"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute(docs):
    """Forms by wildcard dictionaries; docs are (doc_id, text)."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    same = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            same[w[:k], w[k + 1 :]].add(w)
    near = {w: set() for w in counts}
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        for k in range(len(w)):
            if (less := w[:k] + w[k + 1 :]) in counts:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def check(df, **search):
    got = variants.spelling_variants(df, **search)
    assert got.columns == COLUMNS
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def crowded(spark):
    """Words with chains of forms, accents, ties, many with the same letters, and very long ones."""
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        word = "".join(rng.choice("aeioulnrstéßÿ") for _ in range(rng.randrange(6, 11)))
        for n in (200, 30, 6, 5):
            texts += [word] * n
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + "z" + word[k:], word[:k] + "q" + word[k + 1 :]])
    letters = list("abcdefg")
    for _ in range(300):
        rng.shuffle(letters)
        texts += ["".join(letters)] * rng.randrange(5, 9) + ["".join(letters[:-1]) + "h"] * 5
    texts += ["x" * 3000, "x" * 3001] * 6 + ["WORDÀÉ wordàé ÀWORDé"] * 40
    rng.shuffle(texts)
    docs = [(i if i % 7 else None, " ".join(texts[i::60])) for i in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word").repartition(4)


def test_crowded_words_match_brute_force(spark):
    rows = check(crowded(spark))
    assert any(r[1] != r[2] and r[1] for r in rows) and max(r[4] for r in rows) > 3
    assert check(crowded(spark), cell=20, leaf=3, sample=100) == rows  # small cells, dealt in blocks


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_texts_match_brute_force(spark, make):
    check(make(spark))


def test_given_texts_match_brute_force(spark):
    assert len(check(spark.read.parquet(f"{SF}/documents.parquet"), cell=256)) > 1000


def test_box_search_reaches_every_word_within_the_distance():
    rng = np.random.default_rng(2)
    letters = rng.choice(np.frombuffer(b"abcdef", np.uint8), (400, 6))
    counts = variants.letter_counts(letters)
    tree = variants.KdTree(counts, 8)
    assert sorted(tree.order.tolist()) == list(range(400)) and len(tree.leaves) > 20
    seen = {(i, p) for leaf, some in tree.search(counts, 1, 1) for i in some.tolist() for p in tree.order[slice(*tree.leaves[leaf])].tolist()}
    diff = counts[:, None] - counts[None]
    within = {(i, j) for i, j in zip(*np.nonzero(((diff > 0) * diff).sum(2) * ((diff < 0) * -diff).sum(2) == 1))}
    assert within <= seen and len(seen) < 400 * 400
