import random
import re

import pytest

from pulsegrid.llm import substring
from tests.llm.cases import awkward, documents, empty, rows


def brute(docs, width=13):
    least = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        if i is not None:
            for at in range(len(w) - width + 1):
                k = tuple(w[at : at + width])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for at in range(len(w) - width + 1):
                if least[tuple(w[at : at + width])] < i:
                    gone |= set(range(at, at + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def passages(spark):
    """Shared passages, repeats inside a document, overlaps and near copies."""
    rng = random.Random(11)
    shared = [" ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(rng.randrange(10, 40))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice("abc") for _ in range(20)) for _ in range(6)]
        docs.append((i, "\n ".join(parts)))
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("make", [awkward, documents, passages, empty])
@pytest.mark.parametrize("hot", [20_000, 2])
def test_kept_words_match_brute_force(spark, make, hot):
    docs = make(spark)
    got = rows(substring.remove_repeats(docs, hot=hot), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_automaton_against_windows():
    rng = random.Random(2)
    built, seen = substring.SuffixAutomaton(), {}
    for doc in range(40):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(3, 30))]
        want = [k for k in range(len(words) - 3) if seen.get(tuple(words[k : k + 4]), doc) < doc]
        assert built.earlier(words, doc, 4) == want
        built.add(words, doc)
        for k in range(len(words) - 3):
            seen.setdefault(tuple(words[k : k + 4]), doc)
