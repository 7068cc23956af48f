import re

import numpy as np
import pytest
import xxhash

from pulsegrid.llm import simhash
from pulsegrid.llm.common import components
from tests.llm.cases import awkward, documents, empty, rows


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs, bits=4):
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    fps = sorted({f for _, f in prints})
    group = {f: f for f in fps}
    for _ in fps:
        before = dict(group)
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= bits:
                    group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    return sorted(((i, signed(f), least.get(group[f])) for i, f in prints), key=repr)


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_groups_match_brute_force(spark, make):
    docs = make(spark)
    got = rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_links_find_every_close_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for n in (1, 2, 3, 4, 4, 4, 5):
            for bit in rng.choice(64, n, replace=False).tolist():
                f ^= 1 << bit
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.component for r in components(edges).collect()}
    for i, a in enumerate(sorted(fps)):
        for j, b in enumerate(sorted(fps)):
            if i < j and (a ^ b).bit_count() <= 4:
                assert got[signed[i]] == got[signed[j]]
    for r in edges.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4


def test_segments_leave_one_bit_each():
    for bits in (3, 4, 5):
        assert len(simhash._segments(bits)) * 2 > bits
        assert sum(w for _, w in simhash._segments(bits)) == 64


def test_keep_one_leaves_one_of_each_group(spark):
    docs = awkward(spark)
    kept = rows(simhash.keep_one(docs), "doc_id", "text")
    found = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {i for i, _ in kept if i is not None} == {i for i, _, c in found if i is not None and i == c}
    assert sum(i is None for i, _ in kept) == 2
    assert simhash.keep_one(docs).columns == docs.columns


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500
