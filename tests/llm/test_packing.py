import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import packing
from tests.llm.cases import awkward, documents, empty

CODER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(docs, packed, capacity=4096):
    """An exact round trip: pieces give back every document's ids, sequences are gapless."""
    got = packed.collect()
    want = sorted(
        zlib.crc32(np.array([*CODER.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
        for r in docs.collect()
    )
    whole = [r.ids_crc32 for r in got if r.length == r.doc_tokens]
    cut = {(r.doc_id, r.doc_tokens) for r in got if r.length < r.doc_tokens}
    assert len(whole) + len(cut) <= len(want) and set(whole) <= set(want)
    assert sum(r.length for r in got) == sum(
        len(CODER.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()
    )
    for r in docs.collect():
        ids = np.array([*CODER.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        own = [p for p in got if p.doc_id == r.doc_id and p.doc_tokens == len(ids)]
        for p in own:
            if (r.doc_id, len(ids)) in cut:
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert {p.start for p in own} >= set(range(0, len(ids), capacity))
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(v <= capacity for v in ends.values())
    return ends


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_round_trip(spark, make):
    docs = make(spark)
    ends = check(docs, packing.pack(docs, buckets=3))
    if ends:
        assert len(ends) <= 1 + 1.1 * sum(ends.values()) / 4096 + 1


def test_word_memory_gives_the_tokenizer_s_ids():
    texts = ["Hello's  world\n\tÀé é ́x <|endoftext|>a b<|startoftext|> don't 12345", " a b 　", "a" * 5000, ""]
    encode = packing.WordTokens("word_bpe_49k.json", keep=3)
    for text in texts * 2:
        assert encode(text.encode()).tolist() == CODER.encode(text, add_special_tokens=False).ids


def test_marks_at_word_ends_give_the_tokenizer_s_ids():
    rng = np.random.default_rng(5)
    letters = list("aBé1'.,!<|>_sßÀΏ \t\n-\"tl")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    texts += ["x<|endoftext|>. <|endoftext|>'s a<|endoftext|", "end. end, END' end''s end's' ..."]
    encode = packing.WordTokens("word_bpe_49k.json", keep=500)
    assert encode.marks
    for text, ids in zip(texts, encode.all((t.encode() for t in texts), together=4096), strict=True):
        assert ids.tolist() == CODER.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    sizes, demand = np.unique(rng.integers(1, 65, 5000), return_counts=True)
    used = packing.plan(sizes, demand, 64)
    assert (sum(p * n for p, n in used) == demand).all()
    assert all((p * sizes).sum() <= 64 for p, _ in used)
    assert sum(n for _, n in used) <= 1.01 * (sizes * demand).sum() / 64 + 2


def test_knapsack_is_exact():
    value, counts = packing.knapsack(np.array([0.6, 0.35, 1.0]), np.array([5, 3, 9]), 11)
    assert abs(value - 1.3) < 1e-9 and counts.tolist() == [1, 2, 0]


def test_common_length_is_ranked_in_buckets(spark):
    docs = spark.range(2000).selectExpr("id doc_id", "'same words here' text")
    ends = check(docs, packing.pack(docs, buckets=7))
    assert len(ends) <= 2000 * 6 / 4096 + 2


def test_words_encoded_together_keep_their_own_ids():
    texts = [
        "A a AA ÀÉß İi ﬁ don't DON'T 'S x's.'s 12ab3 ½ ²³ á Å A　A <|END a<|endoftext|>B \x1cq\x85z\xa0y",
        "A" * 50 + " A", "ÿ×÷ \xad\xb5 µ ª º", "'' 'A' a'll'A A'A",
    ]
    encode = packing.WordTokens("word_bpe_49k.json")
    got = list(encode.all(t.encode() for t in texts))
    assert [g.tolist() for g in got] == [CODER.encode(t, add_special_tokens=False).ids for t in texts]
