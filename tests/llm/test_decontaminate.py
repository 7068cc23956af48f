import os
import re
import subprocess
import sys

import pytest

from pulsegrid.llm import decontaminate
from tests.llm.cases import SF, awkward, documents, empty, rows

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, width=10):
    holders = {}
    for item, text in items:
        w = words_of(text)
        if item is not None and w:
            for i in range(max(1, len(w) - width + 1)):
                holders.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    sizes = {len(k) for k in holders}
    out = []
    for i, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in holders:
                    hit |= set(range(at, at + n))
                    ids |= holders[tuple(w[at : at + n])]
        out.append((i, len(w), len(hit), len(ids), sorted(ids)))
    return sorted(out, key=repr)


def benchmark(spark):
    own = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    more = [(900, "x1 42"), (901, None), (902, "!!"), (None, "alpha"), (903, "One"), (900, "x1 42"), (904, "Lonely, TEXT")]
    return own.unionByName(spark.createDataFrame(more, "item_id long, text string"))


@pytest.mark.parametrize("make", [awkward, documents, empty])
@pytest.mark.parametrize("limit", [32 << 20, 4_000])
def test_hits_match_brute_force(spark, make, limit):
    docs, items = make(spark), benchmark(spark)
    got = decontaminate.decontaminate(docs, items, limit=limit)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r[0], r[1]) for r in items.collect()])
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items") == want
    text = {(r.doc_id, len(words_of(r.text))): r.text for r in docs.collect()}
    for r in got.where("n_hit > 0").collect():
        shown = [words_of(text[r.doc_id, r.n_words][s.start : s.end]) for s in r.spans]
        assert sum(map(len, shown)) == r.n_hit


def test_dropping_leaves_clean_documents(spark):
    docs, items = awkward(spark), benchmark(spark)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = brute([(r.doc_id, r.text) for r in docs.collect()], [(r[0], r[1]) for r in items.collect()])
    assert kept.count() == sum(r[2] == 0 for r in bad) > 5


def test_empty_benchmark(spark):
    docs = awkward(spark)
    nothing = benchmark(spark).limit(0)
    assert decontaminate.decontaminate(docs, nothing).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs, nothing).count() == docs.count()


@pytest.mark.parametrize("limit", [32 << 20, 600])
def test_long_items_and_many_blocks(spark, limit):
    """Items of more windows than a block holds, shared windows, words of one number's half."""
    long = " ".join(f"w{i % 700}x{i // 700}" for i in range(1500))
    items = [(1, long), (2, long[200:900]), (3, "short one"), (4, "one"), (4, " ".join(f"v{i}" for i in range(10)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        (1, "before " + long[300:2500] + " after"), (1, "before " + long[300:2500] + " after"), (2, long[100:2000].upper()),
        (None, "a Short, ONE here"), (3, None), (4, ""), (5, " ".join(f"v{i}" for i in range(9))), (6, "?? é1 " * 40), (7, long * 3),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.decontaminate(docs, bench, limit=limit)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items") == brute(texts, items)
    whole = {(r.doc_id, r.n_words): r for r in got.collect()}
    for i, text in texts:
        r = whole[i, len(words_of(text))]
        assert sum(len(words_of(text[s.start : s.end])) for s in r.spans) == r.n_hit
    kept = decontaminate.drop_contaminated(docs, bench, limit=limit)
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if whole[r.doc_id, len(words_of(r.text))].n_hit == 0)


MEASURED = """
import random, resource
from pulsegrid.llm.decontaminate import Matcher, MOST_WINDOWS
r = random.Random(5)
words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(30000)]
items = [(str(i), " ".join(r.choices(words, k=1009)).encode()) for i in range(MOST_WINDOWS // 1000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = Matcher(items, 10)
assert found.scan(items[7][1].split())[0].all()
print(len(found.built), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_full_block_takes_less_than_a_gigabyte():
    out = subprocess.run([sys.executable, "-c", MEASURED], capture_output=True, text=True, check=True, cwd=ROOT).stdout
    windows, megabytes = map(int, out.split())
    assert windows == decontaminate.MOST_WINDOWS and megabytes < 1000
