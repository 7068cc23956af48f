import numpy as np
import pytest

from pulsegrid.llm import collisions
from tests.llm.cases import SF, rows

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string"


def brute(table, threshold=0.93):
    good = [
        (k, i, label, np.array(v, float)) for k, (i, v, label) in enumerate(table)
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    ]
    good = [g for g in good if np.linalg.norm(g[3]) > 0]
    links, up = {k: 0 for k in range(len(table))}, list(range(len(table)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, (k, _, la, a) in enumerate(good):
        for m, _, lb, b in good[p + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[k] += 1
                links[m] += 1
                up[find(k)] = find(m)
    least = {}
    for k, (i, _, _) in enumerate(table):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, links[k], least.get(find(k))) for k, (i, _, _) in enumerate(table)), key=repr)


def planted():
    rng = np.random.default_rng(4)
    table = []
    for g in range(25):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            noise = rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.15, 0.3])
            table.append((len(table), (base + noise).astype(np.float32).tolist(), int(g % 3)))
    table += [
        (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1),
        (904, [None] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, table[0][1], None),
        (907, table[0][1], table[0][2]), (907, table[0][1], table[0][2]), (None, table[0][1], table[0][2]),
        (908, table[0][1][:8], table[0][2]), (909, (np.array(table[0][1]) * 1e-3).tolist(), table[0][2]),
        (None, None, None),
    ]
    return table


@pytest.mark.parametrize("block", [2048, 7])
def test_links_match_brute_force(spark, block):
    table = planted()
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in table], SCHEMA)
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = rows(collisions.near_vectors(df, block=block), "vec_id", "n_links", "component_id")
    want = brute(stored)
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.97 * links and [g[0] for g in got] == [w[0] for w in want]
    by = {}
    for i, n, _ in want:
        by.setdefault(i, []).append(n)
    assert all(any(n <= m for m in by[i]) for i, n, _ in got)  # none below the threshold
    assert sum(g == w for g, w in zip(got, want)) >= 0.9 * len(want)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = rows(collisions.near_vectors(df), "vec_id", "n_links", "component_id")
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    least = collisions.calibrate(0.93, 24, 0.4, 0.002)
    d = rng.standard_normal((64, 24))
    hits = 0
    for _ in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        n = rng.standard_normal(64)
        n -= (n @ a) * a
        b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * n / np.linalg.norm(n)
        hits += any(True for _ in collisions.block_links(a[None], b[None], d, 0.4, least, 0.93, False))
    assert hits >= 285


def test_tiny_and_huge_vectors_link(spark):
    """Finite vectors that are not zero link whatever their size, down to the least double."""
    one = [1.0, -2.0, 0.5, 3.0]
    table = [(i, [x * s for x in one], 1) for i, s in enumerate((1.0, 1e-200, 1e200, 1e-300))]
    table += [(8, [5e-324, 0.0, 0.0, 0.0], 2), (9, [1.0, 0.0, 0.0, 0.0], 2), (10, [0.0] * 4, 2)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    assert rows(collisions.near_vectors(df), "vec_id", "n_links", "component_id") == sorted(
        [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0), (8, 1, 8), (9, 1, 8), (10, 0, 10)], key=repr
    )


def test_no_rows(spark):
    assert collisions.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
