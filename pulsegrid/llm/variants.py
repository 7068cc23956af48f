"""Spelling variants: words one edit apart, found by K-d trees over letter counts.

One replaced letter takes one letter away and adds another, one inserted letter adds one. So words
near each other differ by at most two in their letter counts, and a range search over the counts
finds them: words of one length in the tree of that length, and in that of the next. A search leaves
out every box that would need more letters added or taken away than the edit does. A tree fitted on
a sample deals words and searches to cells; each cell has a tree of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import cut

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Place of each letter in a vector of counts: a-z, then U+00C0 to U+00FF.
_PLACE = np.zeros(256, np.int64)
_PLACE[97:123] = np.arange(26)
_PLACE[192:256] = 26 + np.arange(64)
_LETTERS = 90
_HELD = 1 << 20
_CHUNK = 1 << 22
_LENGTH = 1 << 24


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of whole texts of at least ``shortest`` code points that occur at least
    ``least`` times in all.

    Words are maximal runs of Latin letters, A-Z in lower case. A run of a document whose crc32 with
    the doc_id is divisible by ``every`` loses one of its letters. Null texts have no words; a null
    doc_id is written as nothing. Repeated rows count each."""

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                for word, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                    if len(word) < shortest:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) > _HELD:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def codes(words: list[str]) -> np.ndarray:
    """One row of letters per word; all of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    at = np.arange(n)[:, None] * _LETTERS + _PLACE[letters]
    return np.bincount(at.ravel(), minlength=n * _LETTERS).reshape(n, _LETTERS).astype(np.int32)


class KdTree:
    """Splits of letter counts, one letter at a time, as even as they can be; ``order`` has the
    points leaf by leaf, ``leaves`` where each one starts and stops."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # letter, count, left, right; a leaf: -1, number
        self.leaves: list[tuple[int, int]] = []
        self.alike: list[np.ndarray | None] = []  # the counts of a leaf whose points all have the same
        order: list[np.ndarray] = []
        self._grow(vectors, np.arange(len(vectors)), leaf, order)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)

    def _grow(self, vectors: np.ndarray, some: np.ndarray, leaf: int, order: list[np.ndarray]) -> int:
        own = len(self.nodes)
        self.nodes.append((-1, 0, 0, 0))
        own_vectors, split = vectors[some], None
        if len(some) > leaf:
            best = 0
            for value in range(int(min(own_vectors.max(initial=0), 8))):
                above = (own_vectors > value).sum(axis=0)
                less = np.minimum(above, len(some) - above)
                if less.max() > best:
                    best, split = int(less.max()), (int(less.argmax()), value)
        if split is None:
            start = self.leaves[-1][1] if self.leaves else 0
            self.nodes[own] = (-1, len(self.leaves), 0, 0)
            self.leaves.append((start, start + len(some)))
            alike = len(some) > 0 and (own_vectors == own_vectors[0]).all()
            self.alike.append(own_vectors[0] if alike else None)
            order.append(some)
            return own
        letter, value = split
        high = own_vectors[:, letter] > value
        left = self._grow(vectors, some[~high], leaf, order)
        right = self._grow(vectors, some[high], leaf, order)
        self.nodes[own] = (letter, value, left, right)
        return own

    def search(self, vectors: np.ndarray, added: int, taken: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, searches): the leaves whose box a search can reach by adding at most ``added`` and
        taking away at most ``taken`` letters."""
        zero = np.zeros(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)), zero, zero, {})]
        while stack:
            at, some, plus, minus, box = stack.pop()
            letter, value, left, right = self.nodes[at]
            if letter < 0:
                yield value, some
                continue
            low, high = box.get(letter, (0, None))
            own = vectors[some, letter]
            was = np.maximum(own - high, 0) if high is not None else 0
            now = minus - was + np.maximum(own - value, 0)
            fits = now <= taken
            if fits.any():
                stack.append((left, some[fits], plus[fits], now[fits], {**box, letter: (low, value)}))
            now = plus - np.maximum(low - own, 0) + np.maximum(value + 1 - own, 0)
            fits = now <= added
            if fits.any():
                stack.append((right, some[fits], now[fits], minus[fits], {**box, letter: (value + 1, high)}))


def near(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two letter matrices that are one edit apart: one letter replaced if they have
    one width, one inserted into the first if the second is one wider."""
    (m, width), k = short.shape, len(long)
    step = max(1, _CHUNK // max(1, k * width))
    a, b = [], []
    for at in range(0, m, step):
        part = short[at : at + step, None, :]
        if long.shape[1] == width:
            fits = (part != long[None]).sum(axis=2) == 1
        else:
            front = np.logical_and.accumulate(part == long[None, :, :-1], axis=2).sum(axis=2)
            back = np.logical_and.accumulate((part == long[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            fits = front + back >= width
        i, j = np.nonzero(fits)
        a.append(i + at)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


class _Cell:
    """The words of one cell, all of one length, and the tree over them."""

    def __init__(self, words: list[str], ns: list[int], leaf: int):
        self.words, self.ns = words, ns
        self.letters = codes(words)
        self.tree = KdTree(letter_counts(self.letters), leaf)

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (search, word of the cell) one edit apart."""
        letters = codes(words)
        counts, same = letter_counts(letters), letters.shape[1] == self.letters.shape[1]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for leaf, some in self.tree.search(counts, 1, 1 if same else 0):
            alike = self.tree.alike[leaf]
            if alike is not None:  # then the counts alone tell which searches are at the right distance
                some = some[np.abs(counts[some] - alike).sum(axis=1) == (2 if same else 1)]
            if len(some):
                start, stop = self.tree.leaves[leaf]
                there = self.tree.order[start:stop]
                i, j = near(letters[some], self.letters[there])
                a.append(some[i])
                b.append(there[j])
        return np.concatenate(a), np.concatenate(b)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def _top_trees(words: DataFrame, cell: int, sample: int) -> dict[int, KdTree]:
    """A tree per length that deals words to cells of about ``cell``, from at most ``sample`` words,
    those smallest by hash."""
    total = words.count()
    share = min(1.0, 2.0 * sample / max(1, total))
    draw = F.xxhash64("word") / F.lit(2.0**64) + 0.5
    got = [r["word"] for r in words.where(draw < share).orderBy(draw, "word").limit(sample).select("word").collect()]
    leaf = max(16, int(cell * len(got) / max(1, total)))
    return {size: KdTree(letter_counts(codes([got[i] for i in some])), leaf) for size, some in _by_length(got)}


def near_words(words: DataFrame, cell: int = 4096, leaf: int = 32, sample: int = 200_000) -> DataFrame:
    """(word, near, near_n): every pair of ``words`` (word, n; different words) one edit apart, from
    both sides.

    A cell that holds more than twice ``cell`` words, which the sampled tree could not split, is dealt
    in blocks by the hash of its words, and its searches go to each block. Very many words with the
    same letters in other orders make such cells, whose blocks are compared word by word with what
    searches reach them."""
    trees = words.sparkSession.sparkContext.broadcast(_top_trees(words, cell, sample))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column("word").to_pylist()
            cells = np.zeros(len(got), np.int64)
            for size, some in _by_length(got):
                cells[some] = size * _LENGTH
                if size in trees.value:
                    for own, part in trees.value[size].search(letter_counts(codes([got[i] for i in some])), 0, 0):
                        cells[some[part]] = size * _LENGTH + own
            yield pa.record_batch([*batch.columns, pa.array(cells)], names=["word", "n", "cell"])

    placed = cut(words.select("word", "n").mapInArrow(home, "word string, n long, cell long"), "variant-words")
    sizes = placed.groupBy("cell").count().where(F.col("count") > 2 * cell)
    blocks = {r["cell"]: -(-r["count"] // cell) for r in sizes.collect()}

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column("word").to_pylist()
            for size, some in _by_length(got):
                counts = letter_counts(codes([got[i] for i in some]))
                for side, longer in ((1, 0), (2, 1)):
                    tree = trees.value.get(size + longer)
                    found = tree.search(counts, 1, 1 - longer) if tree else [(0, np.arange(len(some)))]
                    for own, part in found:
                        to = (size + longer) * _LENGTH + own
                        rows = pa.array(some[part])
                        for block in range(blocks.get(to, 1)):
                            yield pa.record_batch(
                                [
                                    pa.array(np.full(len(part), to)), pa.array(np.full(len(part), block)),
                                    pa.array(np.full(len(part), side, np.int32)),
                                    batch.column("word").take(rows), batch.column("n").take(rows),
                                ],
                                names=["cell", "block", "side", "word", "n"],
                            )

    def own_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            dealt = [
                xxhash.xxh64_intdigest(w) % blocks[c] if c in blocks else 0
                for c, w in zip(cells, batch.column("word").to_pylist())
            ]
            yield pa.record_batch(
                [
                    batch.column("cell"), pa.array(dealt, pa.int64()), pa.array(np.zeros(len(dealt), np.int32)),
                    batch.column("word"), batch.column("n"),
                ],
                names=["cell", "block", "side", "word", "n"],
            )

    schema = "cell long, block long, side int, word string, n long"
    data = placed.mapInArrow(own_block, schema)
    searches = placed.select("word", "n").mapInArrow(reach, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ns, there = None, [], [], None
        for batch in batches:
            cells, parts, sides = (batch.column(c).to_numpy() for c in ("cell", "block", "side"))
            got, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            turn = (cells[1:] != cells[:-1]) | (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1])
            edges = [0, *(np.flatnonzero(turn) + 1).tolist(), len(got)]
            for start, stop in zip(edges, edges[1:]):
                own = (cells[start], parts[start])
                if own != key:
                    key, held, ns, there = own, [], [], None
                if sides[start] == 0:
                    held += got[start:stop]
                    ns += counts[start:stop]
                    continue
                if not held:  # no word lies there
                    continue
                there = there or _Cell(held, ns, leaf)
                a, b = there.search(got[start:stop])
                word, near_word = [got[start + i] for i in a.tolist()], [held[i] for i in b.tolist()]
                near_n = [ns[i] for i in b.tolist()]
                if sides[start] == 2:  # the longer words do not search for shorter ones
                    own_n = [counts[start + i] for i in a.tolist()]
                    word, near_word, near_n = word + near_word, near_word + word, near_n + own_n
                if word:
                    yield pa.record_batch(
                        {"word": pa.array(word, pa.string()), "near": pa.array(near_word, pa.string()), "near_n": pa.array(near_n, pa.int64())}
                    )

    dealt = data.unionByName(searches).repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def forms(words: DataFrame, times: int = 5, **search) -> DataFrame:
    """Spelling forms of ``words`` (word, n; different words): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the first in code-point order) if that n is at
    least ``times`` the word's, else null with ``form_n``; ``root`` follows forms to the last one;
    ``n_near`` counts the near words. No words: no rows."""
    pairs = near_words(words, **search)
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    fits = -F.col("best.less") >= F.col("n") * times
    found = cut(
        words.join(best, "word", "left").select(
            "word", F.when(fits, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "variant-forms",
    )
    most = found.agg(F.max("n")).first()[0] or 1
    hops = cut(found.where("form is not null").select("word", F.col("form").alias("to")), "variant-hops")
    # every form occurs `times` as often as its word, so chains are short; each round doubles the hops
    for _ in range(math.ceil(math.log2(math.log(most, times) + 2)) if times > 1 else 0):
        onward = hops.select(F.col("word").alias("to"), F.col("to").alias("next"))
        hops = cut(hops.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to")), "variant-hops")
    return found.join(hops, "word", "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, **search) -> DataFrame:
    """:func:`forms` of the :func:`word_counts` of ``docs`` (doc_id, text). Other columns are ignored."""
    return forms(cut(word_counts(docs), "variant-counts"), **search)
