"""Language identification in two steps: the family first, then one-versus-one linear support vector
machines between the languages of that family."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.common import forget, texts

#: Families of closely related languages: fixed values. A language of no family here is one itself.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
}
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)
)
_PIECE = 1 << 20


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def gram_counts(text: bytes, size: int) -> tuple[np.ndarray, int]:
    """Hashed counts of the byte n-grams (1 to 4) of a text, and their number. A-Z count in lower
    case, and what is no letter is one space."""
    line = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    counts, total = np.zeros(size, np.int64), 0
    for at in range(0, len(line), _PIECE):  # bounded memory for very long texts
        x = np.frombuffer(line[at : at + _PIECE + 3], np.uint8).astype(np.uint32)
        new, h = min(_PIECE, len(line) - at), np.zeros(len(x), np.uint32)
        for n in range(4):
            h = (h[: len(x) - n] + np.uint32(n + 1)) * np.uint32(0x9E3779B1) ^ x[n:]
            codes = (h * np.uint32(0x85EBCA6B) >> np.uint32(15)) & np.uint32(size - 1)
            codes = codes[:new]
            counts += np.bincount(codes, minlength=size)
            total += len(codes)
            h = h[:-1]
    return counts, total


@dataclass
class Machine:
    """A linear separator: positive for ``one``, negative for ``other``."""

    one: str
    other: str
    weights: np.ndarray
    bias: float


def fit_machine(
    x: np.ndarray, y: np.ndarray, one: str, other: str, penalty: float = 1e-4, rounds: int = 150
) -> Machine:
    """Linear support vector machine by full subgradient steps of the hinge loss (Pegasos step
    sizes), classes weighted alike, the average of the second half of the steps taken."""
    w, mean, b, mean_b = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1]), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    for t in range(1, rounds + 1):
        step = np.float32(1.0 / (penalty * (t + 100)))
        pull = np.where(y * (x @ w + b) < 1, weight * y, np.float32(0))
        w = (1 - step * np.float32(penalty)) * w + step * (pull @ x)
        b += float(pull.sum())
        if t > rounds // 2:
            mean += w
            mean_b += b
    n = rounds - rounds // 2
    return Machine(one, other, mean / n, mean_b / n)


@dataclass
class LanguageModel:
    """Family machines (one versus the rest) and language machines (one versus one)."""

    size: int
    languages: list[str]
    families: list[str]
    family_machines: list[Machine]
    pairs: list[Machine]
    letters: str = ""  #: letters of the texts it was fitted on, in both cases

    @staticmethod
    def fit(x: np.ndarray, langs: list[str], size: int, letters: str = "") -> LanguageModel:
        known = sorted(set(langs))
        groups = sorted({family(v) for v in known})
        tags, fams = np.array(langs, object), np.array([family(v) for v in langs], object)
        first = (
            [fit_machine(x, np.where(fams == f, 1.0, -1.0), f, "") for f in groups]
            if len(groups) > 1 else []
        )
        pairs = []
        for a, b in itertools.combinations(known, 2):
            if family(a) == family(b):
                own = (tags == a) | (tags == b)
                pairs.append(fit_machine(x[own], np.where(tags[own] == a, 1.0, -1.0), a, b))
        return LanguageModel(size, known, groups, first, pairs, letters)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        machines = [*self.family_machines, *self.pairs]
        if not machines:
            return np.zeros((self.size, 0)), np.zeros(0)
        return np.stack([m.weights for m in machines], axis=1), np.array([m.bias for m in machines])

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """Language and a score from 0 to 1 for the margins of all machines."""
        if not self.languages:
            return UNKNOWN, 0.0
        n, score = len(self.family_machines), 1.0
        group = self.families[0]
        if n:
            odds = _sigmoid(margins[:n])
            best = int(np.argmax(odds))
            group, score = self.families[best], float(odds[best])
        members = [v for v in self.languages if family(v) == group]
        votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for m, margin in zip(self.pairs, margins[n:].tolist()):
            if m.one in votes:
                winner = m.one if margin >= 0 else m.other
                votes[winner] += 1
                sums[m.one] += margin
                sums[m.other] -= margin
        best = max(members, key=lambda v: (votes[v], sums[v], v))
        for m, margin in zip(self.pairs, margins[n:].tolist()):
            if best in (m.one, m.other):
                score = min(score, float(_sigmoid(margin if m.one == best else -margin)))
        return best, score


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(4.0 * x, -60, 60)))


def train(
    labelled: DataFrame, per_language: int = 300, sample: int = 3000, size: int = 1 << 13
) -> LanguageModel:
    """Fit on ``labelled`` (text, lang): at most ``per_language`` rows of a language and about
    ``sample`` rows in all, those smallest by the hash of their text, each with its whole text.
    Copies of a text under one language count once, however many there are.

    The sample is drawn and turned into sparse vectors on the executors, so what reaches the driver
    is bounded by the parameters. Rows without text or language are left out; no rows give a model
    without languages. More languages than ``sample`` rows are an error.
    """
    rows = labelled.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    texts_of = rows.select("lang", F.xxhash64("text").alias("th")).distinct()
    counts = texts_of.groupBy("lang").count().limit(sample + 1).collect()
    if len(counts) > sample:
        raise ValueError(f"more than {sample} languages")
    each = min(per_language, max(1, sample // max(1, len(counts))))
    # first about twice the wanted share by hash, then exactly the wanted number by rank
    share = F.lit(1.0)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], (2.0 * each + 64) / row["count"]).otherwise(share)
    draw = (F.xxhash64("text") / F.lit(2.0**64) + 0.5).alias("draw")
    thin = rows.select("lang", "text", draw).where(F.col("draw") < share).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, letters = [], [], []
            for text in texts(batch.column("text")):
                letters.append("".join(sorted(set(_LETTER.findall(text.decode("utf-8", "replace"))))))
                counts, total = gram_counts(text, size)
                own = np.flatnonzero(counts)
                at.append(own.astype(np.int32))
                values.append((counts[own] / total).astype(np.float32))
            yield pa.record_batch(
                {
                    "lang": batch.column("lang"), "draw": batch.column("draw"),
                    "at": pa.array(at, pa.list_(pa.int32())),
                    "v": pa.array(values, pa.list_(pa.float32())),
                    "letters": pa.array(letters, pa.string()),
                }
            )

    ranked = thin.mapInArrow(run, "lang string, draw double, at array<int>, v array<float>, letters string").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    )
    got = sorted(ranked.where(F.col("rank") <= each).collect(), key=lambda r: (r["lang"], r["rank"]))
    x = np.zeros((len(got), size), np.float32)
    for k, r in enumerate(got):
        x[k, r["at"]] = r["v"]
    seen = set().union(*(r["letters"] for r in got))
    both = "".join(sorted(seen.union(*({*c.lower(), *c.upper()} for c in seen))))
    return LanguageModel.fit(x, [r["lang"] for r in got], size, both)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs`` from its text alone; ``und`` with score 0 for
    a null text, a text without a letter, or a model without languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        judge = _Judge(model)
        for batch in batches:
            langs, scores = [], []
            for raw in texts(batch.column("text")):
                lang, score = judge(raw)
                langs.append(lang)
                scores.append(score)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array(langs, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` whose text is in one of the model's languages, ``lang`` set to it. Texts that are null
    or without a letter go, and those most of whose letters occur in no text the model was fitted on
    (another script). Other columns are carried along."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        judge = _Judge(shared.value)
        for batch in batches:
            langs = [judge(raw)[0] if judge.knows(raw) else UNKNOWN for raw in texts(batch.column("text"))]
            at = batch.schema.get_field_index("lang")
            named = batch.set_column(at, batch.schema.field(at), pa.array(langs, batch.schema.field(at).type))
            yield named.filter(pa.array([v != UNKNOWN for v in langs], pa.bool_()))

    return docs.mapInArrow(run, schema)


class _Judge:
    """Applies a model to texts."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.weights, self.bias = model.table()
        known = "".join(f"\\U{ord(c):08x}" for c in model.letters)
        self.strange = regex.compile(rf"[\p{{L}}--[{known}]]" if known else r"\p{L}", regex.VERSION1)

    def knows(self, raw: bytes) -> bool:
        """Whether at least half of the letters are known."""
        text = raw.decode("utf-8", "replace")
        strange = sum(1 for _ in self.strange.finditer(text))
        return not strange or 2 * strange <= sum(1 for _ in _LETTER.finditer(text))

    def __call__(self, raw: bytes) -> tuple[str, float]:
        if not _LETTER.search(raw.decode("utf-8", "replace")):
            return UNKNOWN, 0.0
        counts, total = gram_counts(raw, self.model.size)
        return self.model.decide(counts @ self.weights / total + self.bias)
