"""Secret scans: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

Span = tuple[str, int, int]

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Any run of a length that can pass; found fast, then the whole pattern is judged by itself.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Lengths of the hex text of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512, the names that
#: announce a digest, and the usual form of a universally unique identifier: fixed values.
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
_ANNOUNCED = re.compile(
    r"(?<![A-Za-z])(?:md5|sha-?(?:1|224|256|384|512)|digest|checksum|commit|etag|fingerprint)(?:sum)?"
    r"[\"']?\x20{0,3}[:=(-]?\x20{0,3}[\"']?\Z",
    re.IGNORECASE | re.ASCII,
)
_HEX_TAIL = re.compile(r"[0-9a-fA-F]*\Z")
#: Digests of nothing, which stand for "no content" in many a listing.
_EMPTY = {hashlib.new(n, b"").hexdigest() for n in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: snake_case, kebab-case, CamelCase and paths of words, each word with at most a short number.
_IDENTIFIER = re.compile(r"[/_-]*(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Z](?=[A-Z][a-z]))\d{0,4}[/_-]*)+\Z")

_BREAKS = set("=-_/+")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind."""
    found: list[Span] = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append(("assign", m.start(), m.end()))
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            found.append(("access", m.start(), m.end()))
    for m in _LONG_HEX.finditer(text):
        found.append(("hex", m.start(), m.end()))
    return found


def entropy(value: str) -> float:
    """Bits per character of a string by its own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))


def known_digest(text: str, start: int, value: str) -> bool:
    """A hex string of a digest's length that a name before it (md5:, sha256=, commit ...) announces,
    or the digest of nothing. Any other hex string may be a key."""
    tail = _HEX_TAIL.search(value)  # a name joined by = or - is in the run itself
    start, value = start + tail.start(), tail.group()
    if not _DIGEST.match(value):
        return False
    return value.lower() in _EMPTY or bool(_ANNOUNCED.search(text[max(0, start - 24) : start]))


def token_spans(text: str, count: Callable[[str], int], ratio: float, bits: float) -> list[Span]:
    """Runs of 16 or more key characters that the vocabulary splits into short tokens: fewer than
    ``ratio`` characters per token, and at least ``bits`` of entropy a character, so that rules and
    repeated filler are left alone. Known digests, identifiers, plain words and numbers are not
    looked at; letters alone are."""
    found: list[Span] = []
    for m in _CANDIDATE.finditer(text):
        value = m.group().strip("=-_/+")
        start = m.start() + len(m.group()) - len(m.group().lstrip("=-_/+"))
        if (
            len(value) < 16
            or not re.search(r"[A-Za-z]", value)
            or _UUID.match(value)
            or _IDENTIFIER.match(value)
            or known_digest(text, start, value)
            or entropy(value) < bits
        ):
            continue
        if len(value) < ratio * count(value):
            found.append(("random", start, start + len(value)))
    return found


def uncovered(text: str, spans: list[Span], base: list[Span], least: int = 4) -> list[Span]:
    """The parts of ``spans`` that no span of ``base`` covers. Parts of a cut span that are shorter than
    ``least``, or an identifier set apart from the base span by a separator (the name before a
    value), are left out."""
    found: list[Span] = []
    blocks = sorted((a, b) for _, a, b in base)
    for kind, start, end in spans:
        at = start
        for a, b in [*blocks, (end, end)]:
            if b <= at and a < end:
                continue
            stop = min(a, end)
            part = text[at:stop]
            apart = (at > start and part[:1] in _BREAKS) or (stop < end and part[-1:] in _BREAKS)
            name = apart and _IDENTIFIER.match(part.strip("=+"))
            if (at, stop) == (start, end) or (stop - at >= least and not name):
                found.append((kind, at, stop))
            if a >= end:
                break
            at = max(at, b)
    return found


def all_spans(text: str, count: Callable[[str], int], ratio: float, bits: float) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed patterns, and what the token-efficiency test adds outside them."""
    base = base_spans(text)
    return base, uncovered(text, token_spans(text, count, ratio, bits), base)


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def _counter(vocabulary: str) -> Callable[[str], int]:
    """Tokens of a string under a tiktoken vocabulary file of the given name or path."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:  # a file of the installed package, the same on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return lambda value: len(coder.encode_ordinary(value))


def scan(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ratio: float = 2.2, bits: float = 3.0
) -> DataFrame:
    """Secrets of each row of ``docs`` (doc_id, text): rows (doc_id, n_assign, n_access, n_hex,
    base, spans), the last two as text kind:start:end in code points, end exclusive.

    ``base`` has the fixed patterns; ``spans`` adds what the token-efficiency test finds (kind random),
    of a run that meets a base span the parts outside it. Null and empty texts hold none. Repeated rows, null ids and other columns
    are of no effect on the scan of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base, more = all_spans(text, count, ratio, bits)
                counts = [sum(k == s[0] for s in base) for k in KINDS[:3]]
                rows.append((*counts, joined(base), joined(base + more)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"
    )


def redact(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ratio: float = 2.2, bits: float = 3.0
) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``[secret]``; overlapping spans are
    replaced as one, and ``n_chars``, where there is one, follows. Rows without a secret are
    unchanged."""
    schema = docs.schema
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for batch in batches:
            out, sizes = [], []
            for value in batch.column("text"):
                text = value.as_py()
                if text:
                    base, more = all_spans(text, count, ratio, bits)
                    done, end = [], 0
                    for _, a, b in sorted(base + more, key=lambda s: s[1:]):
                        if a >= end:
                            done += [text[end:a], "[secret]"]
                        end = max(end, b)
                    text = "".join(done) + text[end:]
                    sizes.append(len(text) if done else None)
                else:
                    sizes.append(None)
                out.append(text)
            at = batch.schema.get_field_index("text")
            done = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if counted:
                at = batch.schema.get_field_index("n_chars")
                kind = batch.schema.field(at)
                fresh = pc.coalesce(pa.array(sizes, kind.type), batch.column("n_chars"))
                done = done.set_column(at, kind, fresh)
            yield done

    return docs.mapInArrow(run, schema)


def sha256(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
