"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network learns from spans that the patterns label, shown as they stand and respelled in ways the
patterns miss. It reads texts in overlapping windows; what the windows find is put together over the
whole text. It is trained in numpy; windows are read by ONNX Runtime.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import onnxruntime
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import cut, union_all
from pulsegrid.llm.graphs import graph, node, session, tensor

Span = tuple[str, int, int]

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that fails from its start fails from everywhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_MARK = re.compile("[0-9@]")
_NUMBER = re.compile("[0-9]{2,}")
#: What a reported learned span holds: a digit, an @, or the word at before a dotted name.
_SHOWN = re.compile(r"[0-9@]|\bat\b[^A-Za-z0-9]{1,3}[A-Za-z0-9-]+\.[A-Za-z]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind; a match that
    fails its test is dropped."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # every match holds one @ and starts with all that can stand before it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def plausible(kind: str, value: str) -> bool:
    """The exact test a learned span must pass."""
    numbers = re.findall("[0-9]+", value)
    n = sum(map(len, numbers))
    if kind == "email":
        return ("@" in value or re.search(r"\bat\b", value, re.IGNORECASE) is not None) and "\n" not in value
    if kind == "ip":
        return len(numbers) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in numbers)
    if kind == "card":
        return 14 <= n <= 19 and luhn("".join(numbers))
    return 10 <= n <= 15


# The network: tags are 0 outside, 1 + 2k the first and 2 + 2k a further character of kind k.
_TAGS = 1 + 2 * len(KINDS)
_SYMBOLS = 131
_BARRED = np.float32(-1e4)


def symbols(text: str) -> np.ndarray:
    """Number of each character: digits are alike, and so are letters beyond ASCII; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ids = np.where(points < 128, points + 1, 129)
    ids[points >= 0x2000] = 130
    ids[(points >= 48) & (points < 58)] = 49
    return ids


def _barred() -> np.ndarray:
    """Transitions (from, to) that no span allows; the last row is the start."""
    out = np.zeros((_TAGS + 1, _TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = _BARRED
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights by name; see :meth:`fit`."""

    p: dict[str, np.ndarray]
    hidden: int
    reader: onnxruntime.InferenceSession | None = field(default=None, repr=False, compare=False)

    @staticmethod
    def fresh(rng: np.random.Generator, embed: int, hidden: int) -> Network:
        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        p = {"e": weights(_SYMBOLS, embed) * 4, "o": weights(2 * hidden, _TAGS), "ob": np.zeros(_TAGS, np.float32),
             "t": np.zeros((_TAGS + 1, _TAGS), np.float32)}
        for d in "fb":
            p[d + "x"], p[d + "h"] = weights(embed, 4 * hidden), weights(hidden, 4 * hidden)
            p[d + "b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)  # gates: in, forget, out, new
        return Network(p, hidden)

    def _lstm(self, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H) of inputs (T, B, E), read forwards."""
        size, (steps, batch, _) = self.hidden, x.shape
        pre = x @ self.p[d + "x"] + self.p[d + "b"]
        h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
        out = np.empty((steps, batch, size), np.float32)
        for t in range(steps):
            z = pre[t] + h @ self.p[d + "h"]
            gates, new = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
            before, c = c, gates[:, size : 2 * size] * c + gates[:, :size] * new
            tc = np.tanh(c)
            if keep is not None:
                keep.append((gates, new, before, tc, h))
            h = gates[:, 2 * size :] * tc
            out[t] = h
        return out

    def _lstm_back(self, d: str, x: np.ndarray, keep: list, grad: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient of the inputs from that of the hidden states; weights' gradients go to ``grads``."""
        size, (steps, batch, _) = self.hidden, x.shape
        dz = np.empty((steps, batch, 4 * size), np.float32)
        dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
        for t in range(steps - 1, -1, -1):
            gates, new, before, tc, _ = keep[t]
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t, :, :size] = dc * new * i * (1 - i)
            dz[t, :, size : 2 * size] = dc * before * f * (1 - f)
            dz[t, :, 2 * size : 3 * size] = dh * tc * o * (1 - o)
            dz[t, :, 3 * size :] = dc * i * (1 - new * new)
            dc = dc * f
            dh = dz[t] @ self.p[d + "h"].T
        flat = dz.reshape(-1, 4 * size)
        states = np.stack([k[4] for k in keep]).reshape(-1, size)
        grads[d + "x"] = x.reshape(-1, x.shape[2]).T @ flat
        grads[d + "h"], grads[d + "b"] = states.T @ flat, flat.sum(axis=0)
        return dz @ self.p[d + "x"].T

    def _reader(self) -> onnxruntime.InferenceSession:
        """The network's reading for ONNX Runtime: scores (T, tags, B) of symbols (T, B) and states of
        zeros (H, B). A step multiplies the weights with the last states above the symbols' inputs."""
        size, p = self.hidden, {n: w.astype(np.float32) for n, w in self.p.items()}
        nodes = [node("Gather", "inputs symbol_ids", "rows"), node("Transpose", "rows", "read", perm=[0, 2, 1])]
        tensors = [
            tensor("inputs", np.concatenate([p["e"], np.ones((_SYMBOLS, 1), np.float32)], axis=1)),
            tensor("third", np.full(3, size, np.int64)), tensor("ob", p["ob"][:, None]),
        ]
        for d, back in (("f", 0), ("b", 1)):
            ways = np.concatenate([p[d + "h"], p[d + "x"], p[d + "b"][None]]).T
            tags = p["o"][size:] if back else p["o"][:size]
            tensors += [tensor("gates" + d, ways[: 3 * size]), tensor("new" + d, ways[3 * size :]), tensor("tags" + d, tags.T)]
            step = [
                node("Concat", "h x", "hx", axis=0),
                node("MatMul", f"gates{d} hx", "z"), node("Sigmoid", "z", "gates"),
                node("Split", "gates third", "in forget out", axis=0),
                node("MatMul", f"new{d} hx", "w"), node("Tanh", "w", "new"),
                node("Mul", "forget c", "old"), node("Mul", "in new", "add"), node("Add", "old add", "c_next"),
                node("Tanh", "c_next", "tc"), node("Mul", "out tc", "h_next"), node("MatMul", f"tags{d} h_next", "y"),
            ]
            body = graph(step, [], {"h": 2, "c": 2, "x": 2}, {"h_next": 2, "c_next": 2, "y": 2})
            nodes.append(node(
                "Scan", "zeros zeros read", f"h{d} c{d} score{d}", body=body, num_scan_inputs=1,
                scan_input_directions=[back], scan_output_directions=[back],
            ))
        nodes += [node("Add", "scoref scoreb", "both"), node("Add", "both ob", "score")]
        return session(graph(nodes, tensors, {"symbol_ids": 2, "zeros": 2}, {"score": 3}))

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (T, B, tags) of symbols (T, B). The weights are no longer changed once this is called."""
        if self.reader is None:
            self.reader = self._reader()
        zeros = np.zeros((self.hidden, ids.shape[1]), np.float32)
        return self.reader.run(None, {"symbol_ids": ids, "zeros": zeros})[0].transpose(0, 2, 1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"reader": None}

    def transitions(self) -> np.ndarray:
        return self.p["t"] + _barred()

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths and its gradients."""
        steps, batch = ids.shape
        x, kept = self.p["e"][ids], ([], [])
        both = np.concatenate([self._lstm("f", x, kept[0]), self._lstm("b", x[::-1], kept[1])[::-1]], axis=2)
        score, move = both @ self.p["o"] + self.p["ob"], self.transitions()
        ahead = np.empty_like(score)
        ahead[0] = score[0] + move[-1]
        for t in range(1, steps):
            ahead[t] = score[t] + _logsum(ahead[t - 1][:, :, None] + move[None, :-1], 1)
        behind = np.zeros_like(score)
        for t in range(steps - 2, -1, -1):
            behind[t] = _logsum(move[None, :-1] + (score[t + 1] + behind[t + 1])[:, None, :], 2)
        total = _logsum(ahead[-1], 1)
        share = np.exp(ahead + behind - total[None, :, None])
        at, cols = np.arange(batch), np.arange(steps)[:, None]
        gold = score[cols, at, tags].sum() + move[-1, tags[0]].sum() + move[tags[:-1], tags[1:]].sum()
        loss = float(total.sum() - gold) / batch
        grad = share.copy()
        grad[cols, at, tags] -= 1
        dmove = np.zeros_like(move)
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + move[None, :-1] + (score[t] + behind[t])[:, None, :] - total[:, None, None]
            dmove[:-1] += np.exp(pair).sum(axis=0)
        np.subtract.at(dmove, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        dmove[-1] += share[0].sum(axis=0)
        np.subtract.at(dmove[-1], tags[0], 1)
        grad /= batch
        grads = {"t": dmove / batch, "o": both.reshape(-1, both.shape[2]).T @ grad.reshape(-1, _TAGS), "ob": grad.sum(axis=(0, 1))}
        back = grad @ self.p["o"].T
        dx = self._lstm_back("f", x, kept[0], back[:, :, : self.hidden], grads)
        dx = dx + self._lstm_back("b", x[::-1], kept[1], back[::-1, :, self.hidden :], grads)[::-1]
        grads["e"] = np.zeros_like(self.p["e"])
        np.add.at(grads["e"], ids, dx)
        return loss, grads

    @staticmethod
    def fit(
        pieces: list[tuple[str, list[Span]]], width: int = 96, embed: int = 12, hidden: int = 16,
        rounds: int = 8, batch: int = 24, rate: float = 0.03, seed: int = 11,
    ) -> Network:
        """Trained by Adam on (text, spans) of at most ``width`` code points; the same pieces give the
        same network."""
        rng = np.random.default_rng(seed)
        net = Network.fresh(rng, embed, hidden)
        ids, tags = np.zeros((width, len(pieces)), np.int64), np.zeros((width, len(pieces)), np.int64)
        for k, (text, spans) in enumerate(pieces):
            ids[: len(text), k] = symbols(text)
            for kind, a, b in spans:
                tags[a:b, k] = 2 + 2 * KINDS.index(kind)
                tags[a, k] = 1 + 2 * KINDS.index(kind)
        m = {n: np.zeros_like(v) for n, v in net.p.items()}
        v, step = {n: np.zeros_like(w) for n, w in net.p.items()}, 0
        total = rounds * -(-len(pieces) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(pieces))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                _, grads = net.gradients(ids[:, some], tags[:, some])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                pace = rate * (1 - step / (total + 1)) * min(1.0, 5.0 / max(norm, 1e-9))
                for n, g in grads.items():
                    m[n] += 0.1 * (g - m[n])
                    v[n] += 0.01 * (g * g - v[n])
                    fair = np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8
                    net.p[n] -= (pace / (1 - 0.9**step) * m[n] / fair).astype(np.float32)
        return net

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best tag path (T, B) of each window, and what its scores and those of no span are, by
        position."""
        score, move = self.emissions(ids), self.transitions()
        steps, batch = ids.shape
        none = score[:, :, 0] + move[0, 0]
        maybe = np.flatnonzero(self._may_hold(score, move))
        path, own = np.zeros((steps, batch), np.int64), none.copy()
        if len(maybe):
            path[:, maybe], own[:, maybe] = self._best(np.ascontiguousarray(score[:, maybe]), move)
        return path, own, none

    @staticmethod
    def _may_hold(score: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Whether a window's best path may hold a span: none does where every run of one kind costs
        more than it and leaving it can gain."""
        none = score[:, :, :1] + move[0, 0]
        enter = score[:, :, 1::2] + move[:-1, 1::2].max(axis=0) - none
        enter[0] = score[0, :, 1::2] + move[-1, 1::2] - score[0, :, :1] - move[-1, 0]
        stay = score[:, :, 2::2] - none + np.array([move[[k - 1, k], k].max() for k in range(2, _TAGS, 2)], np.float32)
        run, most = enter[0], enter[0].copy()
        for t in range(1, len(score)):
            run = np.maximum(enter[t], run + stay[t])
            np.maximum(most, run, out=most)
        return most.max(axis=1) + max(0.0, float((move[:-1, 0] - move[0, 0]).max())) >= -1e-3

    @staticmethod
    def _best(score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path (T, B) and its scores."""
        steps, batch = score.shape[:2]
        best, back = score[0] + move[-1], np.zeros(score.shape, np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + move[None, :-1]
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + score[t]
        path = np.empty((steps, batch), np.int64)
        path[-1] = best.argmax(axis=1)
        at = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][at, path[t]]
        own = score[np.arange(steps)[:, None], at, path]
        own[1:] += move[path[:-1], path[1:]]
        own[0] += move[-1, path[0]]
        return path, own


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def respelled(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A piece with each span written in a way the patterns may miss."""
    out, at, marked = "", 0, []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        value, digits = text[a:b], _digits(text[a:b])
        mark = lambda *choices: choices[int(rng.integers(len(choices)))]
        if kind == "email":
            value = value.replace("@", mark(" @ ", "(at)", " (at) ", "[at]", " [at] ", " at "), 1)
        elif kind == "ip":
            value = value.replace(".", mark(" . ", "[.]", ",", "-"))
        elif kind == "card":
            by = mark(".", "/", "  ", "_", " - ")
            value = by.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            by, short = mark("-", ".", " ", "/"), digits[-10:]
            value = mark("", "00 ", "tel ")[:3] + by.join([short[:3], short[3:6], short[6:]])
            if rng.integers(2):
                value = f"({digits[:3]}) {digits[3:6]}{by}{digits[6:]}"
        out += text[at:a]
        start = len(out) + (4 if value.startswith("tel ") else 0)
        out += value
        marked.append((kind, start, len(out)))
        at = b
    return out + text[at:], marked


def _piece(text: str, at: int, width: int) -> tuple[str, int]:
    """The piece of a text around a position, and where it starts."""
    start = max(0, min(at - width // 3, len(text) - width))
    return text[start : start + width], start


def labelled(docs: DataFrame, per_kind: int, width: int, pieces: int = 4) -> list[tuple[str, list[Span]]]:
    """Labelled pieces of ``docs`` (text): at most ``per_kind`` for each kind of span they are cut
    around, and as many around digits that no pattern takes, those smallest by the hash of their
    text; at most ``pieces`` of a text, and a piece once however many texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                if not text or not _MARK.search(text):
                    continue
                spans = base_spans(text)
                centres = [(k, a) for k, a, _ in sorted(spans, key=lambda s: xxhash.xxh64_intdigest(text[s[1] : s[2]]))]
                centres, done = centres[:pieces], 0
                for a, b in sorted((a, b) for _, a, b in spans) + [(len(text), len(text))]:
                    if m := _NUMBER.search(text, done, max(a, done)):
                        centres.append(("", m.start()))
                        break
                    done = max(done, b)
                for kind, at in centres:
                    part, start = _piece(text, at, width)
                    own = [(k, max(0, a - start), min(len(part), b - start)) for k, a, b in spans if a < start + len(part) and b > start]
                    rows.append((kind, xxhash.xxh64_intdigest(part.encode("utf-8", "replace")) >> 1, part, joined(own)))
            if rows:
                kind, draw, part, own = zip(*rows)
                yield pa.record_batch(
                    {"kind": pa.array(kind), "draw": pa.array(draw, pa.int64()), "part": pa.array(part), "spans": pa.array(own)}
                )

    picked = docs.select(F.col("text").cast("string").alias("text"))
    found = cut(picked.mapInArrow(run, "kind string, draw long, part string, spans string").distinct(), "personal-pieces")
    least = union_all([found.where(F.col("kind") == k).orderBy("draw", "spans").limit(per_kind) for k in (*KINDS, "")])
    got = sorted(least.collect(), key=lambda r: (r["draw"], r["kind"], r["spans"]))
    split = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    return [(r["part"], split(r["spans"])) for r in got]


def train(docs: DataFrame, per_kind: int = 200, width: int = 96, spellings: int = 3) -> Network | None:
    """A network fitted on :func:`labelled` pieces, each once as it stands and, where it has spans, in
    so many other ``spellings``. None if no pattern labels anything."""
    pieces = labelled(docs, per_kind, width)
    if not any(spans for _, spans in pieces):
        return None
    rng, more = np.random.default_rng(5), []
    for text, spans in [p for p in pieces if p[1]] * spellings:
        text, spans = respelled(text, spans, rng)
        more.append((text[:width], [(k, a, min(b, width)) for k, a, b in spans if a < width]))
    return Network.fit(pieces + more, width)


def windows(text: str, width: int) -> list[int]:
    """Starts of the windows of a text that hold a digit or an @; a window starts every half width."""
    half, starts, at = width // 2, [], 0
    while m := _MARK.search(text, at):
        first = max(0, m.start() // half - 1)
        for k in (first, first + 1):
            if k * half <= m.start() and k * half not in starts[-2:] and (k == 0 or k * half + half < len(text)):
                starts.append(k * half)
        at = (m.start() // half + 1) * half
    return starts


def every_window(text: str, width: int) -> range:
    """Starts of all windows of a text, which share 96 code points with the next, or half of them if
    that is less; the last one reaches the end."""
    shared = min(width // 2, 96)
    return range(0, max(1, len(text) - shared), width - shared) if text else range(0)


def reconciled(pieces: list[tuple[str, int, int, float, bool, bool]]) -> list[tuple[str, int, int, float]]:
    """Spans of a whole text from those of its windows (kind, start, end, weight, cut off at its
    start, at its end): overlapping ones of a kind that a window edge cuts are one, a cut one that no
    other window confirms goes, and of those that exclude each other the set of most weight stays."""
    whole: list[list] = []
    for kind in KINDS:
        run: list = []
        for _, a, b, w, left, right in sorted(p for p in pieces if p[0] == kind):
            if run and a < run[-1][2] and (left or right or run[-1][4] or run[-1][5]):
                last = run[-1]
                left, right = (last[4] if last[1] < a else left and last[4]), (right if b > last[2] else last[5] if b < last[2] else right and last[5])
                run[-1] = [kind, min(a, last[1]), max(b, last[2]), max(w, last[3]), left, right]
            else:
                run.append([kind, a, b, w, left, right])
        whole += [r for r in run if not r[4] and not r[5]]
    whole.sort(key=lambda r: (r[2], r[1], KINDS.index(r[0])))
    ends, best, back = [r[2] for r in whole], [0.0], [None]
    for k, (_, a, _, w, _, _) in enumerate(whole):
        before = int(np.searchsorted(ends, a, "right"))
        before = min(before, k)
        take = best[before] + w
        back.append(before if take > best[k] else None)
        best.append(max(take, best[k]))
    chosen, k = [], len(whole)
    while k:
        if back[k] is None:
            k -= 1
        else:
            chosen.append(tuple(whole[k - 1][:4]))
            k = back[k]
    return sorted(chosen, key=lambda s: s[1])


def learned_spans(texts: list[str], net: Network, width: int, margin: float, batch: int = 256) -> list[list[Span]]:
    """Spans the network finds in each text, in all its windows, that pass :func:`plausible`."""
    places = [(k, s) for k, text in enumerate(texts) for s in every_window(text, width)]
    # short windows are padded to a multiple of 96, whichever windows they are read with
    steps = [min(width, -(-(len(texts[k]) - s) // 96) * 96) for k, s in places]
    alike: dict[int, list] = {}
    for place, n in zip(places, steps):
        alike.setdefault(n, []).append(place)
    pieces: list[list] = [[] for _ in texts]
    for n, some in ((n, of[at : at + batch]) for n, of in alike.items() for at in range(0, len(of), batch)):
        ids = np.zeros((n, len(some)), np.int64)
        for c, (k, s) in enumerate(some):
            part = symbols(texts[k][s : s + width])
            ids[: len(part), c] = part
        path, own, none = net.decode(ids)
        for c in np.flatnonzero(path.any(axis=0)).tolist():
            k, s = some[c]
            tags, stop = path[:, c], min(width, len(texts[k]) - s)
            firsts = np.flatnonzero(tags[:stop] % 2 == 1)
            for a in firsts.tolist():
                b = a + 1
                while b < stop and tags[b] == tags[a] + 1:
                    b += 1
                weight = float((own[a:b, c] - none[a:b, c]).sum())
                if weight >= margin:
                    pieces[k].append((KINDS[tags[a] // 2], s + a, s + b, weight, a == 0 and s > 0, b == width and s + b < len(texts[k])))
    out = []
    for text, found in zip(texts, pieces):
        spans = []
        for kind, a, b, _ in reconciled(found):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if plausible(kind, text[a:b]):
                spans.append((kind, a, b))
        out.append(spans)
    return out


def scan(docs: DataFrame, net: Network | None, width: int = 768, margin: float = 2.0) -> DataFrame:
    """Personal data of each row of ``docs`` (doc_id, text): rows (doc_id, n_email, n_ip, n_card,
    n_phone, base, spans), the last two as text kind:start:end in code points, end exclusive.

    ``base`` has the fixed patterns; ``spans`` adds what the network finds clear of them, by at least
    ``margin`` over no span there. Every window of ``width`` code points is read; a learned span holds
    a digit, an @ or the word at before a dotted name. Null and empty texts hold nothing. Repeated rows,
    null ids and other columns are of no effect on the scan of a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column("text")]
            base: list[list[Span]] = [[] for _ in texts]
            more: list[list[Span]] = [[] for _ in texts]
            for k, text in enumerate(texts):
                if _MARK.search(text):
                    base[k] = base_spans(text)
            if shared.value is not None:
                for k, found in enumerate(learned_spans(texts, shared.value, width, margin)):
                    more[k] = [s for s in found if _SHOWN.search(texts[k], s[1], s[2]) and all(s[2] <= a or b <= s[1] for _, a, b in base[k])]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in KINDS]
            columns += [pa.array([joined(b) for b in base], pa.string()), pa.array([joined(b + m) for b, m in zip(base, more)], pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    )
