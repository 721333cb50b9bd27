"""Personal data: exact rules, and spans added by a linear-chain conditional random field.

The rules find e-mail addresses, IP addresses, card and phone numbers as patterns with a check.
The random field labels words by their shape (letters, digits and marks, runs merged) and the
shapes of their neighbours; Viterbi decoding runs in numpy over a batch's words.  Runs of words that it
labels alike and that touch no rule span become further spans: numbers and addresses written
in ways that the patterns miss (``joe(at)mail.org``), or that a pattern swallows whole with
its neighbour and drops (a phone number before a card number).  The span is the value alone (``trimmed``).

It is trained on a small labelled table, the words around rule spans in a bounded sample of
documents, with each span also written in other ways (``_variants``), so that it learns shapes
rather than the patterns themselves.

A word is left out of the decoding only where that can't change the result: where the blank label
leads by more than all transitions together could make up (``_gap``), it is certain and
separates the text into short pieces.

Defined cases.  Null text: empty, no spans.  No labelled words: rules only.  Repeated rows: one
result each.  Very long texts: read once, words in pieces.  Ties in decoding: the label that
is listed first.  Null doc_id: kept.  Other columns are ignored (``find``) or kept (``redact``).
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, sliced

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
BUCKETS = 1 << 12  # of word shapes, by hash
#: Documents that training reads at most (in expectation, by hash of doc_id).
TRAIN_DOCUMENTS = 400
#: Rule spans and places of other marks that a training document gives at most, and words of a training text.
TRAIN_SPANS = 20
TRAIN_PLAIN = 4
TRAIN_WORDS = 48
CONTEXT_WORDS = 6
EPOCHS = 80

_LOCAL = r"[A-Za-z0-9._%+-]"
# The lookbehinds only spare starts inside a run, which fail if the run's first start fails.
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HERE = re.compile(rf"{_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    while text.find("@", end) >= 0:
        # A span may begin right where the last one ended, inside a run of its characters.
        m = (_EMAIL_HERE.match(text, end) if end else None) or _EMAIL.search(text, end)
        if not m:
            return
        yield m.span()
        end = m.end()


def rule_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and not overlapping within a kind; failing matches drop out."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    out["email"] = list(_emails(text))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(_part(x) for x in m.group().split("."))]
    if "+" in text:
        out["phone"] = [
            m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m.group())) <= 15
        ]
    return out


def _part(digits: str) -> bool:
    d = digits.lstrip("0")
    return len(d) < 3 or len(d) == 3 and d <= "255"


# Forms in which the field's words may write a value; a span is the form inside the words labelled alike.
_AT = r"\s?(?:@|[\[(]\s?at\s?[\])])\s?"
_DOT = r"\s?(?:\.|[\[(]\s?dot\s?[\])])\s?"
_FORMS = {
    "email": re.compile(rf"{_LOCAL}++{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    "ip": _IP,
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_-]?[0-9])+"),
    "phone": re.compile(r"(?:\+|(?<![0-9])00)?\(?[0-9][0-9 ()./-]*[0-9]"),
}


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The value inside the words from ``a`` to ``b``, without words of context; None if there is none."""
    found = [m.span() for m in _FORMS[kind].finditer(text, a, b) if plausible(kind, m.group())]
    return max(found, key=lambda s: s[1] - s[0], default=None)


def plausible(kind: str, value: str) -> bool:
    """The check that a span of the field must pass, as a rule span must."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        # Without a country sign, dates and other numbers look alike.
        return 8 <= len(digits) <= 15 if value[:1] == "+" or value[:2] == "00" else 10 <= len(digits) <= 11
    if kind == "ip":
        return all(_part(x) for x in value.split("."))
    return "." in value or "dot" in value.lower()


# --- word shapes ---------------------------------------------------------------------


def word_shape(word: str) -> str:
    """Letters become x, digits become d with their number, other characters stay; runs are merged."""
    out, i = [], 0
    while i < len(word) and len(out) < 24:
        c = word[i]
        j = i + 1
        if c.isdigit():
            while j < len(word) and word[j].isdigit():
                j += 1
            out.append(f"d{min(j - i, 20)}")
        elif c.isalpha():
            while j < len(word) and word[j].isalpha():
                j += 1
            out.append("x")
        else:
            out.append(c)
        i = j
    return "".join(out)


def shape_features(word: str) -> tuple[int, int]:
    """Two buckets: of the shape, and of the kinds of characters in it."""
    shape = word_shape(word)
    kinds = "".join(sorted(set(re.sub(r"d\d+", "d", shape)))) + str(min(9, sum(map(str.isdigit, word)) // 3))
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"k" + kinds.encode("utf-8", "surrogatepass")) % BUCKETS


class Shapes(dict):
    """word -> number of its pair of features, with a bound on what is kept."""

    def __init__(self):
        super().__init__()
        self.pairs: list[tuple[int, int]] = []
        self._numbers: dict[tuple[int, int], int] = {}

    def __missing__(self, word: str) -> int:
        pair = shape_features(word[:200])
        if pair not in self._numbers:
            self._numbers[pair] = len(self.pairs)
            self.pairs.append(pair)
        if len(self) < 200_000:
            self[word] = self._numbers[pair]
        return self._numbers[pair]


# --- the random field -------------------------------------------------------------------


def _features(words: list[str]) -> np.ndarray:
    """Feature numbers of each word: its own, the last word's and the next word's shape and kinds."""
    own = np.array([shape_features(w) for w in words], np.int64).reshape(len(words), 2)
    edge = np.full((1, 2), -1)
    sides = [own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])]
    # Place by place, each with its own weights; -1 becomes the last row, which stays zero.
    return np.hstack([np.where(x >= 0, x + BUCKETS * (2 * k + np.arange(2)), 6 * BUCKETS) for k, x in enumerate(sides)])


def train_field(sentences: list[tuple[list[str], list[int]]], epochs: int = EPOCHS) -> dict:
    """Weights of the field from ``(words, labels)`` sentences, by the gradient of the likelihood.

    Full-batch steps (Adam) on a bounded table; sentences are padded to one length, and forward
    and backward sums run over all of them at once.  The result depends on the sentences alone.
    """
    k = len(LABELS)
    weights = np.zeros((6 * BUCKETS + 1, k), np.float64)
    moves = np.zeros((k, k), np.float64)
    sentences = sorted((w, y) for w, y in sentences if w)
    if not sentences:
        return {"weights": None, "moves": None}
    n, t = len(sentences), max(len(w) for w, _ in sentences)
    feats = np.full((n, t, 6), 6 * BUCKETS)
    gold = np.zeros((n, t), np.int64)
    real = np.zeros((n, t), bool)
    for i, (w, y) in enumerate(sentences):
        feats[i, : len(w)], gold[i, : len(w)], real[i, : len(w)] = _features(w), y, True
    hot = np.eye(k)[gold] * real[:, :, None]
    pairs = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    used, at = np.unique(feats, return_inverse=True)
    at = at.reshape(n, t, 6)
    small = np.zeros((len(used), k))
    first = [np.zeros_like(small), np.zeros_like(moves)]
    second = [np.zeros_like(small), np.zeros_like(moves)]
    padding = int(np.searchsorted(used, 6 * BUCKETS)) if used[-1] == 6 * BUCKETS else -1
    for step in range(1, epochs + 1):
        scores = small[at].sum(axis=2)
        forward, backward = np.zeros((n, t, k)), np.zeros((n, t, k))
        forward[:, 0] = scores[:, 0]
        for j in range(1, t):
            forward[:, j] = np.where(real[:, j, None], scores[:, j] + _logsum(forward[:, j - 1, :, None] + moves, 1), forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            after = (scores[:, j + 1] + backward[:, j + 1])[:, None, :] + moves
            backward[:, j] = np.where(real[:, j + 1, None], _logsum(after, 2), 0)
        whole = _logsum(forward[:, -1], 1)
        own = np.exp(forward + backward - whole[:, None, None]) * real[:, :, None]
        both = forward[:, :-1, :, None] + moves + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        both = np.where(real[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0).sum(axis=(0, 1))
        wrong = hot - own
        rows = at.reshape(-1)
        each = np.repeat(wrong.reshape(-1, k), 6, axis=0)
        grad = np.stack([np.bincount(rows, each[:, c], len(used)) for c in range(k)], axis=1)
        for x, g, m, v in ((small, grad - 0.02 * small, first, second), (moves, pairs - both - 0.02 * moves, first, second)):
            which = 0 if x is small else 1
            m[which] = 0.9 * m[which] + 0.1 * g
            v[which] = 0.999 * v[which] + 0.001 * g * g
            x += 0.2 * (m[which] / (1 - 0.9**step)) / (np.sqrt(v[which] / (1 - 0.999**step)) + 1e-8)
        if padding >= 0:
            small[padding] = 0
    weights[used] = small
    filled = used[np.abs(small).sum(axis=1) > 0]
    return {"rows": filled.tolist(), "weights": np.round(weights[filled], 6).tolist(), "moves": np.round(moves, 6).tolist()}


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """A trained field as an applier: labels of the words of a text."""

    def __init__(self, model: dict):
        self.moves = np.array(model["moves"])
        self._w = np.zeros((6, BUCKETS, len(LABELS)))
        flat = self._w.reshape(6 * BUCKETS, len(LABELS))
        flat[np.array(model["rows"], np.int64)] = np.array(model["weights"])
        self.shapes = Shapes()
        self._tables = np.zeros((3, 0, len(LABELS)))
        self._find = re.compile(WORD)
        m = self.moves
        # How much better two transitions over any label can be than the two over the blank label.
        self._gap = max(
            0.0,
            float((m[:, None, :] + m.T[None, :, :] - m[:, 0][:, None, None] - m[0][None, :, None]).max()),
            float((m - m[:, :1]).max()),
            float((m.T - m[:1].T).max()),
        )

    def _emissions(self, ids: np.ndarray) -> np.ndarray:
        if len(self.shapes.pairs) > self._tables.shape[1]:
            fresh = np.array(self.shapes.pairs[self._tables.shape[1] :], np.int64)
            rows = np.stack([self._w[2 * s][fresh[:, 0]] + self._w[2 * s + 1][fresh[:, 1]] for s in range(3)])
            self._tables = np.concatenate([self._tables, rows], axis=1)
        e = self._tables[0][ids]
        e[1:] += self._tables[1][ids[:-1]]
        e[:-1] += self._tables[2][ids[1:]]
        return e

    def label(self, words: list[str]) -> np.ndarray:
        """The best labels; ties go to the label listed first."""
        out = np.zeros(len(words), np.int8)
        if not words:
            return out
        e = self._emissions(np.fromiter(map(self.shapes.__getitem__, words), np.int64, len(words)))
        open_ = e[:, 0] - e[:, 1:].max(axis=1) <= self._gap
        if not open_.any():
            return out
        edges = np.flatnonzero(np.diff(np.concatenate([[0], open_.view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        # Pieces of like length decode together; long ones make no short one wait in memory.
        order = np.argsort(ends - starts, kind="stable")
        for group in np.array_split(order, max(1, len(order) // 256 + 1)):
            if len(group):
                self._viterbi(e, starts[group], ends[group], out)
        return out

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        length = ends - starts
        longest = int(length.max())
        n = len(starts)
        rows = np.arange(n)
        score = e[starts] + np.where((starts > 0)[:, None], self.moves[0], 0)
        back = np.zeros((longest, n, len(LABELS)), np.int8)
        for j in range(1, longest):
            alive = length > j
            options = score[:, :, None] + self.moves
            back[j] = options.argmax(axis=1)
            best = options.max(axis=1) + e[np.minimum(starts + j, len(e) - 1)]
            score = np.where(alive[:, None], best, score)
        score = score + np.where((ends < len(e))[:, None], self.moves[:, 0], 0)
        state = score.argmax(axis=1)
        for j in range(longest - 1, -1, -1):
            alive = length > j
            out[(starts + j)[alive]] = state[alive]
            if j:
                state = np.where(alive, back[j, rows, state], state)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        labels = self.label(self._find.findall(text))
        at = np.flatnonzero(labels)
        if not len(at):
            return found
        places = [m.span() for m in self._find.finditer(text)]
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] == at[j] + 1 and labels[at[j + 1]] == labels[at[i]]:
                j += 1
            kind = LABELS[labels[at[i]]]
            span = trimmed(kind, text, places[at[i]][0], places[at[j]][1])
            if span:
                found.append((kind, *span))
            i = j + 1
        return found


# --- training table ------------------------------------------------------------------------


def labelled_words(text: str, spans: dict[str, list[tuple[int, int]]]) -> tuple[list[str], list[int]]:
    words, labels = [], []
    flat = sorted((a, b, KINDS.index(k) + 1) for k, own in spans.items() for a, b in own)
    for m in re.finditer(WORD, text):
        words.append(m.group())
        labels.append(next((y for a, b, y in flat if a < m.end() and m.start() < b), 0))
    return words, labels


def _variants(kind: str, value: str) -> list[str]:
    """Other ways to write a value of this kind, which the patterns miss."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "email":
        local, _, domain = value.partition("@")
        plain = re.sub(r"[^A-Za-z.]", "", local).strip(".") or "info"
        bare = re.sub(r"[0-9]", "", domain)
        return [f"{x}{at}{y}" for at, x, y in (("[at]", local, domain), ("(at)", plain, bare), (" [at] ", plain, domain), (" (at) ", local, bare), ("(at)", local, domain), ("[at]", plain, bare))]
    if kind == "ip":
        return [value + ":8080", f"[{value}]", value + "/24"]
    if kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [value.replace("+", "00", 1), value.replace("+", "tel:", 1), f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"]
    return [".".join(re.findall(".{1,4}", digits)), "/".join(re.findall(".{1,4}", digits)), value.replace(" ", ".")]


def _some(variants: list[str], value: str, most: int = 3) -> list[str]:
    """``most`` of the variants, others for other values."""
    at = zlib.crc32(value.encode("utf-8", "surrogatepass"))
    return [variants[(at + k) % len(variants)] for k in range(min(most, len(variants)))]


def training_table(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``(words, labels)`` around the rule spans of about ``most`` documents of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", "text").dropna().filter(F.col("text").rlike("[0-9]") | (F.pmod(F.xxhash64("doc_id"), F.lit(7)) == 0))
    total = rows.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.filter(place < min(1.0, most / max(1, total))).select("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labels = [], []
            for x in batch["text"]:
                for w, y in _sentences(x.as_py()):
                    words.append(w[:TRAIN_WORDS])
                    labels.append(y[:TRAIN_WORDS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))], ["words", "labels"]
            )

    return sample.mapInArrow(label, "words array<string>, labels array<int>")


def _sentences(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Short labelled texts around each rule span and its variants, and some words without any."""
    spans = rule_spans(text)
    flat = [(k, a, b) for k, own in spans.items() for a, b in own]
    for k, a, b in flat[:TRAIN_SPANS]:
        before = " ".join(re.findall(WORD, text[max(0, a - 120) : a])[-CONTEXT_WORDS:])
        after = " ".join(re.findall(WORD, text[b : b + 120])[:CONTEXT_WORDS])
        for value in [text[a:b], *_some(_variants(k, text[a:b]), text[a:b])]:
            left, right = (before + " ", " " + after) if before else ("", " " + after)
            whole = left + value + right
            others = rule_spans(whole)
            others = {x: [(i, j) for i, j in own if j <= len(left) or i >= len(left) + len(value)] for x, own in others.items()}
            others[k] = [*others[k], (len(left), len(left) + len(value))]
            yield labelled_words(whole, others)
    # Words without personal data, those with other marks and digits among them.
    odd = [m.start() for m in re.finditer(r"[0-9]|[^\w\s.,]", text)]
    for at in [*odd[:: max(1, len(odd) // 3)][:TRAIN_PLAIN], len(text) // 2]:
        piece = " ".join(re.findall(WORD, text[max(0, at - 80) : at + 80])[1:-1])
        if piece:
            yield labelled_words(piece, rule_spans(piece))


def train(docs: DataFrame) -> dict:
    """The field of a bounded sample of ``docs``; the driver gets the bounded labelled table."""
    rows = training_table(docs).collect()
    return train_field([(list(r["words"]), list(r["labels"])) for r in rows])


# --- application ------------------------------------------------------------------------------


def _finder(model: str):
    weights = json.loads(model)
    field = Field(weights) if weights["weights"] else None

    def find(text: str | None) -> tuple[dict, list[tuple[str, int, int]]]:
        """Rule spans by kind, and the field's further spans."""
        base = rule_spans(text)
        added = field.spans(text) if field and text else []
        if added:
            taken = sorted(s for own in base.values() for s in own)
            added = [x for x in added if not any(a < x[2] and x[1] < b for a, b in taken)]
        return base, added

    return find


def find(docs: DataFrame, model: dict) -> DataFrame:
    """For each row of ``docs(doc_id, text)`` the numbers of rule spans, their digest, and all spans.

    ``spans`` has ``kind:start:end`` (code points, end exclusive) by kind as in ``KINDS``, then start.
    """
    packed = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _finder(packed)
        for batch in sliced(batches):
            counts, digests, spans = [[] for _ in KINDS], [], []
            for x in batch["text"]:
                base, added = search(x.as_py())
                for k, kind in enumerate(KINDS):
                    counts[k].append(len(base[kind]))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                every = {k: sorted(base[k] + [(a, b) for kind, a, b in added if kind == k]) for k in KINDS}
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with every span replaced by its kind (``<EMAIL>``), overlapping spans as one;
    ``n_chars``, if there, is the new length where the text changed."""
    packed, schema = json.dumps(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _finder(packed)
        for batch in sliced(batches):
            texts = batch["text"].to_pylist()
            new = [_masked(t, search(t)) if t else t for t in texts]
            columns = {name: batch[name] for name in batch.schema.names}
            columns["text"] = pa.array(new, batch["text"].type)
            if "n_chars" in columns:
                sizes = [len(n) if n != t else s for t, n, s in zip(texts, new, batch["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(sizes, batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def _masked(text: str, found: tuple[dict, list]) -> str:
    base, added = found
    flat = sorted([(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, k) for k, a, b in added])
    out, at, i = [], 0, 0
    while i < len(flat):
        a, b, k = flat[i]
        while i + 1 < len(flat) and flat[i + 1][0] < b:
            i += 1
            b = max(b, flat[i][1])
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
        i += 1
    return "".join([*out, text[at:]])
