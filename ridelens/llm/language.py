"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A letter n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place; a document's vector bundles (adds) its
n-grams' vectors, and a language's prototype bundles its training documents' unit vectors.  A
document gets the language of the prototype with the greatest cosine.

Letters are lower-cased; runs of anything else become one blank, which counts as a letter of the
n-grams.  Letter vectors depend on the character and a seed only, so tasks agree without sharing
a table.

Defined cases.  Null text or text without a letter: ``und``, score 0.  No training rows: ``und``
for all.  Equal cosines: the first language by name.  Null doc_id: scored, never trained on.
Repeated rows: one result each.  Other columns are ignored (``identify``) or kept (``keep_known``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_blocks

DIMENSIONS = 1024
NGRAM = 3
SEED = 17
#: Training documents taken for each language, those with the smallest hashes of doc_id (a bound in
#: expectation; a language with fewer gives all of its documents).
TRAIN_PER_LANGUAGE = 4000
UNKNOWN = "und"


class Encoder:
    """Document vectors; keeps the letter vectors that it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = SEED):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self._index: dict[int, int] = {}
        self._letters = np.zeros((0, dimensions), np.float32)
        self._grams: dict[int, int] = {}
        self._vectors = np.zeros((0, dimensions), np.int8)
        self._table = np.full(0x3000, -1, np.int32)  # code point -> letter number; -1: not met
        self._letter_number(" ")

    def _letter_number(self, char: str) -> int:
        point = ord(char)
        if point not in self._index:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, point])).integers(0, 2, self.dimensions)
            self._letters = np.vstack([self._letters, (bits * 2 - 1).astype(np.float32)])
            self._index[point] = len(self._index)
        return self._index[point]

    def _letters_of(self, text: str) -> np.ndarray:
        """Letter numbers with single blanks (number 0) for all else, one at either end."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = points < len(self._table)
        numbers = self._table[np.where(low, points, 0)]
        for p in np.unique(points[(numbers < 0) | ~low]):
            n = self._letter_number(chr(p)) if chr(p).isalpha() else 0
            if p < len(self._table):
                self._table[p] = n
        if not low.all():
            rare = {int(p): self._index.get(int(p), 0) for p in np.unique(points[~low])}
            numbers = self._table[np.where(low, points, 32)]
            numbers[~low] = [rare[int(p)] for p in points[~low]]
        else:
            numbers = self._table[points]
        numbers = np.concatenate([[0], numbers, [0]])
        keep = numbers != 0
        keep[1:] |= numbers[:-1] != 0
        keep[0] = True
        return numbers[keep]

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ``_vectors`` for n-gram keys; new ones are bound and kept, up to a bound."""
        if len(self._grams) > 60_000:
            self._grams, self._vectors = {}, self._vectors[:0]
        fresh = [g for g in grams.tolist() if g not in self._grams]
        if fresh:
            keys = np.array(fresh, np.int64)
            vectors = np.ones((len(keys), self.dimensions), np.float32)
            for place in range(self.n):
                letter = (keys >> (21 * (self.n - 1 - place))) & ((1 << 21) - 1)
                vectors *= np.roll(self._letters, self.n - 1 - place, axis=1)[letter]
            start = len(self._grams)
            if start + len(keys) > len(self._vectors):
                grown = np.zeros((max(4096, 2 * (start + len(keys))), self.dimensions), np.int8)
                grown[:start] = self._vectors[:start]
                self._vectors = grown
            self._vectors[start : start + len(keys)] = vectors
            self._grams.update(zip(fresh, range(start, start + len(keys))))
        return np.fromiter(map(self._grams.__getitem__, grams.tolist()), np.int64, len(grams))

    def vectors(self, texts: list) -> np.ndarray:
        """One bundled vector for each text; zero for a text without a letter."""
        return self.bundle(texts)[0]

    def bundle(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The texts' vectors, and how many n-grams each of them adds up.

        The counts of the texts' n-grams form a small dense matrix, multiplied with the n-grams'
        vectors a few thousand n-grams at a time.
        """
        keys, owners = [], []
        for i, text in enumerate(texts):
            letters = self._letters_of(text) if text else np.zeros(0, np.int64)
            if letters.any():
                letters = np.concatenate([letters, np.zeros(max(0, self.n - len(letters)), letters.dtype)]).astype(np.int64)
                m = len(letters) - self.n + 1
                key = np.zeros(m, np.int64)
                for place in range(self.n):
                    key = (key << 21) | letters[place : place + m]
                keys.append(key)
                owners.append(np.full(m, i, np.int64))
        total, sizes = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), np.int64)
        if keys:
            grams, at = np.unique(np.concatenate(keys), return_inverse=True)
            owner = np.concatenate(owners)
            sizes = np.bincount(owner, minlength=len(texts))
            for start in range(0, len(grams), 8192):
                here = grams[start : start + 8192]
                mine = (at >= start) & (at < start + 8192) if len(grams) > 8192 else slice(None)
                cells = owner[mine] * len(here) + (at[mine] - start)
                counts = np.bincount(cells, minlength=len(texts) * len(here)).reshape(len(texts), len(here))
                rows = self._rows(here)
                total += counts.astype(np.float32) @ self._vectors[rows].astype(np.float32)
        return total, sizes


def _blocks(texts: list) -> Iterator[list]:
    """Short lists of texts, so that a list's count matrix stays small."""
    for r in text_blocks(texts, 200_000):
        for start in range(r.start, r.stop, 128):
            yield texts[start : min(start + 128, r.stop)]


def train(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> dict[str, list[float]]:
    """Prototypes of ``labelled(doc_id, text, lang)``: ``{language: vector}``.

    The driver receives one vector for each language; languages are a short list by nature.
    The sample depends on doc_id alone, so a recomputed task takes the same rows.
    """
    rows = labelled.select("doc_id", "text", "lang").dropna()
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.filter(place < share[F.col("lang")]).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            langs = iter(batch["lang"].to_pylist())
            for texts in _blocks(batch["text"].to_pylist()):
                for v in encoder.vectors(texts).astype(np.float64):
                    lang, norm = next(langs), float(np.linalg.norm(v))
                    if norm:
                        sums[lang] = sums.get(lang, 0) + v / norm
        names = sorted(sums)
        place = list(range(DIMENSIONS)) * len(names)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x for x in names for _ in range(DIMENSIONS)], pa.string()),
                pa.array(place, pa.int32()),
                # Whole numbers, so that sums don't depend on the order of the tasks.
                pa.array(np.rint(np.concatenate([sums[x] for x in names]) * 2**20).astype(np.int64) if names else [], pa.int64()),
            ],
            ["lang", "place", "value"],
        )

    parts = sample.mapInArrow(bundle, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, list[float]] = {}
    for r in parts.collect():
        out.setdefault(r["lang"], [0.0] * DIMENSIONS)[r["place"]] = r["value"] / 2**20
    return out


def cut(different: float, least: float, per_ngram: float, most: float) -> float:
    """The cosine that a text must reach, by the number of its different n-grams: chance gives any text
    about the same cosine, a language's own text the more the longer it is."""
    return max(least, min(most, per_ngram * different))


def _classifier(prototypes: dict[str, list[float]]):
    """texts -> [(language, cosine in 0 to 1, about how many different n-grams)]; with unequal counts c
    the last is (sum c)^2 / sum c^2, whose denominator is the vector's squared length over its dimensions."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in names], np.float64).reshape(len(names), DIMENSIONS)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    encoder = Encoder()

    def classify(texts: list) -> list[tuple[str, float]]:
        if not names:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        out = []
        for block in _blocks(texts):
            v, sizes = encoder.bundle(block)
            v = v.astype(np.float64)
            norm = np.linalg.norm(v, axis=1)
            different = sizes**2.0 * DIMENSIONS / np.maximum(norm, 1e-9) ** 2
            cosines = v @ matrix.T / np.maximum(norm, 1e-9)[:, None]
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(block)), best], 0, 1)
            out += [(names[k], float(x), float(m)) if n else (UNKNOWN, 0.0, 0.0) for k, x, m, n in zip(best, score, different, norm)]
        return out

    return classify


def identify(docs: DataFrame, prototypes: dict[str, list[float]]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs(doc_id, text)``."""
    model = json.dumps(prototypes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(json.loads(model))
        for batch in sliced(batches):
            found = classify(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {_type(docs, 'doc_id')}, lang_pred string, score double")


def keep_known(docs: DataFrame, prototypes: dict[str, list[float]], least: float, per_ngram: float = 0.0, most: float = 1.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with the cosine that ``cut`` asks for."""
    model = json.dumps(prototypes)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(json.loads(model))
        for batch in sliced(batches):
            found = classify(batch["text"].to_pylist())
            yield batch.filter(pa.array([k != UNKNOWN and x >= cut(n, least, per_ngram, most) for k, x, n in found], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def held_out(doc_id="doc_id"):
    """True for the third of the documents that training never reads."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
