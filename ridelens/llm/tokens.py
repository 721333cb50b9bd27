"""SentencePiece encoding and decoding with a parallel scan over the chunks of giant documents.

The piece at any place of a BPE encoding depends on the text around it only through its neighbours: a
sequence of pieces is the encoding of its text exactly if every two neighbours, taken alone, encode to
themselves.  The encoding is therefore the best path through the lattice of pieces
under max-plus weights: 0 for a pair that stands, minus infinity for one that would merge
differently.

A document longer than ``CHUNK`` characters is cut into chunks at fixed places.  The state at a
boundary is the piece that covers or ends at it; each chunk yields a transfer matrix from the states of
its left boundary to those of its right one (max-plus).  The matrices of a document are combined
associatively from either end, which leaves one state at every boundary, and each chunk is traced back
between its two states on its own.  No piece crosses the place before a blank that follows another
character, so within a chunk only what precedes the first and follows the last such place
needs the lattice; the text between is encoded by the library at once.

Defined cases.  Null or empty text: no tokens, round trip true.  Characters outside the vocabulary:
byte tokens.  A literal U+2581 is a blank to the model, so such a text is reported as no round trip.
Repeated rows: one result each.  Ties can't occur; a document whose scan should not
leave exactly one path is encoded whole (``scan_ok`` false).  Null doc_id: kept.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

BLANK = "▁"
CHUNK = 32_768
ROOM = 64  # characters around a chunk that its states may need: twice the longest piece
NEVER = -np.inf
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Codec:
    """The model, with the lattice of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.sp
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.pieces))
        if 2 * self.longest > ROOM:
            raise ValueError(f"the model has pieces of {self.longest} characters; raise ROOM")
        used = {c for p in self.pieces for c in p}
        # A character that no piece holds stands alone, so what follows it is encoded as it is.
        self._wall = next(c for c in "\n\t\x01\x02" if c not in used)
        self._skip = len(sp.encode(self._wall))
        self._pairs: dict[tuple[str, str], bool] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []

    def inner(self, text: str) -> list[int]:
        """Ids of a piece of escaped text, as it stands inside a document."""
        return self.sp.encode(self._wall + text.replace(BLANK, " "))[self._skip :] if text else []

    def surface(self, ids: list[int]) -> str:
        """The text that pieces inside a document stand for."""
        lead = self.sp.encode(self._wall)
        return self.sp.decode(lead + ids)[len(self.sp.decode(lead)) :]

    def stands(self, a: str, b: str) -> bool:
        """True if the two pieces next to each other encode to themselves."""
        key = (a, b)
        if key not in self._pairs:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            self._pairs[key] = self.inner(a + b) == self.ids(a) + self.ids(b)
        return self._pairs[key]

    def ids(self, piece: str) -> list[int]:
        return [self.pieces[piece]] if piece in self.pieces else self.inner(piece)

    def from_(self, text: str, at: int) -> list[str]:
        """Pieces that begin at ``at``; a character outside the vocabulary is a piece of its own."""
        out = [text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1) if text[at : at + n] in self.pieces]
        return out if text[at : at + 1] in self.pieces else [text[at], *out]

    def covering(self, text: str, at: int) -> list[tuple[int, str]]:
        """(start, piece) of the pieces that begin before ``at`` and end at it or beyond."""
        if is_cut(text, at):
            return [(at, "")]
        return [(s, p) for s in range(max(0, at - self.longest), at) for p in self.from_(text, s) if s + len(p) >= at]


def is_cut(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] == BLANK and text[at - 1] != BLANK


def _walk(codec: Codec, text: str, begin: tuple[int, str], until: int) -> dict[tuple[int, str], list[list[str]]]:
    """From a state to all states at ``until`` (or the end): the pieces on the way, best path each.

    States are (start, piece); the empty piece at a cut stands for any piece that ends there.
    """
    first = (begin[0] + len(begin[1]), begin[1])
    if first[0] >= until:
        return {begin: []}
    layers: dict[int, dict[str, tuple | None]] = {first[0]: {first[1]: None}}
    out: dict[tuple[int, str], tuple] = {}
    for at in range(first[0], until):
        states = layers.get(at)
        if not states:
            continue
        for piece in codec.from_(text, at):
            before = next((s for s in states if not s or codec.stands(s, piece)), None)
            if before is None:
                continue
            end = at + len(piece)
            if end >= until:
                state = (until, "") if is_cut(text, until) and end == until else (at, piece)
                out.setdefault(state, (at, before, piece))
            else:
                layers.setdefault(end, {}).setdefault("" if is_cut(text, end) else piece, (at, before, piece))
    paths = {}
    for state, step in out.items():
        path = []
        while step is not None:
            at, before, piece = step
            path.append(piece)
            step = layers[at][before]
        paths[state] = path[::-1]
    return paths


def _cuts(text: str, low: int, high: int) -> tuple[int, int] | None:
    """The first and the last cut from ``low`` to ``high``."""
    first = next((i for i in range(low, high + 1) if is_cut(text, i)), None)
    if first is None:
        return None
    return first, next(i for i in range(high, low - 1, -1) if is_cut(text, i))


def _chunk_paths(codec: Codec, text: str, low: int, high: int, begin: tuple[int, str]) -> dict[tuple[int, str], list]:
    """From a state at ``low`` to the states at ``high``: the ids of the pieces that begin between."""
    start = begin[0] + len(begin[1])
    cuts = _cuts(text, start, high) if start < high else None
    if not cuts:
        return {s: [i for p in path for i in codec.ids(p)] for s, path in _walk(codec, text, begin, high).items()}
    first, last = cuts
    lead = _walk(codec, text, begin, first).get((first, ""))
    if lead is None and start < first:
        return {}
    ids = [i for p in lead or [] for i in codec.ids(p)] + codec.inner(text[first:last])
    return {s: ids + [i for p in path for i in codec.ids(p)] for s, path in _walk(codec, text, (last, ""), high).items()}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _states(codec: Codec, text: str, at: int, edge: bool) -> list[tuple[int, str]]:
    return [(at, "")] if edge else codec.covering(text, at)


def _chunk(row: tuple) -> tuple[str, int, int, bool, bool]:
    """The escaped chunk with its surroundings: (text, low, high, first, last)."""
    body, before, first, last, size = row
    text = (BLANK if first else "") + body.replace(" ", BLANK)
    low = 0 if first else before
    high = len(text) if last else (len(BLANK) if first else 0) + before + size
    return text, low, high, first, last


def _model_bytes(spark, path: str) -> bytes:
    """The model file, read by Spark (any file system), of the bounded size of a vocabulary."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, tokens, round_trip, scan_ok)`` for each row of ``docs(doc_id, text)``."""
    content = docs.sparkSession.sparkContext.broadcast(_model_bytes(docs.sparkSession, model))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    result = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens array<int>, round_trip boolean, scan_ok boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content.value)
        for part in sliced(batches, most=1 << 20):
            texts = part["text"].to_pylist()
            ids = codec.encode(texts)
            same = [a == b for a, b in zip(codec.decode(ids), texts)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_()), pa.array([True] * len(ids), pa.bool_())],
                ["doc_id", "tokens", "round_trip", "scan_ok"],
            )

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, result)
    return short.unionByName(_encode_giant(rows.filter(F.length("text") > chunk), content, chunk, result))


#: A document's text by its id and hash; equal rows share their chunks.
_KEY = ["doc_key", "text_hash"]


def _chunks(keyed: DataFrame, chunk: int) -> DataFrame:
    """``doc_key, text_hash, no, n, body``: the chunks of every text, cut out in one pass over it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1):
            text = batch["text"][0].as_py()
            n = -(-len(text) // chunk)
            for some in range(0, n, 64):
                here = range(some, min(some + 64, n))
                bodies = [text[k * chunk - (ROOM if k else 0) : (k + 1) * chunk + ROOM] for k in here]
                again = pa.array([0] * len(here))
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c].take(again) for c in _KEY], pa.array(here, pa.int32()), pa.array([n] * len(here), pa.int32()), pa.array(bodies, pa.string())],
                    [*_KEY, "no", "n", "body"],
                )

    return keyed.select(*_KEY, "text").mapInArrow(cut, "doc_key string, text_hash long, no int, n int, body string").dropDuplicates([*_KEY, "no"])


def _encode_giant(rows: DataFrame, content, chunk: int, result: str) -> DataFrame:
    # Never null, so that joins on it keep documents without an id.
    key = F.when(F.col("doc_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string")))
    keyed = rows.select("doc_id", key.alias("doc_key"), F.xxhash64("text").alias("text_hash"), "text")
    chunks = _chunks(keyed, chunk)

    def chunk_of(r) -> tuple:
        first, last = r["no"] == 0, r["no"] == r["n"] - 1
        return _chunk((r["body"], 0 if first else ROOM, first, last, chunk))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content.value)
        for batch in sliced(batches, "body", 1 << 20):
            matrices = []
            for r in batch.to_pylist():
                text, low, high, first, last = chunk_of(r)
                begin, end = _states(codec, text, low, first), _states(codec, text, high, last)
                at = {s: j for j, s in enumerate(end)}
                m = np.full((len(begin), len(end)), NEVER)
                for i, s in enumerate(begin):
                    for state in _chunk_paths(codec, text, low, high, s):
                        j = 0 if last and state[0] + len(state[1]) == high else at.get(state)
                        if j is not None:
                            m[i, j] = 0.0
                matrices.append((m.shape[0], m.ravel().tolist()))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in (*_KEY, "no")], pa.array([m[0] for m in matrices], pa.int32()), pa.array([m[1] for m in matrices], pa.list_(pa.float64()))],
                [*_KEY, "no", "states", "matrix"],
            )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state before and after each chunk: those that lie on a path from start to end."""
        pdf = pdf.sort_values("no")
        ms = [np.array(m, float).reshape(s, -1) for s, m in zip(pdf["states"], pdf["matrix"])]
        forward, backward = [np.zeros((1, 1))], [np.zeros((1, 1))]
        for m in ms:
            forward.append(product(forward[-1], m))
        for m in ms[::-1]:
            backward.append(product(m, backward[-1]))
        on = [np.flatnonzero((f.ravel() + b.ravel()) > NEVER) for f, b in zip(forward, backward[::-1])]
        ok = all(len(x) == 1 for x in on)
        state = [int(x[0]) if ok else -1 for x in on]
        return pd.DataFrame({**{k: pdf[k] for k in (*_KEY, "no")}, "begin": state[:-1], "end": state[1:]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of the pieces that begin in a chunk and whether they decode to their text; of a
        document without one path the chunk's own text instead."""
        codec = Codec(content.value)
        for batch in sliced(batches, "body", 1 << 20):
            ids, same, bodies = [], [], []
            for r in batch.to_pylist():
                text, low, high, first, last = chunk_of(r)
                body = r["body"][(0 if first else ROOM) :][:chunk]
                if r["begin"] < 0:
                    ids.append(None), same.append(None), bodies.append(body)
                    continue
                begin, end = _states(codec, text, low, first)[r["begin"]], _states(codec, text, high, last)[r["end"]]
                paths = _chunk_paths(codec, text, low, high, begin)
                state, path = next((s, p) for s, p in paths.items() if s == end or last and s[0] + len(s[1]) == high)
                covered = text[begin[0] + len(begin[1]) : state[0] + len(state[1])]
                ids.append(path), bodies.append(None)
                same.append(BLANK not in body and codec.surface(path) == covered.replace(BLANK, " "))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in (*_KEY, "no")], pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_()), pa.array(bodies, pa.string())],
                [*_KEY, "no", "ids", "same", "body"],
            )

    fixed = "doc_key string, text_hash long, no int"
    matrices = chunks.mapInArrow(transfer, f"{fixed}, states int, matrix array<double>")
    chosen = matrices.groupBy(*_KEY).applyInPandas(choose, f"{fixed}, begin int, end int")
    traced = chunks.join(chosen, [*_KEY, "no"]).mapInArrow(trace, f"{fixed}, ids array<int>, same boolean, body string")
    in_order = F.array_sort(F.collect_list(F.struct("no", "ids", "body")))
    gathered = traced.groupBy(*_KEY).agg(in_order.alias("parts"), F.bool_and("same").alias("same")).select(
        *_KEY, "same", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), F.array_join(F.transform("parts", lambda x: x["body"]), "").alias("text")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in sliced(batches, "text"):
            if batch["ids"].null_count:  # never seen; such a document is encoded whole
                codec = codec or Codec(content.value)
                ids = [codec.encode([r["text"]])[0] if r["ids"] is None else r["ids"] for r in batch.to_pylist()]
                same = [codec.decode([i])[0] == r["text"] if r["ids"] is None else r["same"] for i, r in zip(ids, batch.to_pylist())]
                found = [pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            else:
                found = [batch["ids"], batch["same"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *found, batch["ids"].is_valid()], ["doc_id", "tokens", "round_trip", "scan_ok"])

    joined = keyed.select("doc_id", *_KEY).join(gathered, _KEY).select("doc_id", "ids", "same", "text")
    return joined.mapInArrow(finish, result)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` for each row of ``tokens(doc_id, tokens)``; null tokens give null text."""
    content = tokens.sparkSession.sparkContext.broadcast(_model_bytes(tokens.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content.value)
        for batch in batches:
            ids = batch["tokens"].to_pylist()
            texts = iter(codec.decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([None if x is None else next(texts) for x in ids], pa.string())], ["doc_id", "text"]
            )

    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
