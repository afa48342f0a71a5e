"""Unigram encoding and decoding with the pieces of a SentencePiece model."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import remembered, texts
from fleetlens.llm.vocabulary import MARKER, Vocabulary, read_vocabulary

REMEMBERED = 600_000
#: What an unknown character costs beyond the least likely piece.
UNKNOWN_PENALTY = 10.0

_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


@dataclass(frozen=True)
class DoubleArray:
    """A trie in two arrays: the child of ``s`` by character ``c`` is ``base[s] +
    codes[c]`` if ``check`` of it is ``s``; ``value`` is the piece that ends there, or -1."""

    codes: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(keys: list[str]) -> DoubleArray:
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for k, key in enumerate(keys):
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][c]
        ends[at] = k
    used = sorted({c for key in keys for c in key})
    codes = {c: i + 1 for i, c in enumerate(used)}
    size = 2 * len(children) + 2 * len(codes) + 2
    base, check, value, taken = [0] * size, [-1] * size, [-1] * size, bytearray(size)
    check[0], taken[0] = 0, 1
    place, queue = {0: 0}, [0]
    for node in queue:
        here = place[node]
        value[here] = ends[node]
        if not children[node]:
            continue
        offsets = sorted(codes[c] for c in children[node])
        at = taken.find(0, offsets[0] + 1)
        while at >= 0 and (at - offsets[0] + offsets[-1] >= size or any(taken[at - offsets[0] + o] for o in offsets)):
            at = taken.find(0, at + 1)
            if at < 0 or at - offsets[0] + offsets[-1] >= size:
                break
        if at < 0 or at - offsets[0] + offsets[-1] >= size:
            base, check, value, taken = base + [0] * size, check + [-1] * size, value + [-1] * size, taken + bytearray(size)
            at, size = size + offsets[0], 2 * size
        start = base[here] = at - offsets[0]
        for c, child in children[node].items():
            slot = start + codes[c]
            check[slot], taken[slot], place[child] = here, 1, slot
            queue.append(child)
    base, check, value = (np.array(x, np.int32) for x in (base, check, value))
    return DoubleArray(codes, base, check, value)


def log_scores(vocabulary: Vocabulary, shift: float = 2.7) -> list[float]:
    """Log-probabilities by rank, ``p ~ 1 / (rank + shift)``; the rank is that of the
    model's own score, ties by id. A merge model has ranks only, no frequencies."""
    order = sorted(range(len(vocabulary.pieces)), key=lambda k: (-vocabulary.pieces[k][2], vocabulary.pieces[k][1]))
    total = math.log(math.fsum(1 / (r + shift) for r in range(len(order))))
    out = [0.0] * len(order)
    for rank, k in enumerate(order):
        out[k] = -math.log(rank + shift) - total
    return out


class Codec:
    """Encodes and decodes; words are remembered within a bound."""

    def __init__(self, vocabulary: Vocabulary, scores: list[float], trie: DoubleArray) -> None:
        self.ids = [i for _, i, _ in vocabulary.pieces]
        self.scores, self.codes = scores, trie.codes
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocabulary.bytes
        self.words_apart = vocabulary.words_apart
        self.spelled = {i: p.encode() for p, i, _ in vocabulary.pieces} | {i: bytes([b]) for b, i in enumerate(vocabulary.bytes)}
        self.known: dict[str, bytes] = {}

    def viterbi(self, word: str) -> list[int]:
        """The best segmentation; of equal ones that with the longest last piece."""
        n, codes, base, check, value, scores = len(word), self.codes, self.base, self.check, self.value, self.scores
        letters = [codes.get(c, 0) for c in word]
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        size = len(check)
        for i in range(n):
            so_far, state, j, single = best[i], 0, i, False
            while j < n and letters[j]:
                child = base[state] + letters[j]
                if child >= size or check[child] != state or child == 0:
                    break
                state, j = child, j + 1
                piece = value[state]
                if piece >= 0:
                    single |= j == i + 1
                    if so_far + scores[piece] > best[j]:
                        best[j], back[j] = so_far + scores[piece], (i, piece)
            if not single and so_far + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = so_far + self.unknown, (i, -1)
        parts, end = [], n
        while end:
            start, piece = back[end]
            parts.append((start, end, piece))
            end = start
        out: list[int] = []
        for start, end, piece in reversed(parts):
            if piece >= 0:
                out.append(self.ids[piece])
            else:
                out.extend(self.bytes[b] for b in word[start:end].encode("utf-8", "surrogatepass"))
        return out

    def _word(self, word: str) -> bytes:
        data = np.array(self.viterbi(word), np.int32).tobytes()
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = data
        return data

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, after the marker that stands before every text."""
        if not text:
            return np.zeros(0, np.int32)
        text = MARKER + text.replace(" ", MARKER)
        known, word = self.known.get, self._word
        words = _WORD.findall(text) if self.words_apart else [text]
        return np.frombuffer(b"".join([known(w) or word(w) for w in words]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes are put together, markers become spaces, and the first
        one goes. Bytes that are no UTF-8 become U+FFFD; ids of no piece say nothing."""
        spelled = self.spelled
        text = b"".join([spelled.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")
        return text.replace(MARKER, " ").removeprefix(" ")


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, round_trip)`` for every row of ``docs(doc_id, text)``.

    ``ids`` is the likeliest segmentation by the pieces' log scores; characters of
    no piece are spelled in byte pieces. ``round_trip`` tells that decoding the ids
    gives the text again; it is false only for texts that hold the marker itself,
    which is read as a space. A null or empty text has no ids. Rows and doc_ids,
    null or repeated, come as they are; other columns are not looked at.
    """
    vocabulary = read_vocabulary(model_path)
    trie, scores = double_array([p for p, _, _ in vocabulary.pieces]), log_scores(vocabulary)
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = remembered(("codec", model_path), lambda: Codec(vocabulary, scores, trie))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = texts(part.column("text"))
                ids = [codec.encode(t) for t in rows]
                same = [codec.decode(i) == t for i, t in zip(ids, rows, strict=True)]
                sizes = np.array([len(i) for i in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                        pa.array(sizes), pa.array(same, pa.bool_()),
                    ],
                    schema=pa.schema(fields),
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "doc_id long, ids array<int>, n_tokens long, round_trip boolean"
    )


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of every row of ``encoded(doc_id, ids)``; null ids give a null text."""
    vocabulary = read_vocabulary(model_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, [0.0] * len(vocabulary.pieces), double_array([]))
        for batch in batches:
            values = [None if i is None else codec.decode(np.array(i, np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(values, pa.string())})

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")
