"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import (
    WordHashes, as_longs, content_key, forget, keep, mix, remembered, shingles, texts, tidy,
)
from fleetlens.llm.linking import band_hashes, link_contents, tune_bands

#: Weights are 1 to 2 in steps of 1 / STEPS.
STEPS = 8


@dataclass(frozen=True)
class Settings:
    """``slots`` rows hold the random numbers that the sampling shares among shingles."""

    similarity: float = 0.8
    recall: float = 0.998
    slots: int = 1 << 13
    seed: int = 20


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, text_key, class_id, kept)`` for every row of ``docs(doc_id, text)``.

    A document is the weighted set of its five-word shingles: frequency in the text
    times ``1 + ln((N+1)/(df+1)) / ln(N+1)``, rounded to steps of 1 / ``STEPS``; ``df``
    is counted for every shingle. Improved consistent weighted sampling
    draws 48 samples of it (two sets agree in one with the probability of their
    weighted Jaccard similarity); bands of four bring candidates together;
    candidates are verified by exact weighted Jaccard >= ``similarity``, and
    components of verified links are the classes.

    ``class_id`` is the smallest doc_id of the class, and ``kept`` marks its rows.
    Equal texts are always in one class. Null and empty texts, and texts of white
    space only, are one class per text, as they are equal texts; rows that repeat a
    doc_id inside a class share its fate; a null doc_id is kept only in a class that
    has no other. Shorter texts are one shingle. Other columns of ``docs`` are not
    looked at. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    by_text = keep(
        docs.groupBy(content_key("text").alias("node")).agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("text").alias("text")
        ),
        "texts",
    )
    n = by_text.agg(F.sum("n")).first()[0] or 0
    bands, rows = tune_bands(settings.similarity, settings.recall)
    contents = keep(
        with_levels(
            by_text, n, _sign(settings, bands, rows), "node binary, doc_id long, bands array<long>, levels binary"
        ),
        "contents",
    )

    def sets(candidates: DataFrame) -> DataFrame:
        wanted = contents.select("node", "levels").join(candidates, "node", "left_semi")
        size = F.lpad(F.hex(F.length("levels")), 8, "0")
        data = F.concat(F.unhex(size), "levels", F.coalesce("text", F.lit("")).cast("binary"))
        return wanted.join(by_text.select("node", "text"), "node").select("node", data.alias("data"))

    roots = link_contents(contents.select("node", "bands"), sets, settings.similarity, weighted=True, read=weighted_set)
    placed = contents.select("node", "doc_id").join(roots, "node", "left")
    linked = placed.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = keep(
        linked.join(least, "root").select("node", "class_id").unionByName(
            placed.filter("root is null").select("node", F.col("doc_id").alias("class_id"))
        ),
        "classes",
    )
    forget(by_text, contents, roots)
    return (
        docs.select("doc_id", content_key("text").alias("node"))
        .join(classes, "node")
        .select("doc_id", F.col("node").alias("text_key"), "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    gone = near_duplicates(docs, settings).filter(~F.col("kept")).select(
        F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")
    ).distinct()
    keyed = docs.withColumn("__key", content_key("text"))
    return keyed.join(
        gone, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti"
    ).drop("__key")


def level_of(df: np.ndarray, n: int) -> np.ndarray:
    """The weight level of shingles that stand in ``df`` of ``n`` documents."""
    idf = np.log((n + 1) / (df + 1)) / np.log(max(n, 1) + 1)
    return np.round(np.clip(idf, 0, 1) * STEPS).astype(np.int8)


#: Bytes of text whose shingles one task looks at together, as a chunk of texts or a range of hashes.
CHUNK = 1 << 23


def with_levels(by_text: DataFrame, n: int, emit: Callable, schema: str) -> DataFrame:
    """``emit(texts, weights)`` for chunks of ``by_text(node, n, text, …)``, a row per distinct text;
    ``n`` rows in all are its documents. ``texts`` are rows of a chunk, ``weights`` of each
    its distinct shingles in ascending order, their counts in it, and their levels.

    Frequencies are exact and counted once: a chunk of texts sends its distinct shingles,
    each with the documents of the chunk that have it, as one sorted block per range of hashes. A
    range adds its blocks up and answers each with the levels of its shingles, in the order
    of the block; blocks of rare shingles alone get no answer. The answers go back to the
    chunk's texts. Chunks and ranges hold about ``CHUNK`` bytes of text, whatever
    the input, and a shingle that every text has is one entry per block.
    """
    size = by_text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // CHUNK + 1
    chunked = by_text.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(parts)))
    blocks = chunked.select("chunk", "n", "text").groupBy("chunk").applyInArrow(
        _blocks(parts), "chunk long, range long, size int, ids binary, counts binary"
    )
    answers = keep(blocks.groupBy("range").applyInArrow(_answers(n), "chunk long, range long, levels binary"), "levels")
    rare = int(level_of(np.ones(1), n)[0])
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_levelled(parts, rare, emit), schema)


def common_shingles(by_text: DataFrame, n: int) -> DataFrame:
    """``(node, shingles, levels)``: the shingles of each text whose level is below that
    of df = 1, with their levels."""
    rare = int(level_of(np.ones(1), n)[0])

    def emit(rows: pa.Table, weights: list) -> pa.Table:
        below = [(ids[levels < rare], levels[levels < rare]) for ids, _, levels in weights]
        lists = [pa.array([as_longs(b[0]) for b in below], pa.list_(pa.int64())), pa.array([b[1] for b in below], pa.list_(pa.int8()))]
        return pa.table([rows.column("node"), *lists], ["node", "shingles", "levels"])

    return with_levels(by_text, n, emit, "node binary, shingles array<long>, levels array<tinyint>")


def _ranges(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of hashes that ascending ``ids`` meet, and where each begins."""
    high = (ids >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return high[starts].astype(np.int64), starts


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest one needs, low bytes of all first."""
    width = (int(x.max()).bit_length() + 7) // 8
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def widen(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    width = len(data) // size
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, size).T
    return out.view("<u8").reshape(-1)


def _blocks(parts: int):
    @tidy
    def send(chunk: pa.Table) -> pa.Table:
        known = remembered("words", WordHashes)
        found = [np.unique(shingles(known.of(text))) for text in texts(chunk.column("text"))]
        n = np.repeat(chunk.column("n").to_numpy(), [len(f) for f in found])
        ids, at = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(at, n).astype(np.uint64)
        ranges, starts = _ranges(ids, parts)
        out = []
        for low, high in zip(starts, [*starts[1:], len(ids)], strict=True):
            steps = np.diff(ids[low:high], prepend=np.uint64(0))
            out.append((high - low, narrow(steps), narrow(counts[low:high] - np.uint64(1))))
        return pa.table({
            "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(out), pa.int64()), "range": pa.array(ranges, pa.int64()),
            "size": pa.array([o[0] for o in out], pa.int32()), "ids": pa.array([o[1] for o in out], pa.binary()),
            "counts": pa.array([o[2] for o in out], pa.binary()),
        })

    return send


def _answers(n: int):
    rare = int(level_of(np.ones(1), n)[0])

    @tidy
    def answer(blocks: pa.Table) -> pa.Table:
        sizes = blocks.column("size").to_pylist()
        ids, counts = (
            [widen(data, size) for data, size in zip(blocks.column(c).to_pylist(), sizes, strict=True)] for c in ("ids", "counts")
        )
        _, at = np.unique(np.concatenate([np.cumsum(i, dtype=np.uint64) for i in ids]), return_inverse=True)
        df = np.bincount(at, np.concatenate(counts).astype(np.float64) + 1)
        levels = np.split(level_of(df, n)[at], np.cumsum(sizes)[:-1])
        told = [i for i, level in enumerate(levels) if (level != rare).any()]
        out = blocks.select(["chunk", "range"]).take(pa.array(told, pa.int64()))
        return out.append_column("levels", pa.array([levels[i].tobytes() for i in told], pa.binary()))

    return answer


def _levelled(parts: int, rare: int, emit: Callable):
    @tidy
    def give(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known = remembered("words", WordHashes)
        found = [np.unique(shingles(known.of(text)), return_counts=True) for text in texts(rows.column("text"))]
        ids = np.unique(np.concatenate([f[0] for f in found])) if found else np.zeros(0, np.uint64)
        levels = np.full(len(ids), rare, np.int8)
        ranges, starts = _ranges(ids, parts)
        begin = dict(zip(ranges.tolist(), starts.tolist(), strict=True))
        for part, data in zip(answers.column("range").to_pylist(), answers.column("levels").to_pylist(), strict=True):
            levels[begin[part] : begin[part] + len(data)] = np.frombuffer(data, np.int8)
        return emit(rows, [(own, counts, levels[np.searchsorted(ids, own)]) for own, counts in found])

    return give


def weighted_set(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a text: ``data`` are the number of its distinct shingles in
    four bytes, their levels, and the text."""
    known = remembered("words", WordHashes)
    size = int.from_bytes(data[:4], "big")
    levels = np.frombuffer(data, np.int8, size, 4)
    text = data[4 + size :].decode("utf-8", "surrogatepass")
    return elements(*np.unique(shingles(known.of(text)), return_counts=True), 1 + levels / STEPS)


def elements(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle that occurs n times is n elements of the same weight, so that what two
    texts share is the elements they share."""
    again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = np.repeat(ids, counts)
    hashes = np.where(again > 0, mix(hashes + again.astype(np.uint64)), hashes)
    order = np.argsort(hashes)
    return hashes[order], np.repeat(weights, counts)[order]


class Sampler:
    """Improved consistent weighted sampling with tabled random numbers.

    For weight ``w``, with ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)`` of the shingle:
    ``t = floor(ln w / r + b)``, ``ln y = r (t - b)``, ``ln a = ln c - ln y - r``; the
    shingle with the least ``a`` and its ``t`` are the sample. The random numbers
    are those of the shingle's slot. Of equal ``a`` the smaller shingle wins, so
    shingles that share a slot compare by hash. Where the count is 1 the weight is
    one of a few levels, and ``ln a`` is looked up.
    """

    #: Shingles handled at once.
    PART = 1 << 12

    def __init__(self, samples: int, slots: int, seed: int) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        shape = (slots, samples)
        self.r = random.gamma(2, 1, shape).astype(np.float32)
        self.ln_c = np.log(random.gamma(2, 1, shape)).astype(np.float32)
        self.b = random.random(shape).astype(np.float32)
        ln_w = np.log1p(np.arange(STEPS + 1, dtype=np.float32)[:, None, None] / STEPS)
        self.once = self._ln_a(ln_w, np.arange(slots)).reshape(-1, samples)

    def _t(self, ln_w: np.ndarray, at: tuple | np.ndarray) -> np.ndarray:
        return np.floor(ln_w / self.r[at] + self.b[at])

    def _ln_a(self, ln_w: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = self.r[at]
        return self.ln_c[at] - r * (self._t(ln_w, at) - self.b[at]) - r

    def sample(self, ids: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """One 64-bit id per sample."""
        slots = (ids % np.uint64(len(self.r))).astype(np.int64)
        ln_w = (np.log(counts) + np.log1p(levels / STEPS)).astype(np.float32)
        rows = levels.astype(np.int64) * len(self.r) + slots
        k = np.arange(self.r.shape[1])
        best, least = np.zeros(len(k), np.int64), np.full(len(k), np.inf, np.float32)
        for start in range(0, len(ids), self.PART):
            part = slice(start, start + self.PART)
            ln_a = self.once.take(rows[part], axis=0)
            often = np.flatnonzero(counts[part] > 1)
            if len(often):
                ln_a[often] = self._ln_a(ln_w[part][often][:, None], slots[part][often])
            at = ln_a.argmin(axis=0)
            value = ln_a[at, k]
            better = value < least
            best[better], least[better] = at[better] + start, value[better]
        t = self._t(ln_w[best], (slots[best], k)).astype(np.int64)
        return mix(ids[best] + mix(t.view(np.uint64)))


def _sign(settings: Settings, bands: int, rows: int):
    def sign(chunk: pa.Table, weights: list) -> pa.Table:
        sampler = remembered(("sampler", settings, bands, rows), lambda: Sampler(bands * rows, settings.slots, settings.seed))
        has = [len(w[0]) > 0 for w in weights]
        ids = [sampler.sample(*w) for w in weights if len(w[0])]
        hashes = band_hashes(np.array(ids, np.uint64).reshape(len(ids), bands * rows), bands, rows)
        ends = np.concatenate([[0], np.cumsum(has) * bands]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.reshape(-1)))
        levels = pa.array([w[2].tobytes() for w in weights], pa.binary())
        return pa.table(
            [chunk.column("node"), chunk.column("doc_id").cast(pa.int64()), lists, levels], ["node", "doc_id", "bands", "levels"]
        )

    return sign
