"""Repeated passages: what is alike in different places goes from all but the first.

Two steps: lines that are alike (:func:`repeated_paragraphs`), then, in the texts as
they stand after it, passages that are equal word for word wherever their lines
break (:func:`repeated_passages`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import (
    KeyFilter, WordHashes, as_longs, content_key, forget, keep, line_key, low_bytes, mix, shingles, texts, tidy,
)
from fleetlens.llm.linking import band_hashes, link_contents, pack, tune_bands

MIN_WORDS = 50


def repeated_paragraphs(
    docs: DataFrame, similarity: float = 0.8, recall: float = 0.998, min_words: int = MIN_WORDS, seed: int = 8
) -> DataFrame:
    """``(doc_id, text_key, paragraph, root)``, a kept table: the paragraphs to remove, by line number.

    A paragraph is a line of at least ``min_words`` words. MinHash signatures of
    its five-word shingles are cut into bands tuned to find a pair at the
    similarity with probability ``recall``; paragraphs that share a band are
    verified by exact Jaccard; linked paragraphs are one component. The first
    place of a component (smallest doc_id, then line; a null doc_id comes last)
    stays, every other place goes, also inside one document.

    Shorter lines never go here. Null and empty texts have no paragraphs. Repeated rows
    of a document have the same places and share their fate.
    """
    docs = docs.select("doc_id", "text")
    bands, rows = tune_bands(similarity, recall)
    places = keep(
        docs.select("doc_id", content_key("text").alias("text_key"), "text").mapInArrow(
            _sign(bands, rows, min_words, seed),
            "doc_id long, text_key binary, paragraph int, node binary, bands array<long>",
        ),
        "places",
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "paragraph")
    contents = keep(
        places.groupBy("node").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first("bands").alias("bands")),
        "contents",
    )

    filters = []

    def sets(candidates: DataFrame) -> DataFrame:
        filters.append(KeyFilter(candidates, "node"))
        lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 2 * min_words - 1)
        lines = lines.select(content_key("line").alias("node"), "line")
        lines = lines.filter(filters[-1].maybe(F.col("node"))).join(candidates, "node")
        return lines.groupBy("node").agg(F.first("line").alias("line")).mapInArrow(_sets, "node binary, data binary")

    roots = link_contents(contents.select("node", "bands"), sets, similarity, weighted=False)
    groups = contents.select("node", "place", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = groups.groupBy("root").agg(F.min("place").alias("first"), F.sum("n").alias("places")).filter("places > 1")
    again = groups.select("node", "root").join(first, "root").select("node", "root", "first")
    out = keep(
        places.select("node", "doc_id", "text_key", "paragraph")
        .join(again, "node")
        .filter(place != F.col("first"))
        .select("doc_id", "text_key", "paragraph", "root"),
        "repeated",
    )
    forget(places, contents, roots)
    for used in filters:
        used.free()
    return out


def drop_repeated_paragraphs(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with shortened texts, and ``n_removed``, the number of paragraphs and
    passages taken out.

    First go the lines of :func:`repeated_paragraphs`, then, from the texts that are
    left, the passages of :func:`repeated_passages`: so what stays of a passage is
    looked for where it was not taken out as a line.

    All rows and columns stay; ``n_chars``, where there is one, follows a changed
    text. A null text stays null; a text may become empty. If ``docs`` already has
    a column ``n_removed``, it is replaced.
    """
    repeated = repeated_paragraphs(docs, **settings)
    gone = repeated.groupBy("doc_id", "text_key").agg(
        F.collect_set("paragraph").alias("__gone")  # lines of one document
    ).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), "__gone")
    gone = keep(gone, "gone")
    forget(repeated)
    keyed = docs.withColumn("__key", content_key("text"))
    look = KeyFilter(gone, "__k")
    joined = _joined(keyed, gone, look, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    kept = F.array_join(
        F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n"
    )
    out = joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    out = out.withColumn("n_removed", F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long"))
    out = keep(out.drop("__key", "__k", "__d", "__gone"), "shortened")
    forget(gone)
    look.free()

    passages, read = _passages(out, settings.get("min_words", MIN_WORDS))
    spans = keep(passages, "spans")
    forget(*read)
    spans = spans.select(
        F.col("text_key").alias("__k"), F.col("doc_id").alias("__d"), F.col("spans").alias("__spans")
    )
    found, first = F.col("__k").isNotNull(), F.col("doc_id").eqNullSafe(F.col("__d"))
    cut = F.udf(_cut, "string", useArrow=True)(F.when(found & first, F.col("text")), F.when(found & first, F.col("__spans")))
    joined = _joined(
        out.withColumn("__key", content_key("text")), spans, KeyFilter(spans, "__k"), F.col("__key") == F.col("__k"), __cut=cut
    )
    text = F.when(~found, F.col("text")).when(first, F.col("__cut")).otherwise("")
    n = F.when(~found, 0).when(first, F.size("__spans")).otherwise(1)
    out = joined.withColumn("__text", text).withColumn("n_removed", F.col("n_removed") + n)
    out = out.drop("text").withColumnRenamed("__text", "text")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[c for c in docs.columns if c != "n_removed"], "n_removed")


def _joined(docs: DataFrame, found: DataFrame, look: KeyFilter, on: Column, **more: Column) -> DataFrame:
    """Left join of ``docs(__key, …)`` with ``found(__k, …)``, of whose keys ``look`` tells; only texts that can have a row there are shuffled.
    Columns ``more`` are computed of those alone; the others have nulls in them."""
    maybe = look.maybe(F.col("__key"))
    both = docs.filter(maybe).join(found, on, "left").withColumns(more)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in both.schema.fields if f.name not in docs.columns]
    return both.unionByName(docs.filter(~maybe).select("*", *none))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(text_key, doc_id, spans)`` of the texts that hold a passage again.

    A passage is a run of ``min_words`` words or more that stands, word for word, at
    an earlier place too (smaller doc_id, null last; then text; then word). White
    space, line breaks and case do not count. ``spans`` are the runs to remove, as
    ``[start, end)`` by word number, from the text of ``doc_id``, the first with
    this text; every other document with it repeats it as a whole. Where a text
    repeats itself with an overlap, the first ``min_words`` words stay.

    Of every ``min_words`` words the least hash of a shorter run inside them is an
    anchor, so equal passages have equal anchors. Windows of ``min_words`` words
    whose anchor stands twice are compared by digest of all their words; the first
    place of each stays, and spans are unions of the others. Nothing is paired, so
    a passage of many documents costs a row per place and word.
    """
    return _passages(docs, min_words)[0]


def _passages(docs: DataFrame, min_words: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """:func:`repeated_passages`, and the kept tables that it reads."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    docs = docs.select("doc_id", content_key("text").alias("text_key"), "text")
    signed = docs.mapInArrow(_anchors(min_words), "doc_id long, text_key binary, anchors array<long>")
    contents = keep(
        signed.groupBy("text_key").agg(
            F.min(place).alias("place"), F.max(place).alias("other"), F.first("anchors").alias("anchors")
        ).select("text_key", F.col("place.doc_id").alias("doc_id"), (F.col("place") != F.col("other")).alias("copied"), "anchors"),
        "anchors",
    )
    anchors = contents.select("text_key", F.explode("anchors").alias("anchor"))
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    wanted = anchors.distinct().join(twice, "anchor").groupBy("text_key").agg(F.collect_list("anchor").alias("anchors"))  # those of one text
    wanted = keep(wanted.join(contents.select("text_key", "doc_id"), "text_key"), "wanted")
    text = docs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "text")
    look = KeyFilter(wanted, "text_key")
    text = text.filter(look.maybe(F.col("k")))
    found = wanted.join(text, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    windows = keep(
        found.select("doc_id", "text_key", "anchors", "text").mapInArrow(
            _windows(min_words), "doc_id long, text_key binary, word int, window binary"
        ),
        "windows",
    )
    forget(wanted)
    look.free()
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "word")
    # A document with two rows is read twice, at the same places: those windows are no others than the first.
    first = windows.groupBy("window").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = windows.join(first.select("window", "first"), "window").filter(at != F.col("first"))
    own = (F.col("first.text_key") == F.col("text_key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    start = F.when(own, F.greatest("word", F.col("first.word") + min_words)).otherwise(F.col("word"))
    runs = again.select("text_key", start.alias("start"), (F.col("word") + min_words).alias("end"))
    spans = _spans(runs)
    out = contents.select("text_key", "doc_id", "copied").join(spans, "text_key", "left").filter("copied or spans is not null")
    out = out.select("text_key", "doc_id", F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"))
    return out, (contents, windows)


def _anchor_of(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of ``min_words`` words, and where it starts."""
    size = min_words // 2 + 1
    runs = shingles(words, size)
    near = np.lib.stride_tricks.sliding_window_view(runs, min_words - size + 1)
    at = near.argmin(axis=1) + np.arange(len(near))
    return runs[at], at


def _anchors(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(texts(batch.column("text"))):
                words = known.of(text)
                if len(words) < min_words:
                    continue
                anchor, at = _anchor_of(words, min_words)
                new = np.concatenate([[True], at[1:] != at[:-1]])
                rows.append(i)
                found.append(as_longs(anchor[new]))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())), batch.column("text_key").take(pa.array(rows, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                ],
                schema=schema,
            )

    return sign


def _windows(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("word", pa.int32()), ("window", pa.binary())])
    part = 1 << 16

    @tidy
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for i, text in enumerate(texts(batch.column("text"))):
                data = low_bytes(text)
                anchor, _ = _anchor_of(known.places(data)[0], min_words)
                words = data.split()
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                plain = memoryview(b" ".join(words))
                wanted = batch.column("anchors")[i].values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(np.isin(as_longs(anchor), wanted))
                starts = np.concatenate([[0], ends + 1])
                for k in range(0, len(at), part):
                    some = at[k : k + part]
                    bounds = zip(starts[some].tolist(), ends[some + min_words - 1].tolist(), strict=True)
                    window = [hashlib.md5(plain[a:b]).digest() for a, b in bounds]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i].as_py()] * len(some), pa.int64()), pa.array([keys[i].as_py()] * len(some), pa.binary()),
                            pa.array(some, pa.int32()), pa.array(window, pa.binary()),
                        ],
                        schema=schema,
                    )

    return digests


def _spans(runs: DataFrame) -> DataFrame:
    """``(text_key, spans)`` of ``runs(text_key, start, end)``: those that touch or overlap, joined.

    Rows are sorted and looked at one after the other, so that a text's runs are never gathered
    in one value; only its spans are, of which there are few.
    """
    order = Window.partitionBy("text_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = runs.withColumn("apart", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0)))
    numbered = apart.withColumn("span", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("text_key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    all_of = F.sort_array(F.collect_list(F.struct("start", "end")))  # those of one text
    return joined.groupBy("text_key").agg(all_of.alias("all")).select(
        "text_key", F.transform("all", lambda s: F.array(s["start"], s["end"])).alias("spans")
    )


def _cut(text: str | None, spans: list[list[int]] | None) -> str | None:
    """``text`` without the words of ``spans``. Of the white space on both sides of a
    span that with more line breaks stays, at the ends of the text none."""
    if text is None or spans is None or not len(spans):
        return text
    words = [m.span() for m in re.finditer("[^ \t\n\r\x0b\x0c]+", text)]
    out, at = [], 0
    for start, end in spans:
        left = words[start - 1][1] if start else 0
        out.append(text[at:left])
        at = words[end][0] if end < len(words) else len(text)
        if start and end < len(words):
            gaps = text[left : words[start][0]], text[words[end - 1][1] : at]
            out.append(max(gaps, key=lambda gap: gap.count("\n")))
    return "".join([*out, text[at:]])


def min_hashes(sets: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each hash over each run of ``sets`` that begins at ``starts``."""
    out = np.empty((len(starts), len(a)), np.uint64)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat((sets * a[k] + b[k]) >> np.uint64(1), starts)
    return out


def _sign(bands: int, rows: int, min_words: int, seed: int):
    random = np.random.Generator(np.random.PCG64(seed))
    a = random.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 2**63, bands * rows, np.uint64)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.binary()), ("paragraph", pa.int32()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            keys, lines = batch.column("text_key").to_pylist(), texts(batch.column("text"))
            for start in range(0, len(ids), 256):
                row, number, node, sets = [], [], [], []
                for i in range(start, min(start + 256, len(ids))):
                    data = low_bytes(lines[i])
                    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                    words, starts = known.places(data)
                    bounds = np.concatenate([[0], np.searchsorted(starts, breaks), [len(words)]])
                    for p in np.flatnonzero(np.diff(bounds) >= min_words).tolist():
                        row.append(i)
                        number.append(p)
                        sets.append(shingles(words[bounds[p] : bounds[p + 1]]))
                    if row and row[-1] == i:
                        of_text = lines[i].split("\n")
                        node += [line_key(of_text[p]) for p in number[len(node) :]]
                if not row:
                    continue
                ends = np.cumsum([len(s) for s in sets])
                least = min_hashes(np.concatenate(sets), np.concatenate([[0], ends[:-1]]), a, b)
                hashes = band_hashes(mix(least), bands, rows).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in row], pa.int64()), pa.array([keys[i] for i in row], pa.binary()),
                        pa.array(number, pa.int32()), pa.array(node, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * bands + 1, bands, dtype=np.int32)), pa.array(hashes)),
                    ],
                    schema=schema,
                )

    return sign


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        data = [pack(np.unique(shingles(known.of(line)))) for line in texts(batch.column("line"))]
        yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "data": pa.array(data, pa.binary())})
