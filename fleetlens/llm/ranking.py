"""Ranked search of many stated queries: the documents stream through an index over the queries."""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import keep, remembered, texts, words_of

#: Postings, pairs of an item and one of its terms, in one index; about 30 MB in a Python worker.
BLOCK_POSTINGS = 1 << 18
#: Documents scored at once, score cells, and postings met at once.
DOCUMENTS, CELLS, MET = 256, 1 << 22, 1 << 21

_SCALE = 10**9


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, term, times)`` of the distinct rows of ``items(item_id, text)``; item is the id as text."""
    schema = pa.schema([("item", pa.string()), ("term", pa.binary()), ("times", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (item, term, n)
                for item, text in zip(batch.column("item").to_pylist(), texts(batch.column("text")), strict=True)
                for term, n in Counter(words_of(text)).items()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
            )

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null").distinct()
    counted = rows.mapInArrow(count, "item string, term binary, times long")
    return counted.groupBy("item", "term").agg(F.sum("times").alias("times"))


def _blocks(terms: DataFrame, size: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of whole items with at most ``size`` postings each, and the terms of the
    items that have more than that by themselves."""
    if terms.count() <= size:
        return [terms], None
    terms = keep(terms, "terms")
    of_item = keep(terms.groupBy("item").agg(F.count("*").alias("n")), "items")
    small = of_item.filter(F.col("n") <= size)
    block, n = lambda k: F.pmod(F.xxhash64("item"), F.lit(k)), 1
    while (small.groupBy(block(n)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > size:
        n *= 2
    large = of_item.filter(F.col("n") > size)
    whole = terms.join(large.select("item"), "item", "left_anti")
    return [whole.filter(block(n) == b) for b in range(n)], None if large.isEmpty() else terms.join(
        large.select("item"), "item", "left_semi"
    )


@dataclass
class Postings:
    """Inverted index over items: the items of term t, and how often each has it, are
    ``items`` and ``times`` from ``starts[t]`` on."""

    terms: list[bytes]
    names: list[str]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list) -> Postings:
        terms = sorted({bytes(r["term"]) for r in rows})
        names = sorted({r["item"] for r in rows})
        at, name_at = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(names)}
        flat = np.array(sorted((at[bytes(r["term"])], name_at[r["item"]], r["times"]) for r in rows), np.int64).reshape(-1, 3)
        starts = np.searchsorted(flat[:, 0], np.arange(len(terms) + 1))
        return Postings(terms, names, starts, flat[:, 1].copy(), flat[:, 2].copy())


@dataclass
class Corpus:
    """Documents with terms, their terms, and the weight of each term of an index."""

    documents: int
    words: int
    weights: np.ndarray


def _counted(docs: DataFrame, terms: list[bytes]) -> Corpus:
    """One pass: how many documents and words there are, and how many documents have each term."""
    sc, name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    data = sc.broadcast(terms)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = remembered(("terms", name), lambda: {t: i for i, t in enumerate(data.value)})
        documents, words, found = 0, 0, np.zeros(len(ids), np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                own = words_of(text)
                documents += bool(own)
                words += len(own)
                found[[ids[t] for t in ids.keys() & set(own)]] += 1
        have = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], have])), pa.array(np.concatenate([[documents, words], found[have]]))], schema=schema
        )

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    n = found.get(-2, 0)
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(i, 0) + 1))) for i in range(len(terms))]
    return Corpus(n, found.get(-1, 0), np.array(weights, np.int64))


class Scorer:
    """Scores of documents for all items of an index, some documents at a time."""

    def __init__(self, index: Postings, corpus: Corpus) -> None:
        self.index, self.corpus = index, corpus
        self.ids = {t: i for i, t in enumerate(index.terms)}
        self.lengths = np.diff(index.starts)
        self.most = max(1, min(DOCUMENTS, CELLS // max(1, len(index.names))))
        self.clear()

    def clear(self) -> None:
        self.rows: list[object] = []
        self.doc, self.term, self.tf, self.m, self.met = [], [], [], [], 0

    def add(self, row: object, words: list[bytes]) -> bool:
        """Take a document in; True when :meth:`scores` should be asked."""
        get, counts = self.ids.get, Counter(words)
        m = 75 + 25 * len(words) * self.corpus.documents // max(1, self.corpus.words)
        n = len(self.rows)
        self.rows.append(row)
        for word in counts.keys() & self.ids.keys():
            t = get(word)
            self.doc.append(n)
            self.term.append(t)
            self.tf.append(counts[word])
            self.m.append(m)
            self.met += int(self.lengths[t])
        return n + 1 >= self.most or self.met >= MET

    def scores(self) -> tuple[list[object], np.ndarray]:
        """The rows taken in and their scores, ``(rows, items)``; then starts anew."""
        doc, term, tf, m = (np.array(x, np.int64) for x in (self.doc, self.term, self.tf, self.m))
        gain = self.corpus.weights[term] * (_SCALE * tf // (1000 * tf + 12 * m))
        lengths = self.lengths[term]
        first = np.cumsum(lengths) - lengths
        at = np.repeat(self.index.starts[term] - first, lengths) + np.arange(lengths.sum())
        out = np.zeros(len(self.rows) * len(self.index.names), np.int64)
        np.add.at(out, np.repeat(doc * len(self.index.names), lengths) + self.index.items[at], np.repeat(gain, lengths) * self.index.times[at])
        rows = self.rows
        self.clear()
        return rows, out.reshape(len(rows), len(self.index.names))


class Heaps:
    """The k best documents of every item. Of equal scores the smaller doc_id is
    better, and any is better than none."""

    def __init__(self, items: int, k: int) -> None:
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(items)]
        self.least, self.k = np.ones(items, np.int64), k

    def update(self, ids: list[int | None], scores: np.ndarray) -> None:
        for row, item in zip(*np.nonzero(scores >= self.least), strict=True):
            doc_id, heap = ids[row], self.heaps[item]
            entry = (int(scores[row, item]), int(doc_id is not None), -(doc_id or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best of ``docs(doc_id, text)`` for every
    row of ``items(item_id, text)``.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII; A-Z are
    lower-cased. A term t of an item gives a document, as often as the item has t,
    w * ((10^9 * tf) div (1000 * tf + 12 * m)), with w = floor(1000 * ln((2N + 2) / (2 df + 1)))
    and m = 75 + (25 * n * N) div L: tf of t in the document, n terms in the document,
    L in all N documents that have terms, df documents with t.

    The search is reversed: an inverted index over the items' terms is broadcast, and
    each document's counts stream through it. A task keeps a heap of at most k
    documents per item; heaps are merged in two steps, some tasks at a time and then
    all. A first pass counts N, L and df over all documents. An index holds at most
    ``block_postings`` pairs of item and term; more items are taken in blocks of whole
    items. An item with more distinct terms than that is scored by a sum over parts of
    its terms.

    Only scores above 0 are returned. Equal scores go by ascending doc_id, null last;
    rows that share a doc_id or a text are ranked each. Rows of one item_id are one
    item with the terms of all its distinct texts; rows without item_id take no part.
    Null or empty texts and texts without terms are no documents and are never
    returned; long texts are read whole. Other columns are not looked at; an empty table gives an
    empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks, large = _blocks(item_terms(items), block_postings)
    parts = [_heaps(docs, Postings.of(block.collect()), k) for block in blocks]
    if large is not None:
        parts.append(_sums(docs, large, k, block_postings))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    kind = items.schema["item_id"].dataType
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score"
    )


def _heaps(docs: DataFrame, index: Postings, k: int) -> DataFrame:
    """``(item, doc_id, score)``: heaps of every task for the items of an index, merged once."""
    corpus, name = _counted(docs, index.terms), uuid.uuid4().hex
    data = docs.sparkSession.sparkContext.broadcast((index, corpus))
    schema = pa.schema([("item", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = remembered(("index", name), lambda: Scorer(*data.value))
        scorer.clear()
        names = scorer.index.names
        heaps = Heaps(len(names), k)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = words_of(text)
                if words and scorer.add(doc_id, words):
                    heaps.update(*scorer.scores())
        heaps.update(*scorer.scores())
        rows = [(names[i], -least if has else None, score) for i, heap in enumerate(heaps.heaps) for score, has, least in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    found = docs.mapInArrow(search, "item string, doc_id long, score long")
    tasks = F.pmod(F.spark_partition_id(), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = Window.partitionBy("item", "tasks").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = found.withColumn("tasks", tasks).withColumn("rank", F.row_number().over(some))
    return merged.filter(F.col("rank") <= k).drop("tasks", "rank")


def _sums(docs: DataFrame, terms: DataFrame, k: int, size: int) -> DataFrame:
    """``(item, doc_id, score)`` for items of any number of terms: scores by parts of
    their terms, summed per document."""
    docs = keep(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    part, n = lambda m: F.pmod(F.xxhash64("term", "item"), F.lit(m)), 2
    while terms.groupBy(part(n)).count().agg(F.max("count")).first()[0] > size:
        n *= 2
    parts = None
    for p in range(n):
        index = Postings.of(terms.filter(part(n) == p).collect())
        scored = _scores(docs, index, _counted(docs, index.terms))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts.groupBy("item", "row").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score")).drop("row")


def _scores(docs: DataFrame, index: Postings, corpus: Corpus) -> DataFrame:
    """``(item, row, doc_id, score)`` of all scores above 0."""
    name, data = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((index, corpus))
    schema = pa.schema([("item", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = remembered(("index", name), lambda: Scorer(*data.value))
        scorer.clear()

        def scored() -> pa.RecordBatch:
            rows, scores = scorer.scores()
            row, item = np.nonzero(scores)
            columns = [
                [scorer.index.names[i] for i in item], [rows[r][0] for r in row], [rows[r][1] for r in row], scores[row, item],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for row, doc_id, text in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = words_of(text)
                if words and scorer.add((row, doc_id), words):
                    yield scored()
        yield scored()

    return docs.select("doc_id", "text", "row").mapInArrow(search, "item string, row long, doc_id long, score long")
