"""Passages of a benchmark inside documents, found by one automaton over all its windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import keep, remembered, texts, word_spans, words_of

WINDOW = 10
#: Words of a benchmark in one automaton; about 60 MB in a Python worker.
BLOCK_WORDS = 1 << 17
#: Words of an item in one row.
PIECE_WORDS = 4096

_PIECE = "item string, words binary, n long"


def item_pieces(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item, words, n)``: distinct pieces of the items' words. Long items are cut
    into pieces that overlap, so that every window lies whole in one of them."""
    schema = pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch.column("text")), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    if piece:
                        rows.append((item, b" ".join(piece), len(piece)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
            )

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, _PIECE).distinct()


def _blocks(pieces: DataFrame, size: int) -> Iterator[list]:
    """The pieces, at most ``size`` words at a time."""
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total <= size:
        if total:
            yield pieces.collect()
        return
    pieces, n = keep(pieces, "items"), 2 * total // size + 1
    block = lambda: F.pmod(F.xxhash64("item", "words"), F.lit(n))
    while pieces.groupBy(block().alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > max(
        size, 2 * (PIECE_WORDS + WINDOW)
    ):
        n *= 2
    for b in range(n):
        rows = pieces.filter(block() == b).collect()
        if rows:
            yield rows


class Windows:
    """An Aho-Corasick automaton whose letters are words and whose patterns are windows."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int) -> None:
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.shortest = window
        for item, data in pieces:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in data.split(b" ")]
            width = min(window, len(words))
            self.shortest = min(self.shortest, width)
            for i in range(len(words) - width + 1):
                key = tuple(words[i : i + width])
                known = self.machine.get(key, None)
                if known is None:
                    self.machine.add_word(key, (width, {item}))
                else:
                    known[1].add(item)
        self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in a window, and the items of the windows. Only runs of
        words that items have are read."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        hit, items = np.zeros(len(ids), bool), set()
        gaps = np.concatenate([[-1], np.flatnonzero(ids == 0), [len(ids)]])
        for run in np.flatnonzero(np.diff(gaps) > self.shortest):
            start = gaps[run] + 1
            for end, (width, found) in self.machine.iter(tuple(ids[start : gaps[run + 1]].tolist())):
                hit[start + end - width + 1 : start + end + 1] = True
                items |= found
        return hit, items


def _scanner(docs: DataFrame, rows: list, window: int) -> Callable[[], Windows]:
    """Makes the automaton of a block once in every worker."""
    data = docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in rows])
    name = uuid.uuid4().hex
    return lambda: remembered(("windows", name), lambda: Windows(data.value, window))


def _runs(hit: np.ndarray) -> np.ndarray:
    """``(runs, 2)``: first word and the word after the last of every run of hits."""
    edges = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1)


_STATE = "doc_id long, text string, n_words long, hits binary, items array<string>"
_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)``, a row per row of ``docs(doc_id, text)``.

    Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z are
    lower-cased. A window is ``window`` consecutive words of a row of
    ``items(item_id, text)``, or all its words if it has fewer. ``n_hit`` counts the
    document words that lie in an occurrence of a window, ``items`` are the sorted
    ids, as text, of the items whose windows occur, and ``spans`` the ``[start, end)``
    of each run of hit words in the document's own code points.

    The windows make one automaton, which is broadcast and reads each text once. A
    benchmark of over ``block_words`` words is taken in blocks, each an automaton; the
    documents pass one after the other, and are kept in the shared folder between.

    A null or empty text, or one without words, has no words and no hits; a text of any
    length is read whole. Rows of an item_id that repeat are all windows of that item;
    rows without an item_id hit words, but name no item. Repeated documents are looked
    at one by one. An empty benchmark hits nothing. Other columns are not looked at.
    """
    start = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("long").alias("n_words"),
        F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    state, blocks = start, _blocks(item_pieces(items, window), block_words)
    rows = next(blocks, None)
    while rows:
        more = next(blocks, None)
        state = _scan(state if state is start else keep(state, "scanned"), _scanner(docs, rows, window), last=not more)
        rows = more

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )
    none = state is start

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [len(words_of(t)) for t in texts(batch.column("text"))] if none else batch.column("n_words")
            n_hit, spans = [], []
            for i, hits in enumerate(batch.column("hits").to_pylist()):
                runs = np.frombuffer(hits, np.int64).reshape(-1, 2)
                n_hit.append(int((runs[:, 1] - runs[:, 0]).sum()))
                if not len(runs):
                    spans.append([])
                    continue
                begin, end = word_spans(batch.column("text")[i].as_py())
                spans.append([{"start": int(begin[a]), "end": int(end[b - 1])} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), numbers if not none else pa.array(numbers, pa.int64()), pa.array(n_hit, pa.int64()),
                 batch.column("items").cast(pa.list_(pa.string())), pa.array(spans, schema.field("spans").type)], schema=schema
            )

    return state.mapInArrow(finish, _FOUND)


def _scan(state: DataFrame, windows: Callable[[], Windows], last: bool) -> DataFrame:
    """Add what one block finds. After the last block only texts with hits are needed."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = windows()
        for batch in batches:
            numbers, hits, items, bodies = [], [], [], []
            known = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (before, named) in zip(texts(batch.column("text")), known, strict=True):
                words = words_of(text)
                hit, found = machine.scan(words)
                for a, b in np.frombuffer(before, np.int64).reshape(-1, 2):
                    hit[a:b] = True
                numbers.append(len(words))
                hits.append(_runs(hit).astype(np.int64).tobytes())
                items.append(sorted({*named, *found} - {None}))
                bodies.append(None if last and not hit.any() else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bodies, pa.string()), pa.array(numbers, pa.int64()), pa.array(hits, pa.binary()),
                 pa.array(items, pa.list_(pa.string()))], schema=schema
            )

    return state.mapInArrow(scan, _STATE)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of :func:`find_items`."""
    return find_items(docs, items, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all their columns, in which no window of the items occurs.
    Odd rows as in :func:`find_items`: texts without words stay."""
    given = docs
    for rows in _blocks(item_pieces(items, window), block_words):
        docs = _clean(docs if docs is given else keep(docs, "clean"), _scanner(docs, rows, window))
    return docs


def _clean(docs: DataFrame, windows: Callable[[], Windows]) -> DataFrame:
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = windows()
        for batch in batches:
            stays = [not machine.scan(words_of(t))[0].any() for t in texts(batch.column(at))]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
