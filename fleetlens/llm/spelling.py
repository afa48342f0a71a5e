"""Spelling variants: words one edit apart, found by scans of sorted word lists."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import keep, texts, tidy

#: Bytes of Latin-1: A-Z in lower case, a-z and 0xC0-0xFF as they are, the rest a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256)
)
#: Distinct words a task holds before it hands their counts on.
HELD = 1 << 18
#: Words in a block of a sorted list, unless that makes more than BLOCKS blocks: their
#: bounds are broadcast, each ``BOUND`` code points at most, so about 8 MB.
BLOCK, BLOCKS, BOUND = 2048, 1 << 15, 64


def count_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """``(word, n)`` of ``docs(doc_id, text)``: runs of the letters A-Z, a-z and U+00C0
    to U+00FF with A-Z in lower case, of at least ``min_length`` code points, that occur
    at least ``min_count`` times.

    With ``drop_every``, a run loses a code point first where ``drop_every`` divides h, the
    crc32 of ``<doc_id>:<run>``: that at h % length. (A known share of misspellings,
    for tests of what finds them.)

    Counts are summed in every task before the shuffle, at most ``HELD`` words at a time.
    Null texts hold no words; a null doc_id is written as an empty text; repeated rows
    count each; texts and runs of any length are taken whole. Other columns are not looked at.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flush(counts: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                runs = text.encode("latin-1", "replace").translate(LETTERS).split()
                runs = [w for w in runs if len(w) >= min_length]
                if drop_every:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    runs = [_shortened(w, start, drop_every) for w in runs]
                    runs = [w for w in runs if len(w) >= min_length]
                counts.update(runs)
                if len(counts) > HELD:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _shortened(run: bytes, start: int, every: int) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _next_rows() -> list[int]:
    """The banded row after a row, for each of 27 rows and 8 ways the three letters in
    reach can match. A row of the edit matrix is kept where it is within one of the
    diagonal: three numbers, each 0, 1 or 2 for more. -1: none is below 2."""
    out = []
    for p, match in product(product(range(3), repeat=3), product((0, 1), repeat=3)):
        left = min(p[0] + 1 - match[0], p[1] + 1)
        middle = min(p[1] + 1 - match[1], p[2] + 1, left + 1)
        right = min(p[2] + 1 - match[2], middle + 1)
        row = [min(2, x) for x in (left, middle, right)]
        out.append(-1 if min(row) > 1 else 8 * (9 * row[0] + 3 * row[1] + row[2]))
    return out


NEXT = _next_rows()
#: The row of a word that has matched letter by letter so far.
SAME = 8 * (9 * 1 + 3 * 0 + 1)


class SortedList:
    """Sorted words with the prefixes that neighbours share."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.shared = [0] * len(words)
        for i in range(1, len(words)):
            a, b = words[i - 1], words[i]
            n = 0
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                n += 1
            self.shared[i] = n
        # The next word that shares less with the one before it than this one does.
        self.beyond, stack = [len(words)] * len(words), []
        for i, n in enumerate(self.shared):
            while stack and self.shared[stack[-1]] > n:
                self.beyond[stack.pop()] = i
            stack.append(i)

    def near(self, word: str, first: int, prefix: int) -> Iterator[int]:
        """Places from ``first`` on of the words one edit from ``word``, among those that
        begin with the same ``prefix`` letters; the word at ``first`` has to be the first
        that does, or a later one.

        One row of the edit matrix per letter is kept; a word goes on from the row of
        the prefix it shares with the word before. Where a row holds nothing below 2,
        all words with that prefix are passed over.
        """
        words, shared, beyond, n = self.words, self.shared, self.beyond, len(word)
        end, i = len(words), first
        if i >= end or words[i][:prefix] != word[:prefix]:
            return
        letters = f"\0{word}\0\0\0"  # letters[j]: letter j of the word, from 1
        rows = [SAME] * (prefix + 1)
        depth = prefix
        while True:
            candidate = words[i]
            row, length = rows[depth], len(candidate)
            del rows[depth + 1 :]
            while depth < length:
                if depth > n:
                    row = -1
                    break
                c = candidate[depth]
                row = NEXT[row + (letters[depth] == c) * 4 + (letters[depth + 1] == c) * 2 + (letters[depth + 2] == c)]
                if row < 0:
                    break
                depth += 1
                rows.append(row)
            if row >= 0 and -1 <= n - length <= 1 and (row // 8) // (9, 3, 1)[n - length + 1] % 3 == 1:
                yield i
            i += 1
            if row < 0:  # nothing below the prefix of depth + 1 letters
                while i < end and shared[i] > depth:
                    i = beyond[i]
            if i >= end or shared[i] < prefix:
                return
            depth = min(depth, shared[i])


def _compatible(a: str, b: str) -> bool:
    """Whether words that begin with ``a`` and ``b`` can be one edit apart."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    p = next((i for i in range(n) if a[i] != b[i]), n)
    return p == n or a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:-1] or a[p:-1] == b[p + 1 :]


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def _sorted_blocks(words: DataFrame, size: int) -> DataFrame:
    """The words in their order, ``size`` to a row, with the block's number and bounds."""
    schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("words", pa.string()), ("counts", pa.binary())])

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []

        def row() -> pa.RecordBatch:
            values = words[0][:BOUND], words[-1][:BOUND], "\n".join(words), np.array(counts, np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.append(word)
                counts.append(n)
                if len(words) >= size:
                    yield row()
                    words, counts = [], []
        if words:
            yield row()

    packed = words.select("word", "n").orderBy("word").mapInArrow(pack, "first string, last string, words string, counts binary")
    return keep(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _scan_list(words: DataFrame, prefix: int, apart: int, size: int) -> DataFrame:
    """``(word, n_near, most, nearest)`` by the pairs of ``words(word, n)`` that are one edit apart,
    begin with the same ``prefix`` letters and, where ``apart`` is not 0, do not end with
    the same ``apart`` ones. The nearest word is the one of the largest n, then the smallest by
    the order of ``-most`` and the word itself; it comes reversed if the words do.

    Blocks of the sorted list meet each other if their bounds allow a pair; within
    two blocks, each word is looked for in the other list.
    """
    spark = words.sparkSession
    blocks = _sorted_blocks(words, size)
    bounds = sorted((r["block"], r["first"], r["last"]) for r in blocks.select("block", "first", "last").toLocalIterator())
    places = {b: i for i, (b, _, _) in enumerate(bounds)}
    table = spark.sparkContext.broadcast((bounds, places))
    met = pa.schema([("block", pa.int64()), ("other", pa.int64())])

    @tidy
    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, places = table.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                i = places[block]
                _, first, last = bounds[i]
                own, others = _common(first, last), [block]
                for other, low, high in islice(bounds, i + 1, None):
                    if low[:prefix] != last[:prefix]:
                        break
                    if _compatible(own, _common(low, high)):
                        others.append(other)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(others), pa.int64()), pa.array(others, pa.int64())], schema=met)

    pairs = keep(blocks.select("block").mapInArrow(partners, "block long, other long"), "pairs")
    here = blocks.select("block", F.col("words").alias("a"), F.col("counts").alias("m"))
    there = blocks.select(F.col("block").alias("other"), F.col("words").alias("b"), F.col("counts").alias("n"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(bounds) // 8)
    work = pairs.join(here, "block").join(there, "other").repartition(tasks, "block", "other").select(
        (F.col("block") == F.col("other")).alias("same"), "a", "m", "b", "n"
    )
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("most", pa.int64()), ("nearest", pa.string())])

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same, a, m, b, n = (batch.column(c)[i].as_py() for c in range(5))
                a, m = a.split("\n"), np.frombuffer(m, np.int64).tolist()
                b, n = (a, m) if same else (b.split("\n"), np.frombuffer(n, np.int64).tolist())
                found = _meet(a, m, SortedList(b), n, same, prefix, apart)
                rows = [(word, k, most, nearest) for word, (k, most, nearest) in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return work.mapInArrow(scan, "word string, n_near long, most long, nearest string")


def _meet(a: list[str], m: list[int], listed: SortedList, n: list[int], same: bool, prefix: int, apart: int) -> dict[str, list]:
    """What the words of two blocks find in each other: near words, the most
    frequent one's count, and that one. Words of a later block share a prefix with this
    block's only if its first word does."""
    found: dict[str, list] = {}
    flipped = apart > 0

    def note(word: str, count: int, other: str) -> None:
        known = found.get(word)
        if known is None:
            found[word] = [1, count, other]
            return
        known[0] += 1
        if count > known[1] or count == known[1] and (other[::-1] < known[2][::-1] if flipped else other < known[2]):
            known[1], known[2] = count, other

    for i, word in enumerate(a):
        for j in listed.near(word, i + 1 if same else 0, prefix):
            other = listed.words[j]
            if apart and word[-apart:] == other[-apart:]:
                continue
            note(word, n[j], other)
            note(other, m[i], word)
    return found


def near_words(words: DataFrame, min_length: int = 7, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, most, nearest)`` for each of ``words(word, n)`` that is exactly one
    inserted, deleted or replaced code point away from another: how many there are, the
    largest n of one, and the word that has it (the smallest in code-point order).

    ``words`` are distinct and have at least ``min_length`` code points. An edit leaves
    the first third of a word or its end as it was: such pairs stand near in the
    sorted list or in the sorted list of the words read backwards. Both lists are cut
    into blocks; each pair of blocks that can hold a pair is one unit of work, so a
    prefix that a third of all words share is many units. A word without near words
    has no row; null words take no part.
    """
    words = words.filter("word is not null")
    prefix = min_length // 2
    size = max(block, math.ceil(words.count() / BLOCKS))
    ahead = _scan_list(words, prefix, 0, size)
    if prefix:
        back = _scan_list(words.select(F.reverse("word").alias("word"), "n"), min_length - prefix, prefix, size)
        ahead = ahead.unionByName(back.select(F.reverse("word").alias("word"), "n_near", "most", F.reverse("nearest").alias("nearest")))
    best = F.min_by("nearest", F.struct(-F.col("most"), "nearest"))
    return ahead.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("most").alias("most"), best.alias("nearest"))


def variants(words: DataFrame, min_length: int = 7, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words(word, n)``.

    ``form`` is the near word (see :func:`near_words`) of the largest n, the smallest of
    equals, if that is at least ``ratio`` times the word's n, else null; ``root`` is where the
    forms lead to, the word itself without one. As n grows by ``ratio`` from form
    to form, a chain of forms has at most log(largest n) links and is walked by
    doubling its steps. An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms end only where n grows: ratio has to be 2 or more")
    words = keep(words.filter("word is not null").select("word", F.col("n").cast("long")), "words")
    near = near_words(words, min_length, block)
    known = words.join(near, "word", "left")
    has = F.col("most") >= F.lit(ratio) * F.col("n")
    table = keep(
        known.select(
            "word", F.when(has, F.col("nearest")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("most")).alias("form_n"),
        ),
        "forms",
    )
    steps = table.filter("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1, math.log(most, ratio)))) + 1):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = keep(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return table.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
