"""Helpers the training-data operators share: kept tables, content keys, shingles."""

from __future__ import annotations

import ctypes
import hashlib
import inspect
import sys
import types
import uuid
import weakref
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.levels import ensure_checkpoint_dir

SHINGLE_WORDS = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


#: With it Spark removes the shuffle files of a query when the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once. Spark's own 10,000 are, of texts, tens of MB in
#: the executor's buffers, again in the worker's, and once more as Python texts.
BATCH_ROWS = 1000
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Folders of the tables that :func:`keep` made.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short plans, and a lost
    executor costs only what is computed after it. Its shuffles are not needed any
    more and are freed at once; otherwise they would stay until the driver collects garbage.
    Python workers get at most ``BATCH_ROWS`` rows at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    rows = int(spark.conf.get(BATCHES))
    settings = {FREE_SHUFFLES: "true", BATCHES: str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df.write.parquet(path, compression="zstd")
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    kept = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[kept] = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`keep` wrote, once all that reads them is kept itself: otherwise
    every step's table would lie beside the later ones until the job ends."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def content_key(text: str | Column) -> Column:
    """16 bytes that stand for a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


#: Bits that say which keys can be in a table: 16 MB in the driver and in every worker.
MARK_BITS = 27


def marks(slots: DataFrame) -> np.ndarray:
    """A bit for each of ``slots(slot)``, numbers of ``MARK_BITS`` bits, in words of 64. Whatever the
    table, at most 2^21 rows come to the driver."""
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the slots have their bit."""
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


class KeyFilter:
    """Tells of a :func:`content_key` that it is not in a table, without a join.

    ``maybe(key)`` is true for all keys of the table and for some others, the more the fuller
    the bits are; so rows that need a join with the table can be told from those that
    do not before anything is shuffled.
    """

    def __init__(self, table: DataFrame, key: str) -> None:
        part = F.conv(F.hex(F.substring(F.col(key), 1, 4)), 16, 10).cast("long")
        bits = marks(table.select(F.shiftright(part, 32 - MARK_BITS).alias("slot")))
        self._bits = table.sparkSession.sparkContext.broadcast(bits)

    def maybe(self, key: Column) -> Column:
        data, shift = self._bits, np.uint64(32 - MARK_BITS)

        def look(keys: pa.Array) -> pa.Array:
            four = np.frombuffer(b"".join(k[:4] for k in keys.to_pylist()), ">u4").astype(np.uint64)
            return pa.array(marked(data.value, four >> shift), pa.bool_())

        return F.arrow_udf(look, "boolean")(key)

    def free(self) -> None:
        """Its bits go, in the driver's folder and in every executor, once all that asks it is kept."""
        self._bits.destroy()


def line_key(line: str) -> bytes:
    """:func:`content_key` inside a task."""
    return hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a batch; null is empty."""
    return [t or "" for t in column.to_pylist()]


def remembered(key: Hashable, make: Callable[[], object]) -> object:
    """``make()``, kept by the process: a Python worker is used for many tasks."""
    memory = sys.modules.setdefault("_llm_memory", types.ModuleType("_llm_memory")).__dict__
    if key not in memory:
        memory[key] = make()
    return memory[key]


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def tidy(work: Callable) -> Callable:
    """``work``, for mapInArrow or applyInArrow, with :func:`give_back` after each task or group.

    A Python worker stays for other tasks, idle ones as well, and an executor has several;
    otherwise each holds what its largest task took, as long as it lives."""
    if inspect.isgeneratorfunction(work):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from work(batches)
            finally:
                give_back()

    elif len(inspect.signature(work).parameters) == 1:

        def run(rows: pa.Table) -> pa.Table:
            try:
                return work(rows)
            finally:
                give_back()

    else:

        def run(rows: pa.Table, others: pa.Table) -> pa.Table:
            try:
                return work(rows, others)
            finally:
                give_back()

    return run


class WordHashes:
    """64-bit hashes of the words of a text, the same in every process.

    Words stand between ASCII white space and are lower case. A hash is a
    polynomial of the word's bytes modulo 2^64, each byte standing for a random
    number; all words of a piece of text are taken at once, as differences of one
    running sum times a power of the inverse base. ``PIECE`` bytes are handled at
    a time, whatever the length of the text.
    """

    PIECE = 1 << 17
    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        random = np.random.Generator(np.random.PCG64(5))
        self.values = random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[list(b" \t\n\r\x0b\x0c")] = True
        self._powers(1 << 14)

    def _powers(self, n: int) -> None:
        self.up, self.down = np.ones((2, n + 1), np.uint64)
        self.up[1:], self.down[1:] = self.BASE, pow(self.BASE, -1, 1 << 64)
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)

    def places(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the byte it starts at."""
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = at + self.PIECE
            while end < len(data) and data[end - 1] not in b" \t\n\r\x0b\x0c":
                end += 1
            h, s = self._piece(np.frombuffer(data, np.uint8, min(end, len(data)) - at, at))
            hashes.append(h)
            starts.append(s + at)
            at = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return (hashes[0], starts[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(starts))

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n >= len(self.up):
            self._powers(2 * n)
        space = np.ones(n + 2, np.int8)
        space[1:-1] = self.space[data]
        edges = np.diff(space)
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts], starts

    def of(self, text: str) -> np.ndarray:
        return self.places(low_bytes(text))[0]


def low_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order. A shorter text that has
    words is one shingle; a text without words has none."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out = out * _ODD + word_hashes[j : n - width + 1 + j]
    return mix(out)


def as_longs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def no_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


#: A-Z in lower case; 0-9, a-z and the bytes of everything beyond ASCII as they are; the rest a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: A longer word is stood for by its digest.
LONG_WORD = 64


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: runs of letters, digits and all that is not ASCII, only A-Z lower-cased.

    A word over ``LONG_WORD`` bytes is ``#`` and its SHA-256, so that a word takes
    bounded room; ``#`` stands in no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    if words and max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"#" + hashlib.sha256(w).digest() for w in words]
    return words


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of :func:`words_of` start and end in ``text``, in code points."""
    data = text.encode("utf-8", "surrogatepass")
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(data.translate(WORD_BYTES), np.uint8) != 32
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if len(data) == len(text):
        return starts, ends
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return points[starts], points[ends]
