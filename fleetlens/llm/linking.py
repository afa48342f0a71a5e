"""Components of similar contents from banded signatures, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import as_longs, forget, keep, mix, tidy
from fleetlens.llm.components import components

#: Contents that one cell of the exact way through a mixed bucket holds on a side.
BLOCK = 512
#: Columns of a block of set elements.
COLUMNS = 4096


def tune_bands(similarity: float, recall: float, max_rows: int = 4, max_hashes: int = 64) -> tuple[int, int]:
    """``(bands, rows)``: the most selective banding that finds a pair of this
    similarity with at least this probability."""
    for rows in range(max_rows, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no banding within max_hashes reaches the recall")


def band_hashes(ids: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Signatures ``(n, bands * rows)`` of 64-bit ids to one hash per band."""
    ids = ids.reshape(len(ids), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), ids.shape[:2]).copy()
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[:, :, j])
    return as_longs(out)


def pack(hashes: np.ndarray, weights: np.ndarray | None = None) -> bytes:
    """A set as bytes: ascending hashes, then their weights if they differ from 1. A
    hash has the same weight in every set; counts are told apart as elements."""
    return hashes.tobytes() + (b"" if weights is None else weights.astype(np.float32).tobytes())


def unpack(data: bytes, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (12 if weighted else 8)
    hashes = np.frombuffer(data, np.uint64, n)
    weights = np.frombuffer(data, np.float32, n, 8 * n) if weighted else np.ones(n, np.float32)
    return hashes, weights.astype(np.float64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 where a side is empty."""
    (x, u), (y, v) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    common = u[same].sum()
    return float(common / (u.sum() + v.sum() - common))


def link_contents(
    nodes: DataFrame,
    sets: Callable[[DataFrame], DataFrame],
    similarity: float,
    weighted: bool,
    block: int = BLOCK,
    read: Callable[[bytes], tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """``(node, root)``, a kept table, of the contents that are linked to another one.

    ``nodes(node, bands)`` has a row per distinct content; ``sets(candidates)``
    gives ``(node, data)`` for a table of nodes; ``read`` makes hashes and weights of
    ``data``, or it is that of :func:`pack`.

    Links are all pairs that share a band and whose exact similarity is at least
    ``similarity``. Only their components are asked for, so most pairs of a large
    bucket need no look:

    1. every content of a bucket is compared with the bucket's smallest one, and
       components are formed;
    2. in buckets whose other contents are still in several components, every pair
       from two components is compared, in cells of at most about ``block`` by
       ``block`` contents. A cell returns a spanning forest, never all its links.

    So a bucket of many copies costs a row per copy, and no link is lost.
    """
    read = read or partial(unpack, weighted=weighted)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    members = keep(banded.join(heads, "band").filter("node <> head").select("band", "node", "head"), "members")
    stars = members.select("node", "head").distinct()
    candidates = members.select("node").unionByName(members.select(F.col("head").alias("node"))).distinct()
    data = keep(sets(candidates).select("node", "data"), "sets")

    first = stars.join(data, "node").withColumnRenamed("data", "x").join(
        data.select(F.col("node").alias("head"), F.col("data").alias("y")), "head"
    )
    links = keep(_verified(first, similarity, read), "links")
    roots = components(links)

    mixed = _mixed(members, roots)
    cells = _cells(members.select("band", "node"), mixed, roots, block).join(data, "node")
    cells = cells.repartition("band", "cell").sortWithinPartitions("band", "cell")
    more = cells.mapInArrow(_cell_links(similarity, read), "a binary, b binary")
    more = keep(more.distinct(), "links")
    forget(members, data, links)
    if not more.isEmpty():
        first = roots
        roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        forget(first)
    forget(more)
    return roots


def _verified(pairs: DataFrame, similarity: float, read: Callable) -> DataFrame:
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            a, b = batch.column("node").to_pylist(), batch.column("head").to_pylist()
            x_data, y_data = batch.column("x"), batch.column("y")
            hits = []
            for i in range(len(a)):
                if b[i] != last:
                    last, y = b[i], read(y_data[i].as_py())
                if jaccard(read(x_data[i].as_py()), y) >= similarity:
                    hits.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in hits], pa.binary()), pa.array([b[i] for i in hits], pa.binary())], schema=schema
            )

    return pairs.select("node", "head", "x", "y").mapInArrow(check, "a binary, b binary")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets whose members, without the head, are in more than one component."""
    placed = members.select("band", "node").join(roots, "node", "left")
    root = F.coalesce("root", "node")
    return (
        placed.groupBy("band")
        .agg(F.min(root).alias("low"), F.max(root).alias("high"), F.count("*").alias("n"))
        .filter("low <> high")
        .select("band", "n")
    )


def _cells(members: DataFrame, mixed: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Members of mixed buckets, copied to the cells in which they meet the others."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        members.join(mixed, "band")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .join(roots, "node", "left")
        .select(
            "band", "node", "own", F.coalesce("root", "node").alias("root"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        )
        .select(
            "band", "node", "own", "root",
            F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        )
    )


def _cell_links(similarity: float, read: Callable):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            found = compare_cell(rows, *map(int, key[1].split("-")), similarity, read) if key else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], schema=schema)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("band", "cell", "node", "own", "root", "data"))
            for band, cell, *row in zip(*columns, strict=True):
                if (band, cell) != key:
                    yield done()
                    key, rows = (band, cell), []
                rows.append(row)
        yield done()

    return compare


def compare_cell(rows: list, low: int, high: int, similarity: float, read: Callable) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between components; ``rows`` are (node, block,
    root, data). A cell of one block compares it with itself."""
    left = [r for r in rows if r[1] == low]
    right = left if low == high else [r for r in rows if r[1] == high]
    if not left or not right:
        return []
    sets = [read(r[3]) for r in left]
    others = sets if low == high else [read(r[3]) for r in right]
    common, x, y = overlaps(sets, others)
    # The product is in single precision: what it lets through is compared exactly.
    i, j = np.nonzero(common >= (similarity - 1e-3) * (x[:, None] + y[None, :] - common))
    up: dict[bytes, bytes] = {}

    def top(r: bytes) -> bytes:
        while r in up:
            r = up[r]
        return r

    out = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(left[p][2]), top(right[q][2])
        if a != b and jaccard(sets[p], others[q]) >= similarity:
            up[max(a, b)] = min(a, b)
            out.append((left[p][0], right[q][0]))
    return out


def overlaps(left: list, right: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of all intersections, as products of blocks of set elements, and of the sets."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    picked = []
    for hashes, weights, owner in sides:
        at = np.searchsorted(shared, hashes)
        at[at == len(shared)] = 0
        there = shared[at] == hashes if len(shared) else np.zeros(len(hashes), bool)
        order = np.argsort(at[there], kind="stable")
        picked.append((at[there][order], np.sqrt(weights[there][order]).astype(np.float32), owner[there][order]))
    for start in range(0, len(shared), COLUMNS):
        blocks = []
        for (at, root, owner), n in zip(picked, out.shape, strict=True):
            part = slice(*np.searchsorted(at, [start, start + COLUMNS]))
            block = np.zeros((n, COLUMNS), np.float32)
            block[owner[part], at[part] - start] = root[part]
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out, *(np.array([s[1].sum() for s in sets]) for sets in (left, right))
