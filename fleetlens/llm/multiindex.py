"""Near-duplicate embeddings through an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import keep
from fleetlens.llm.components import components
from fleetlens.llm.topk import usable

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Vectors wanted in a cell of a label; sets the size of the codebooks.
PER_CELL = 32
#: Vectors of a side that meet in one task.
BLOCK = 1024


@dataclass(frozen=True)
class Index:
    """A codebook per half of the (unit) vectors; a cell is a pair of codewords."""

    first: np.ndarray
    second: np.ndarray

    def cells(self, vector: np.ndarray, reach: float) -> list[int]:
        """The own cell, then the others whose border is within ``reach``, nearest first.

        Borders lie half way between codewords. Distances to the borders of both
        halves add up squared; pairs come in ascending order by multi-sequence
        traversal of the two sorted lists.
        """
        half = self.first.shape[1]
        lists = []
        for book, part in ((self.first, vector[:half]), (self.second, vector[half:])):
            d = ((book - part) ** 2).sum(axis=1)
            own = int(d.argmin())
            gap = np.sqrt(((book - book[own]) ** 2).sum(axis=1))
            border = np.where(gap > 0, (d - d[own]) / np.maximum(2 * gap, 1e-12), 0.0)
            border[own] = -1.0  # first, also beside an equal codeword
            order = np.argsort(border, kind="stable")
            lists.append((order, np.maximum(border[order], 0.0) ** 2))
        (a, da), (b, db) = lists
        out, heap, seen = [], [(0.0, 0, 0)], {(0, 0)}
        while heap:
            distance, i, j = heapq.heappop(heap)
            if distance > reach * reach and out:
                break
            out.append(int(a[i]) * len(b) + int(b[j]))
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (da[i2] + db[j2], i2, j2))
        return out


def k_means(points: np.ndarray, k: int, rounds: int = 10, seed: int = 6) -> np.ndarray:
    """Codewords of a bounded sample."""
    random = np.random.Generator(np.random.PCG64(seed))
    points = np.unique(points, axis=0)
    centers = points[np.sort(random.choice(len(points), min(k, len(points)), replace=False))]
    for _ in range(rounds):
        d = (centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T
        near = d.argmin(axis=1)
        for c in np.unique(near):
            centers[c] = points[near == c].mean(axis=0)
    return centers


def unit(vectors: np.ndarray) -> np.ndarray:
    """Of length 1; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def linked_vectors(
    vectors: DataFrame, similarity: float = 0.98, recall: float = 0.9999, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label are linked if their cosine, in doubles, is at least
    ``similarity``. Equal vectors are one entry with a count. Codebooks are fitted
    on a sample, every vector is indexed. A vector visits, nearest first, the
    cells in which a vector at the largest linked distance in a random direction
    still falls with probability above 1 - ``recall`` by its distance to the border; a
    pair is found if one of the two visits the other's cell, and verified.
    Cells with many vectors are cut into blocks that meet in pairs; a task returns
    link counts and a spanning forest, never all its links.

    Vectors that are null, empty, all zero, or hold null or non-finite components, and
    rows with a null label, link with nothing: 0 links, a component of their own.
    Only vectors of the same length are compared. Rows that repeat a vec_id are
    rows of their own that share a component only through links. ``component_id`` is
    the smallest vec_id of the component (a null vec_id comes last). Other
    columns are not looked at.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    good = F.col("label").isNotNull() & usable("v") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    node = F.unhex(F.sha2(F.concat_ws(" ", F.col("label").cast("string"), F.size("v"), F.col("v").cast("array<string>")).cast("binary"), 256))
    rows = rows.withColumn("node", F.when(good, node))
    entries = keep(
        rows.filter("node is not null").groupBy("node").agg(
            F.first("label").cast("string").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
        ),
        "entries",
    )
    links, counts = _links(entries, similarity, recall, sample, block)
    roots = components(links)
    placed = keep(
        entries.select("node", "copies", "least").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node")),
        "placed",
    )
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.join(smallest, "root").select(
        F.col("node").alias("n"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id"
    )
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "node").join(found, F.col("node") == F.col("n"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _links(entries: DataFrame, similarity: float, recall: float, sample: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Spanning links ``(a, b)`` and ``(node, links)``, the rows linked to an entry's rows."""
    sizes = {r["dim"]: (r["count"], r["labels"]) for r in entries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("count"), F.count_distinct("label").alias("labels")).collect()}
    books = {}
    for dim, (n, labels) in sizes.items():
        rows = entries.filter(F.size("v") == dim).orderBy(F.xxhash64("node"), "node").limit(sample).select("v").collect()
        points = unit(np.array([r["v"] for r in rows], np.float64))
        k = int(min(256, max(1, round(math.sqrt(n / (labels * PER_CELL))))))
        half = (dim + 1) // 2
        books[dim] = Index(k_means(points[:, :half], k), k_means(points[:, half:], k) if dim > 1 else np.zeros((1, 0)))
    distance = math.sqrt(2 * (1 - similarity))
    z = NormalDist().inv_cdf(recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, visits = [], []
            for v in batch.column("v").to_pylist():
                x = unit(np.array([v], np.float64))[0]
                found = books[len(v)].cells(x, min(1.0, z / math.sqrt(len(v))) * distance)
                cells.append(f"{len(v)}-{found[0]}")
                visits.append([f"{len(v)}-{c}" for c in found[1:]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.string()), pa.array(visits, pa.list_(pa.string()))],
                names=[*batch.schema.names, "cell", "visits"],
            )

    indexed = keep(
        entries.select("node", "label", "v", "copies").mapInArrow(
            visit, "node binary, label string, v array<double>, copies long, cell string, visits array<string>"
        ),
        "indexed",
    )
    at_home = indexed.select("label", "cell", "node", F.lit(True).alias("home"))
    abroad = indexed.select("label", F.explode("visits").alias("cell"), "node", F.lit(False).alias("home"))
    counts = at_home.unionByName(abroad).groupBy("label", "cell").agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("guests")
    ).filter("homes > 0")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    unit_name = lambda kind, a, b: F.concat_ws("-", F.lit(kind), a, b)
    units = F.when(
        F.col("home"),
        F.concat(
            F.transform(numbers(F.col("homes")), lambda o: unit_name("h", F.least(F.col("own"), o), F.greatest(F.col("own"), o))),
            F.when(F.col("guests") > 0, F.transform(numbers(F.col("guests")), lambda o: unit_name("g", F.col("own"), o))).otherwise(F.array().cast("array<string>")),
        ),
    ).otherwise(F.transform(numbers(F.col("homes")), lambda o: unit_name("g", o, F.col("own"))))
    dealt = (
        at_home.unionByName(abroad)
        .join(counts, ["label", "cell"])
        .withColumn("own", own)
        .select("label", "cell", "node", "home", "own", F.explode(units).alias("unit"))
        .join(indexed.select("node", "v", "copies", F.col("cell").alias("lives"), "visits"), "node")
    )
    out = dealt.groupBy("label", "cell", "unit").applyInPandas(_compare(similarity), "a binary, b binary, links long")
    out = keep(out, "links")
    links = out.filter("b is not null").select("a", "b")
    return links, out.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))


def _compare(similarity: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, low, high = key[2].split("-")
        guests = rows[~rows["home"]]
        homes = rows[rows["home"]]
        if kind == "h":
            left = homes[homes["own"] == int(low)]
            right = left if low == high else homes[homes["own"] == int(high)]
        else:
            left, right = homes, guests
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        x, y = unit(np.array(left["v"].tolist(), np.float64)), unit(np.array(right["v"].tolist(), np.float64))
        close = x @ y.T >= similarity - 1e-9
        a, b = left["node"].tolist(), right["node"].tolist()
        i, j = np.nonzero(close)
        same = _cosines(left, right, i, j) >= similarity
        if kind == "h" and low == high:
            same &= i < j
        elif kind == "g":
            # If each visits the other's cell, the pair counts where the smaller lives.
            visits = [set(v) for v in left["visits"]]
            lives = right["lives"].tolist()
            both = np.array([lives[q] in visits[p] for p, q in zip(i, j, strict=True)], bool)
            smaller = np.array([a[p] < b[q] for p, q in zip(i, j, strict=True)], bool)
            same &= ~both | smaller
        i, j = i[same], j[same]
        n = np.zeros(len(a) + len(b), np.int64)
        np.add.at(n, i, right["copies"].to_numpy()[j])
        np.add.at(n, len(a) + j, left["copies"].to_numpy()[i])
        links = forest([(a[p], b[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)])
        counted = [(v, None, int(c)) for v, c in zip([*a, *b], n, strict=True) if c]
        return pd.DataFrame([*((p, q, 0) for p, q in links), *counted], columns=["a", "b", "links"])

    return compare


def _cosines(left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x, y = (np.array(d["v"].tolist(), np.float64) for d in (left, right))
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        out[s : s + (1 << 16)] = (x[p] * y[q]).sum(axis=1) / np.sqrt(xx[p] * yy[q])
    return out


def forest(links: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """As many of the links as hold the same nodes together."""
    up: dict[bytes, bytes] = {}

    def top(n: bytes) -> bytes:
        while (m := up.get(n, n)) != n:
            up[n] = n = up.get(m, m)
        return n

    out = []
    for a, b in links:
        p, q = top(a), top(b)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((a, b))
    return out
