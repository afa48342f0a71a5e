"""Connected components of a table of links, as joins and partial aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import forget, keep, tidy

#: Links that a task joins by itself, about half a megabyte.
PART = 1 << 14


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``, a kept table, of every node in ``links(a, b)``; the root is the smallest node.

    Each task turns its own links, ``PART`` of them or so, into stars around the smallest
    nodes. If that is more than one task's work, two steps alternate until nothing
    changes: each node hands the smallest node it knows to its larger neighbours,
    then to its smaller ones. The table shrinks to a star per component in a few
    rounds; each round is kept in the shared folder. A node with very many links is a key with many rows on one side of a
    join only, which adaptive execution splits; minima are combined before the
    shuffle. Links that are null on a side or join a node to itself say nothing.
    """
    a, b = F.col("a"), F.col("b")
    given = keep(
        links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")),
        "edges",
    )
    parts = -(-given.count() // PART) or 1
    edges = keep(given.coalesce(parts).mapInArrow(_stars(to_arrow_schema(given.schema)), given.schema), "edges")
    forget(given)
    before = None
    while parts > 1 and (now := _print(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(
            F.col("u").alias("c"), F.least("u", "low").alias("low")
        )
        large = edges.join(low, F.col("v") == F.col("c")).select("u", F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        last, edges = edges, keep(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
        forget(last)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    roots = keep(roots, "roots")
    forget(edges)
    return roots


def _stars(schema: pa.Schema):
    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x: object) -> object:
            while x in up:
                if (y := up[x]) in up:
                    up[x] = up[y]
                x = y
            return x

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(up), schema.types[0]), pa.array([top(x) for x in up], schema.types[1])], schema=schema)

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
                if len(up) > PART:  # a task of more links than meant: so far as it came
                    yield stars()
                    up.clear()
        yield stars()

    return join


def _print(edges: DataFrame) -> tuple:
    """Two equal tables of distinct rows have the same."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)
