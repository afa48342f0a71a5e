"""Exact top-k by inner product: tiles of queries times tiles of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a tile.
TILE = 1024
#: Query tiles are broadcast up to this many bytes, else joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Up to here every integer is a double, and so is every partial sum of a product.
EXACT = float(2**53)


def usable(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def pack_tiles(vectors: DataFrame, scale: float, tile: int = TILE) -> DataFrame:
    """``(dim, ids, values, top)``: tiles of ``vectors(vec_id, v)`` as floor(scale * x)
    in doubles, one after the other as they are read; ``top`` is the largest absolute value."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("top", pa.float64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def rows(dim: int) -> pa.RecordBatch:
            part = waiting.pop(dim)
            ids = np.array([p[0] for p in part], np.int64)
            data = np.floor(scale * np.array([p[1] for p in part], np.float64).reshape(len(part), dim))
            order = np.argsort(ids, kind="stable")
            top = float(np.abs(data).max(initial=0.0))
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([data[order].tobytes()]), pa.array([top])], schema=schema
            )

        for batch in batches:
            v = batch.column("v")
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                vector = flat[ends[i] : ends[i + 1]]
                part = waiting.setdefault(len(vector), [])
                part.append((vec_id, vector))
                if len(part) >= tile:
                    yield rows(len(vector))
        for dim in list(waiting):
            yield rows(dim)

    return vectors.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(
        pack, "dim int, ids binary, data binary, top double"
    )


def best_in_tile(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``scores (queries, candidates)``: query index, id and score of the k best
    per query, the smaller id of equal ones first; ``ids`` ascend. A query's own id
    is left out."""
    query, found, value = [], [], []
    for q in range(len(scores)):
        row, others = scores[q], np.flatnonzero(ids != own[q])
        if len(others) > k:
            part = row[others]
            least = np.partition(part, len(part) - k)[len(part) - k]
            others = others[part >= least]
        order = others[np.argsort(-row[others], kind="stable")[:k]]
        query += [q] * len(order)
        found += ids[order].tolist()
        value += row[order].tolist()
    return np.array(query, np.int64), np.array(found, np.int64), np.array(value)


def product(queries: np.ndarray, candidates: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; where doubles would round, with integers of any size."""
    if exact:
        return queries @ candidates.T
    big = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return (big(queries) @ big(candidates).T) if queries.shape[1] else np.zeros((len(queries), len(candidates)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, tile: int = TILE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of every query.

    ``vectors(vec_id, embedding)``; queries are the rows where ``is_query`` holds,
    candidates all rows but those with the query's own id. Components become
    floor(scale * x). Query tiles meet candidate tiles as matrix products; of each
    product only the k best per query go on; a task merges the lists of its tiles,
    and the lists of the tasks are merged by a rank whose limit Spark applies
    before the shuffle too.

    Vectors that are null or hold null or non-finite components, and rows without a
    vec_id, take no part. Only vectors of the same length are compared. A repeated
    vec_id is a candidate as often as it stands; as a query it is asked once for
    each of its vectors, and the lists are merged. A product that no long holds counts as the
    nearest one. With fewer than k candidates all
    are returned. Other columns are not looked at; an empty table gives an empty one.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), is_query.alias("q")).filter(
        F.col("vec_id").isNotNull() & usable("v")
    )
    asked = rows.filter("q")
    candidates = pack_tiles(rows, scale, tile)
    queries = pack_tiles(asked, scale, tile).select(
        "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("top").alias("q_top")
    )
    size = asked.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        pairs = candidates.join(F.broadcast(queries), "dim")
    else:  # copies of the query tiles on so many keys that no task gets all candidates
        salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = candidates.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).join(
            queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))), ["dim", "salt"]
        )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, data, top, q_ids, q_data, q_top = (batch.column(c)[i].as_py() for c in ("dim", "ids", "data", "top", "q_ids", "q_data", "q_top"))
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                c, q = np.frombuffer(data).reshape(len(ids), dim), np.frombuffer(q_data).reshape(len(q_ids), dim)
                scores = product(q, c, max(1, dim) * top * q_top < EXACT)
                for n, vec_id, score in zip(*best_in_tile(scores, ids, q_ids, k), strict=True):
                    lists.setdefault(int(q_ids[n]), []).append((-int(score), int(vec_id)))
                for query, best in lists.items():
                    if len(best) > 8 * k:
                        lists[query] = sorted(best)[:k]
            if sum(map(len, lists.values())) > 1 << 20:
                yield _rows(lists, k, schema)
                lists = {}
        yield _rows(lists, k, schema)

    found = pairs.mapInArrow(multiply, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(lists: dict[int, list[tuple[int, int]]], k: int, schema: pa.Schema) -> pa.RecordBatch:
    flat = [(q, v, max(-(2**63), min(2**63 - 1, -s))) for q, best in lists.items() for s, v in sorted(best)[:k]]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], schema=schema)
