"""Which sets lie inside which other sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.levels import cut_lineage
from fleetlens.plans.skew import HOT_ROWS, grid_join


def contained_in(
    left: DataFrame, right: DataFrame, on: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(on, left_id, right_id)`` where the set of ``left(on, left_id, left_items)`` is part of
    that of ``right(on, right_id, right_items)`` and the columns ``on`` are equal.

    An inverted index over the right sets is asked for one item of each left set: the
    one that fewest right sets have. Only those candidates are compared item by item, so
    an item that a third of all sets have costs nothing unless a left set has only
    such items. Where many left sets ask for one hot item, its pairs are split into cells.

    Items are compared as values, repeats count once, nulls are no items. Null sets
    and empty ones give no pair: an empty set is in every set, which needs no list. Ids
    are unique within a side; null values of ``on`` match nothing.
    """
    on = list(on)

    def items(side: str) -> DataFrame:
        df = left if side == "left" else right
        return df.select(*on, f"{side}_id", F.array_distinct(F.array_compact(f"{side}_items")).alias(f"{side}_items"))

    ours, theirs = items("left"), items("right")
    postings = theirs.select(*on, "right_id", "right_items", F.explode("right_items").alias("item"))
    shares = postings.groupBy(*on, "item").agg(F.count("*").alias("n"))
    asked = ours.select(*on, "left_id", "left_items", F.explode("left_items").alias("item")).join(shares, [*on, "item"], "left")
    rarest = F.min_by("item", F.struct("n", "item"))
    # An item that no right set has is null in n, and no right set will do.
    probes = cut_lineage(
        asked.groupBy(*on, "left_id").agg(
            rarest.alias("item"), F.count("n").alias("known"), F.count("*").alias("all_items"), F.first("left_items").alias("left_items")
        ).filter("known = all_items").select(*on, "item", "left_id", "left_items")
    )
    wanted = postings.join(probes.select(*on, "item").distinct(), [*on, "item"], "left_semi")
    pairs = grid_join(probes, wanted.select(*on, "item", "right_id", "right_items"), [*on, "item"], "left_id", "right_id", hot_rows)
    inside = (F.size("left_items") <= F.size("right_items")) & (
        F.size(F.array_intersect("left_items", "right_items")) == F.size("left_items")
    )
    return pairs.filter(inside).select(*on, "left_id", "right_id")
