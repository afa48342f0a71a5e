"""Mixing sources to target weights: budgets down a tree, token-prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import forget, keep

LEVELS = ("domain", "lang", "source")
#: Leaves whose plan is broadcast, at most; with more it is joined by a shuffle.
BROADCAST_LEAVES = 100_000


def default_domain() -> Column:
    """Domains of the test sources: four groups by the number at the end of the name."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("long")
    return F.concat(F.lit("domain"), F.coalesce((number % 4).cast("string"), F.lit("")))


def _own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))


def word_tokens(text: str = "text") -> Column:
    """Tokens of a text for the budgets: its words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def budgets(leaves: DataFrame, weights: Mapping[tuple[str, ...], float], total: Column, max_epochs: float) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with the ``budget`` of each.

    A node's budget goes to its children by their weights (``weights`` by path from
    the root, 1 where nothing is said). A child cannot take more than its leaves
    hold in ``max_epochs`` epochs; what it leaves is shared among its siblings by
    weight, and only what no sibling can take goes to the siblings of the parent.
    As a parent is never given more than all below it that has a weight holds, filling each level
    from the top does just that.
    """
    spark = leaves.sparkSession
    table = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    for depth, level in enumerate(LEVELS, 1):
        path = list(LEVELS[:depth])
        rows = [(*p, float(w)) for p, w in weights.items() if len(p) == depth]
        if rows:
            given = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*path]) + f", w_{level} double")
            table = table.join(F.broadcast(given), path, "left")  # the caller's own list
        else:
            table = table.withColumn(f"w_{level}", F.lit(None).cast("double"))
        table = table.withColumn(f"w_{level}", F.coalesce(f"w_{level}", F.lit(1.0)))
    # What lies under a weight of 0 gets nothing, so its parents do not hold it.
    held = F.col("cap")
    for depth in range(len(LEVELS), 0, -1):
        level = LEVELS[depth - 1]
        table = table.withColumn(f"cap_{level}", F.sum(held).over(Window.partitionBy(*LEVELS[:depth])))
        held = F.when(F.col(f"w_{level}") > 0, held).otherwise(0.0)
    table = table.withColumn("budget", total)
    for depth, level in enumerate(LEVELS, 1):
        nodes = table.groupBy(*LEVELS[:depth]).agg(
            F.first("budget").alias("b"), F.first(f"w_{level}").alias("w"), F.first(f"cap_{level}").alias("c")
        )
        table = table.drop("budget").join(_fill(nodes, list(LEVELS[: depth - 1])), list(LEVELS[:depth]))
    return table.select(*LEVELS, "tokens", "budget")


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Share ``b`` of each parent among children of weight ``w`` and capacity ``c``.

    In ascending order of capacity for its weight, a child is full as long as an
    equal share of what is left, by weight, is more than it holds; from the first
    that is not, all get that share.
    """
    name = [c for c in nodes.columns if c in LEVELS]
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("c") / F.col("w")).asc_nulls_last(), *name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    shared = nodes.withColumn("used", F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("c"))).over(before), F.lit(0.0))).withColumn(
        "left", F.sum("w").over(rest)
    )
    shared = shared.withColumn("rate", F.when(F.col("left") > 0, (F.col("b") - F.col("used")) / F.col("left"))).withColumn(
        "full", (F.col("w") > 0) & (F.col("c") <= F.col("rate") * F.col("w"))
    )
    rate = F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    budget = F.when(F.col("w") <= 0, F.lit(0.0)).when(F.col("full"), F.col("c")).otherwise(F.greatest(F.lit(0.0), rate * F.col("w")))
    return shared.withColumn("budget", budget).select(*name, "budget")


def mix(
    docs: DataFrame,
    weights: Mapping[tuple[str, ...], float] | None = None,
    total: int | None = None,
    fraction: float = 1.0,
    max_epochs: int = 2,
    seed: int = 10,
    domain: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """``docs`` with ``epoch`` and ``n_tokens``: a row per selected copy of a document.

    The budget is ``total`` tokens, or ``fraction`` of all tokens of ``docs``. Each
    leaf ``(domain, lang, source)`` goes through whole epochs while its budget
    lasts; of the last epoch it takes the longest prefix, in the order of a seeded
    hash of the epoch and doc_id, whose tokens fit. Rows of equal hash and doc_id
    (repeated rows, null ids) are taken together or not at all.

    Null lang or source is a leaf of its own, named by the empty string. A null or
    empty text has no tokens; it comes with the epochs and prefixes it lies in. An
    empty table gives an empty one. Columns called ``epoch`` or ``n_tokens`` are
    replaced.

    The prefix of a leaf of any size is found without sorting it: tokens are summed
    by ranges of the hash, and only the range in which the budget ends is ordered.
    """
    domain = default_domain() if domain is None else domain
    tokens = word_tokens() if tokens is None else tokens
    leaf = [domain.alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]
    sizes = keep(docs.select("doc_id", *leaf, tokens.alias("tokens")), "sizes")
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    everything = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    plan = budgets(leaves, weights or {}, F.lit(float(total if total is not None else everything * fraction)), max_epochs)
    fits = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(F.lit(0)).cast("long")
    plan = keep(plan.withColumn("epochs", fits).withColumn("rest", F.col("budget") - fits * F.col("tokens") + 1e-6), "plan")
    if plan.count() <= BROADCAST_LEAVES:
        small = F.broadcast
    else:
        small = lambda df: df
    order = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    placed = sizes.join(small(plan.select(*LEVELS, "epochs", "rest")), list(LEVELS)).withColumn("h", order)
    placed = placed.withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    ranges = placed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    ranges = ranges.withColumn("upto", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    last = ranges.filter("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")), "bucket").alias("m"))
    last = keep(last.select(*LEVELS, F.col("m.bucket").alias("bucket"), F.col("m.before").alias("before")), "ranges")
    inside = placed.join(small(last), [*LEVELS, "bucket"])
    # Rows of equal order count together: the frame is a range.
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("h", _own_id()))
    cut = inside.withColumn("running", running).filter("running <= rest").groupBy(*LEVELS).agg(
        F.max(F.struct("h", _own_id().alias("d"))).alias("cut")
    )
    cuts = keep(
        plan.select(*LEVELS, "epochs", "rest")
        .join(last.select(*LEVELS, "bucket"), list(LEVELS), "left")
        .join(cut, list(LEVELS), "left"),
        "plan",
    )
    forget(sizes, plan, last)
    taken = docs.drop("epoch", "n_tokens")
    names = [f"__{c}" for c in LEVELS]
    marked = taken.select(*taken.columns, *[c.alias(n) for c, n in zip([domain, F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))], names, strict=True)])
    renamed = cuts.select(*[F.col(c).alias(f"__p{c}") for c in LEVELS], *[F.col(c).alias(f"__{c}") for c in ("epochs", "bucket", "cut")])
    same = reduce(lambda a, b: a & b, [F.col(f"__{c}") == F.col(f"__p{c}") for c in LEVELS])
    joined = marked.join(small(renamed), same)
    h = F.xxhash64(F.lit(seed), "__epochs", "doc_id")
    bucket = F.shiftrightunsigned(h, 52).cast("int")
    key = F.struct(h.alias("h"), _own_id().alias("d"))
    in_prefix = F.col("__bucket").isNull() | (bucket < F.col("__bucket")) | ((bucket == F.col("__bucket")) & (key <= F.col("__cut")))
    copies = F.col("__epochs") + F.when(in_prefix, F.lit(1)).otherwise(F.lit(0))
    copies = F.least(copies, F.lit(max_epochs))
    out = joined.withColumn("__copies", copies).filter("__copies > 0")
    return out.select(
        *taken.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long"))).alias("epoch"), tokens.alias("n_tokens")
    )
