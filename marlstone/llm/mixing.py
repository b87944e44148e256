"""Mixing sources to target weights by systematic sampling.

Each source gets a share of all words by weight, held to a multiple of its own words. Every document of a source
then expects target / source size copies. Documents stand in an order (size, then a digest of the id), the expected
copies are summed along it, one random offset is added, and a document is emitted once for each whole number that
the running sum crosses. The order by size makes the words taken differ from the target by less than the largest
document, whatever the offset.

A running sum over a source would put a third of all rows in one task, so it is a rank found in levels: counts by
(source, size, digest bucket), prefix sums over those counts, and a row number inside a bucket. The digest bucket
splits groups of equal size 256 ways. Only sums for each source, a row each, are ordered in one task.

Defined results: a null text counts as empty (size 0) and a null source is a source of its own, last in the order;
sources whose words are all zero have target 0 and none of their documents is taken; an empty table gives an empty
one; rows that are alike in id, size and text are told apart by nothing and so may swap their copies. Extra columns
are passed on; those whose names clash with a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import count_words, fresh, text_of

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix"


def source_key(source: Column) -> Column:
    """A key without nulls in the order of the sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (skey, source_size), a row for each source, adds target.

    Targets are weight times a common level, but at most max_repeat times the source. With sources by the level at
    which they reach that limit, the reached ones are a prefix: prefix sums give the level that each prefix leaves.
    """
    order = Window.orderBy("skey")
    every = Window.partitionBy()
    w = F.element_at(F.array(*(F.lit(int(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", w)
    s = s.withColumns({"bound": F.col("source_size") * max_repeat, "total": F.sum("source_size").over(every)})
    s = s.withColumn("reach", F.col("bound") / F.col("w"))
    up_to = Window.orderBy("reach", "skey")
    before, rest = up_to.rowsBetween(Window.unboundedPreceding, -1), up_to.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({"held_before": F.coalesce(F.sum("bound").over(before), F.lit(0)), "w_rest": F.sum("w").over(rest)})
    s = s.withColumn("held", F.col("reach") <= (F.col("total") - F.col("held_before")) / F.col("w_rest"))
    s = s.withColumns({
        "held_sum": F.coalesce(F.sum(F.when(F.col("held"), F.col("bound"))).over(every), F.lit(0)),
        "w_free": F.coalesce(F.sum(F.when(~F.col("held"), F.col("w"))).over(every), F.lit(0)),
    })
    level = (F.col("w") * (F.col("total") - F.col("held_sum"))).cast("double") / F.nullif(F.col("w_free"), F.lit(0))
    return s.select("skey", "source_size", F.when(F.col("held"), F.col("bound").cast("double")).otherwise(level).alias("target"))


def offset(skey: Column, seed: str = SEED) -> Column:
    """The random offset of a source, in [0, 1): fixed by the seed, so reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), skey)), 1, 8)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def plan_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *,
    weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED,
) -> DataFrame:
    """docs with size, source_size, target and copies (all of the document: 0 to max_repeat)."""
    results = ("size", "source_size", "target", "copies")
    # Columns one by one under names of our own: those that aren't asked for, the text often, are never shuffled.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    sized = docs.select(
        *(F.col(c).alias(n) for c, n in own.items()),
        F.xxhash64(text_of(text)).alias("tie"),
        source_key(F.col(source)).alias("skey"),
        count_words(text_of(text)).alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("digest"),
    ).withColumn("bucket", F.substring("digest", 1, 2))

    counts = sized.groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_size = counts.groupBy("skey", "size").agg(F.sum("n").alias("n_size"))
    targets = source_targets(by_size.groupBy("skey").agg(F.sum(F.col("n_size") * F.col("size")).alias("source_size")), weights, max_repeat)
    smaller = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("before_size", F.coalesce(F.sum("n_size").over(smaller), F.lit(0))).join(targets, "skey").drop("n_size")
    in_size = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before_bucket", F.coalesce(F.sum("n").over(in_size), F.lit(0))).drop("n")
    starts = starts.join(by_size, ["skey", "size"]).withColumn("start", F.col("before_size") + F.col("before_bucket")).drop("before_size", "before_bucket")

    inside = Window.partitionBy("skey", "size", "bucket").orderBy("digest", "tie")
    ranked = sized.join(starts, ["skey", "size", "bucket"]).withColumn("k", F.col("start") + F.row_number().over(inside))
    crossed = lambda k: F.floor(F.coalesce(k * F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)) + offset(F.col("skey"), seed))
    copies = crossed(F.col("k")) - crossed(F.col("k") - 1)
    kept = [F.col(n).alias(c) for c, n in own.items() if c.lower() not in results]
    return ranked.select(*kept, "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: every row of docs as often as plan_copies says, with the columns of docs."""
    held, again = docs.select(F.struct(*docs.columns).alias("row"), *(F.col(c).alias(a) for c, a in ((doc_id, "mix_id"), (text, "mix_text"), (source, "mix_source")))), fresh("copy", docs.columns)
    planned = plan_copies(held, "mix_id", "mix_text", "mix_source", **how).filter("copies > 0")
    return planned.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(again)).drop(again)
