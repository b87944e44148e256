"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated runs are deleted.

Each document is a sequence of line ids (blank lines don't count). The rank of a suffix by its first line is the number
of lines with a smaller id. A round doubles the depth: suffixes are ranked by the pair of their own rank and the rank
of the suffix that many lines on, so a suffix's new rank is its old one plus the number of suffixes of its group with a
smaller second rank. Suffixes of equal rank at a depth are an interval of the suffix array with at least that longest
common prefix. The array is sorted as deep as the shortest run that counts, min_lines: deeper rounds would only order
suffixes inside those intervals, and no line goes or stays by that order.

Of every interval the first occurrence (by document id, then place) stays. Maximal runs come from the intervals by
alignment: as long as a document's suffixes, one place after the other, have their first occurrences one place after
the other as well, they are one run, and its length is the longest common prefix of its first suffix with its source.
All lines of such runs go.

Ranks are prefix sums over counts in two levels (ranges, then inside a range), so no task holds a group: a line that a
third of all documents have is one row of the counts. Only the joins that carry ranks back to lines see it, and Spark
splits those. Each round is written to the shared folder.

Defined results: null, empty and white texts have no lines and stay as they are; a null id counts as larger than all
others; rows alike in id and text count as one document and get the same result; equal ids with different texts stand in
the order of a hash of the text; a very long text is one row as long as its lines are rows of their own; an empty table
gives an empty one. Extra columns are passed on; those named like a
result column give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import WHITE, discard, kept_where, materialise, text_of

MIN_LINES = 3
RANGES = 1024
LAST = (1 << 63) - 1


def has_word(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, WHITE, " " * len(WHITE)))) > 0


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs as (id, tk, body, c0, c1, ...): a key for rows, the text, and the given columns under names of our own."""
    body = text_of(text)
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(body).alias("tk"), body.alias("body"), *own)


def first_ranks(lines: DataFrame) -> DataFrame:
    """(id, tk, pos, rank): the number of lines with a smaller line id."""
    counts = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.shiftright("line", 54))
    ahead = _starts(counts, [], "range", "line")
    return lines.join(ahead, "line").select("id", "tk", "pos", F.col("start").alias("rank"))


def _starts(counts: DataFrame, group: list[str], by: str, order: str) -> DataFrame:
    """counts with start: the sum of n over rows of the group that come before, by range of the order and then inside it."""
    ranges = counts.groupBy(*group, by).agg(F.sum("n").alias("n_range"))
    over = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*group, by, F.coalesce(F.sum("n_range").over(over), F.lit(0)).alias("before_range"))
    inside = Window.partitionBy(*group, by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ranges, [*group, by])
    return placed.withColumn("start", F.col("before_range") + F.col("before")).drop("before", "before_range", "n", by)


def with_next(ranks: DataFrame, lines_on: int) -> DataFrame:
    """ranks with next: the rank of the suffix so many lines on, -1 behind the document's end."""
    at = Window.partitionBy("id", "tk").orderBy("pos").rangeBetween(lines_on, lines_on)
    return ranks.withColumn("next", F.coalesce(F.first("rank").over(at), F.lit(-1)))


def doubled(ranks: DataFrame, depth: int, total: int) -> DataFrame:
    """Ranks at twice the depth."""
    pairs = with_next(ranks, depth)
    counts = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("range", F.floor((F.col("next") + 1) * F.lit(RANGES) / F.lit(total + 1)).cast("int"))
    starts = _starts(counts, ["rank"], "range", "next")
    return pairs.join(starts, ["rank", "next"]).select("id", "tk", "pos", (F.col("rank") + F.col("start")).alias("rank"))


def later_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(id, tk, start, length, source_id, source_tk, source_start): the maximal runs of at least min_lines lines that repeat.

    A run lies in document (id, tk) at `start`, counted in lines with a word, and as well, before that, in the source.
    """
    slim = keyed(docs.select(doc_id, text), doc_id, text)
    lines = slim.select("id", "tk", F.posexplode(F.transform(F.filter(split_lines(F.col("body")), has_word), lambda x: F.xxhash64(x))).alias("pos", "line"))
    lines = materialise(lines, "lines")
    ranks, depth = materialise(first_ranks(lines), "ranks"), 1
    discard(lines)
    total = ranks.count()
    while depth * 2 <= min_lines:
        before, ranks, depth = ranks, materialise(doubled(ranks, depth, total), "ranks"), depth * 2
        discard(before)
    # Depth min_lines in one more step, by two prefixes that overlap; suffixes that end before are in no run.
    tops = with_next(ranks, min_lines - depth) if min_lines > depth else ranks.withColumn("next", F.col("rank"))
    last = Window.partitionBy("id", "tk")
    tops = tops.withColumn("end", F.max("pos").over(last)).filter(F.col("pos") + (min_lines - 1) <= F.col("end")).drop("end")
    place = F.struct("id", "tk", "pos")
    groups = tops.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    again = tops.join(groups, ["rank", "next"]).filter(place != F.col("first")).select("id", "tk", "pos", "first")
    # A suffix goes on with the run of the one before it if both are one place further than theirs.
    previous = Window.partitionBy("id", "tk").orderBy("pos")
    follows = F.lag("pos").over(previous) == F.col("pos") - 1
    moved = F.lag("first").over(previous) == F.struct(F.col("first.id"), F.col("first.tk"), F.col("first.pos") - 1)
    runs = again.withColumn("run", F.sum(F.when(follows & moved, 0).otherwise(1)).over(previous))
    runs = runs.groupBy("id", "tk", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    source = [F.col(f"first.{c}").alias(f"source_{n}") for c, n in (("id", "id"), ("tk", "tk"), ("pos", "start"))]
    return runs.select("id", "tk", "start", (F.col("n") + (min_lines - 1)).cast("int").alias("length"), *source)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with the text cut, and n_lines, n_removed (lines with a word) added."""
    results = ("n_lines", "n_removed")
    runs = later_runs(docs, doc_id, text, min_lines).groupBy("id", "tk").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    rows = keyed(docs, doc_id, text).join(runs, ["id", "tk"], "left")
    rows = rows.withColumn("lines", split_lines(F.col("body")))
    # Places of lines with a word, in the order in which runs count them.
    rows = rows.withColumn("worded", F.filter(F.transform("lines", lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull()))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))))
    rows = rows.withColumn("gone", F.transform(covered, lambda k: F.get("worded", k)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    columns = []
    for i, c in enumerate(docs.columns):
        if c == text:
            columns.append(F.when(F.col(f"c{i}").isNotNull(), cut).alias(c))
        elif c.lower() not in results:
            columns.append(F.col(f"c{i}").alias(c))
    return rows.select(*columns, F.size("worded").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def drop_copied(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with the text cut; documents of which no line is left, though they had some, go."""
    held = docs.select(F.col(doc_id).alias("line_id"), F.col(text).alias("line_text"), F.struct(*(c for c in docs.columns if c != text), F.lit(0).alias("_")).alias("held"))
    left = kept_where(dedup_lines(held, "line_id", "line_text", min_lines), "n_removed = 0 OR n_removed < n_lines")
    return left.select(*(F.col("line_text").alias(c) if c == text else F.col("held")[c].alias(c) for c in docs.columns))
