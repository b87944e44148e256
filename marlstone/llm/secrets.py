"""Secret scans with corpus-wide ownership frequency.

Patterns give the candidates of each text: assignments, access keys, long hexadecimal runs, and any other long token of
letters and digits. All candidates' values are hashed, and Spark counts in how many distinct repositories and owners
each hash occurs. A value that few owners have is theirs: it looks live. One that many have is copied about, an example.
Candidates of the first three kinds are always reported; other tokens only if they are owned and overlap none of those.

A pattern's places come from splitting the text at its matches: the lengths of pieces and matches, summed in order. The
sums and all later steps run over rows of matches, for the texts that have any, so a text may have any number of them.
Counts aggregate before they are shuffled; a value that a third of all documents hold is one row in each task.

Defined results: a null or empty text has no spans; null owners and repositories count as one of their own; repeated
rows and equal ids are judged row by row (and count once for an owner); an empty table gives an empty one; extra columns
are not carried, so their names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, text_of

MAX_OWNERS, MAX_REPOSITORIES = 2, 4


@dataclass(frozen=True)
class Kind:
    """pattern finds all matches; a match counts if its group has at least `least` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    """A pattern without flags: each letter in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


ASSIGNED = f"({either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The order is that of kinds at the same place. A run of a class of characters can only match from its first one on,
#: which the look behind says, so that other places need no attempt.
BASE = (
    Kind("assign", ASSIGNED, 2, 6),
    Kind("access", "AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", "(?<![0-9a-f])[0-9a-f]{24,}"),
)
OTHER = Kind("owned", "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def matches(body: Column, kind: Kind, number: int) -> Column:
    """An array of (kind, i, gap, size, value) for the matches; texts without one, most of them, cost a single search."""
    found = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    gaps = F.transform(F.split(body, kind.pattern, -1), F.length)
    zipped = F.arrays_zip(F.transform(found, F.length).alias("size"), value.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    rows = F.transform(zipped, lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    return F.when(body.rlike(kind.pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:string>>"))


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str, repository: list[str]) -> DataFrame:
    """(rid, doc_id, owner, repo, found) for each row, written once: a number for the row and its matches of all kinds."""
    body = text_of(text)
    found = F.concat(*(matches(body, k, i) for i, k in enumerate((*BASE, OTHER))))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.struct(*(F.col(c).alias(f"r{i}") for i, c in enumerate(repository))).alias("repo"), found.alias("found"))
    return materialise(slim.withColumn("rid", F.monotonically_increasing_id()), "candidates")


def spans(found: DataFrame) -> DataFrame:
    """(rid, owner, repo, kind, start, end, h): the matches that count, with places in code points."""
    rows = found.filter(F.size("found") > 0).select("rid", "owner", "repo", F.explode("found").alias("m")).select("rid", "owner", "repo", "m.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    counts = F.lit(False)
    for i, k in enumerate(BASE):
        counts = counts | ((F.col("kind") == i) & (F.length("value") >= k.least))
    counts = counts | ((F.col("kind") == len(BASE)) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    return rows.filter(counts).select("rid", "owner", "repo", "kind", "start", "end", F.xxhash64("value").alias("h"))


def ownership(found: DataFrame) -> DataFrame:
    """(h, owners, repositories): in how many distinct ones each value occurs."""
    once = found.select("h", "owner", "repo").distinct()
    by_owner = once.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), *,
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """For each row doc_id, found (array of kind, start, end, owned, owners, repositories by start), numbers by kind, n_owned and n_shared."""
    all_rows = candidates(docs, doc_id, text, owner, list(repository))
    found = spans(all_rows)
    # A table of its own, so that the join below has no aggregation on its exchange and Spark can split a value that many hold.
    verdicts = materialise(ownership(found).withColumn("owned", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)), "owners")
    base = F.col("kind") < len(BASE)
    # Spans before in order of start that reach over this one's start, and later ones that start before its end.
    in_text = Window.partitionBy("rid").orderBy("start", "kind")
    over = F.max(F.when(base, F.col("end"))).over(in_text.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    under = F.min(F.when(base, F.col("start"))).over(in_text.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    placed = found.withColumn("covered", F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False))).drop("owner", "repo")
    kept = placed.join(verdicts, "h").filter(base | (F.col("owned") & ~F.col("covered")))
    span = F.struct("start", "kind", "end", "owned", "owners", "repositories")
    numbers = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    numbers += [F.count(F.when(F.col("owned"), 1)).alias("n_owned"), F.count(F.when(~F.col("owned"), 1)).alias("n_shared")]
    by_row = kept.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"), *numbers)
    names = [f"n_{k.name}" for k in BASE] + ["n_owned", "n_shared"]
    some = all_rows.filter(F.size("found") > 0).select("rid", "doc_id").join(by_row, "rid", "left")
    none = all_rows.filter(F.size("found") == 0).select("doc_id")
    empty = F.array().cast(by_row.schema["spans"].dataType)
    zero = F.lit(0).cast("long")
    return some.select("doc_id", F.coalesce("spans", empty).alias("spans"), *(F.coalesce(c, zero).alias(c) for c in names)).union(
        none.select("doc_id", empty.alias("spans"), *(zero.alias(c) for c in names))
    )


def written(all_spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in (*BASE, OTHER)))
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
