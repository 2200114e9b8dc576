"""Repository listings: tree sizes, recently changed files, stacks, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import bytes_text


def tree_size(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total size of the files in a tree listing (per branch)."""
    return rows.where("type = 'blob'").groupBy(*(by or [])).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def tree_size_diff(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: sizes of two branches and their difference, as numbers and text; a negative difference keeps its unit."""
    size = lambda branch: F.coalesce(F.sum(F.when((F.col("branch") == branch) & (F.col("type") == "blob"), F.col("size"))), F.lit(0))
    sums = rows.agg(size(a).alias("size_a"), size(b).alias("size_b")).withColumn("diff", F.col("size_a") - F.col("size_b"))
    return sums.select("*", *(bytes_text(F.col(c)).alias(f"{c}_text") for c in ("size_a", "size_b", "diff")))


def recent_files(rows: DataFrame) -> DataFrame:
    """(date, branch, file): per file and branch the date that the log shows first, ordered by all three."""
    first = rows.groupBy("file", "branch").agg(F.min_by("date", "line_no").alias("date"))
    return first.select("date", "branch", "file").orderBy("date", "branch", "file")


def by_others(commits: DataFrame, me: str, now: Column, days: int = 7) -> DataFrame:
    """Commits of the last days by anyone else."""
    return commits.where((F.col("author") != me) & (F.col("ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))


def collapse_stacks(rows: DataFrame) -> DataFrame:
    """(stack, count): samples per stack."""
    return rows.groupBy("stack").agg(F.sum("count").cast("long").alias("count"))


def _pairs(body: Column) -> Column:
    """key = value pairs of a dependency's body, in order: strings, arrays, booleans and numbers."""
    items = F.regexp_extract_all(body, F.lit(r'[a-zA-Z0-9_-]+\s*=\s*(?:"[^"]*"|\[[^\]]*\]|[^,\s"\[\]]+)'), F.lit(0))
    return F.transform(items, lambda i: F.struct(F.regexp_extract(i, r"^([a-zA-Z0-9_-]+)", 1).alias("k"), F.trim(F.regexp_replace(i, r"^[a-zA-Z0-9_-]+\s*=\s*", "")).alias("v")))


def rewrite_dependencies(blocks: DataFrame, git_url: str, branch: str | None = None, local_root: str = "..") -> DataFrame:
    """Dependency blocks with their ``rewritten`` line, null where the git URL is another.

    With a branch, a tag becomes that branch in its place at the end; without
    one, git, tag and branch give way to a path below ``local_root``. Values
    that are no strings are kept.
    """
    pairs = _pairs(F.col("body"))
    git = F.get(F.filter(pairs, lambda p: p["k"] == "git"), F.lit(0))["v"]
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    add = lambda k, v: F.array(F.struct(F.lit(k).alias("k"), quoted(v).alias("v")))
    if branch:
        tagged = F.exists(pairs, lambda p: p["k"] == "tag")
        new = F.when(tagged, F.concat(F.filter(pairs, lambda p: ~p["k"].isin("tag", "branch")), add("branch", F.lit(branch)))).otherwise(pairs)
    else:
        new = F.concat(F.filter(pairs, lambda p: ~p["k"].isin("git", "tag", "branch", "path")), add("path", F.concat(F.lit(f"{local_root}/"), F.col("name"))))
    line = F.concat(F.col("name"), F.lit(" = { "), F.array_join(F.transform(new, lambda p: F.concat(p["k"], F.lit(" = "), p["v"])), ", "), F.lit(" }"))
    return blocks.withColumn("rewritten", F.when(F.contains(git, F.lit(git_url)), line))


def apply_rewrites(texts: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(path, value) with each rewritten block in place of the old one."""
    changes = rewritten.where("rewritten IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("nth", "block", "rewritten"))).alias("changes"))
    new = F.aggregate("changes", F.col("value"), lambda text, c: F.replace(text, c["block"], c["rewritten"]))
    return texts.join(changes, "path", "left").select("path", F.coalesce(new, "value").alias("value"))
