"""Repository listings as DataFrames, from lines of text as the command line prints them.

Listings of one line an entry take a DataFrame with ``value`` (``spark.read.text``, or a stream) and keep
its other columns; entries of several lines take (key, line_no, text), one key a listing.  Null and blank
lines give no rows; a missing field is null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import host_kind, protocol


def field(k: int, separator: str = "\t") -> Column:
    """The trimmed field k (from 0) of ``value``; null if it is missing or blank."""
    return F.nullif(F.trim(F.get(F.split("value", separator), F.lit(k))), F.lit(""))


def number(pattern: str) -> Column:
    return F.coalesce(F.regexp_extract("value", pattern, 1).try_cast("int"), F.lit(0))


def entries(lines: DataFrame, **columns: Column) -> DataFrame:
    return lines.where(F.trim("value") != "").withColumns(columns).drop("value")


def branches(lines: DataFrame) -> DataFrame:
    """name, HEAD mark, upstream, track and date by tabs; ``gone`` if the upstream was deleted."""
    track = F.coalesce(F.get(F.split("value", "\t"), F.lit(3)), F.lit(""))
    count = lambda word: F.coalesce(F.regexp_extract(track, word + r" (\d+)", 1).try_cast("int"), F.lit(0))
    return entries(
        lines,
        name=field(0),
        current=F.coalesce(field(1) == "*", F.lit(False)),
        upstream=field(2),
        ahead=count("ahead"),
        behind=count("behind"),
        gone=F.contains(track, F.lit("[gone]")),
        last_commit_at=F.try_to_timestamp(field(4), F.lit("yyyy-MM-dd HH:mm:ss Z")),
    )


def tags(lines: DataFrame) -> DataFrame:
    """name, type, target, date, tagger and subject by tabs; the target's first eight characters."""
    return entries(lines, name=field(0), tag_type=F.coalesce(field(1), F.lit("lightweight")), target_hash=F.left(field(2), F.lit(8)), created_at=field(3), creator_name=field(4), subject=field(5))


def reflog(lines: DataFrame) -> DataFrame:
    """Six fields by tabs; lines with fewer are dropped."""
    names = ("commit_hash", "short_hash", "ref_selector", "action_summary", "author_name", "authored_at")
    return entries(lines.where(F.size(F.split("value", "\t")) >= len(names)), **{name: field(k) for k, name in enumerate(names)})


def stashes(lines: DataFrame) -> DataFrame:
    """Selector, hash, date and message by unit separators; the index is null without a selector in braces."""
    whole = lines.where(F.size(F.split("value", "\x1f")) >= 4)
    return entries(whole, index=F.regexp_extract("value", r"^[^\x1f]*?\{(\d+)\}", 1).try_cast("int"), hash=field(1, "\x1f"), created_at=field(2, "\x1f"), message=field(3, "\x1f"))


def refs(lines: DataFrame) -> DataFrame:
    return entries(lines, name=field(0))


def shortlog(lines: DataFrame) -> DataFrame:
    """(author, commits) of lines that start with a count."""
    p = r"^\s*(\d+)\s+(.+)$"
    return entries(lines.where(F.col("value").rlike(p)), author=F.trim(F.regexp_extract("value", p, 2)), commits=F.regexp_extract("value", p, 1).try_cast("int"))


def tree_sizes(lines: DataFrame) -> DataFrame:
    """(path, size) of a long tree listing; entries without a size, such as submodules, are dropped."""
    p = r"^[^\t]* (\S+)\t(.*)$"
    sized = lines.where(F.regexp_extract("value", p, 1).try_cast("long").isNotNull())
    return entries(sized, path=F.replace(F.regexp_extract("value", p, 2), F.lit("\\"), F.lit("/")), size=F.regexp_extract("value", p, 1).try_cast("long"))


def remotes(lines: DataFrame) -> DataFrame:
    """(remote, url, protocol, host_kind) of fetch lines; equal entries once."""
    p = r"^\s*(\S+)\s+(\S+)"
    fetch = lines.where(F.contains("value", F.lit("(fetch)")) & F.col("value").rlike(p))
    url = F.regexp_extract("value", p, 2)
    return entries(fetch, remote=F.regexp_extract("value", p, 1), url=url, protocol=protocol(url), host_kind=host_kind(url)).distinct()


def blame(lines: DataFrame) -> DataFrame:
    """(key, line_number, commit_hash, short_hash, author_name, authored_at, content) of porcelain listings.

    A commit's author and time stand at its first entry of a listing and hold for later ones.  Contents
    before any entry are dropped; an unknown author or time is empty.
    """
    p = r"^([0-9a-f]{40}) \d+ (\d+)"
    starts = lambda mark: F.startswith("text", F.lit(mark))
    after = lambda mark: F.substr("text", F.lit(len(mark) + 1))
    kind = F.when(F.col("text").rlike(p), 0).when(starts("author "), 1).when(starts("author-time "), 2).when(starts("\t"), 3)
    value = F.when(F.col("kind") == 1, after("author ")).when(F.col("kind") == 2, after("author-time ")).when(F.col("kind") == 3, after("\t"))
    entry = F.struct(F.unhex(F.regexp_extract("text", p, 1)).alias("commit"), F.regexp_extract("text", p, 2).cast("int").alias("line_number"))
    # Other lines go before anything is sorted, and the first lines of entries once their followers know them.
    told = lines.select("key", "line_no", "text", kind.alias("kind")).where("kind is not null").select("key", "line_no", "kind", value.alias("value"), F.when(F.col("kind") == 0, entry).alias("entry"))
    of = F.last("entry", True).over(Window.partitionBy("key").orderBy("line_no"))
    seen = told.select("key", "line_no", "kind", "value", of.alias("entry")).where("kind > 0 and entry is not null").select("key", "line_no", "kind", "value", "entry.*")
    commit = Window.partitionBy("key", "commit").orderBy("line_no")
    known = lambda k: F.coalesce(F.last(F.when(F.col("kind") == k, F.col("value")), True).over(commit), F.lit(""))
    rows = seen.select("key", "line_number", "commit", "kind", "value", known(1).alias("author_name"), known(2).alias("authored_at")).where("kind = 3")
    commit_hash = F.lower(F.hex("commit"))
    return rows.select("key", "line_number", commit_hash.alias("commit_hash"), F.left(commit_hash, F.lit(8)).alias("short_hash"), "author_name", "authored_at", F.col("value").alias("content"))


def worktrees(lines: DataFrame) -> DataFrame:
    """(key, path, head, branch, is_main, is_detached, is_locked): entries end at an empty line; the first is the main one."""
    file = Window.partitionBy("key").orderBy("line_no")
    blocks = lines.select("key", "line_no", "text").withColumn("block", F.count_if(F.col("text") == "").over(file))
    after = lambda mark: F.max_by(F.trim(F.substr("text", F.lit(len(mark) + 1))), F.when(F.startswith("text", F.lit(mark)), F.col("line_no")))
    found = blocks.groupBy("key", "block").agg(
        after("worktree ").alias("path"),
        F.coalesce(after("HEAD "), F.lit("")).alias("head"),
        F.regexp_replace(after("branch "), "^refs/heads/", "").alias("branch"),
        F.coalesce(F.bool_or(F.col("text") == "detached"), F.lit(False)).alias("is_detached"),
        F.coalesce(F.bool_or(F.startswith("text", F.lit("locked"))), F.lit(False)).alias("is_locked"),
    )
    first = F.row_number().over(Window.partitionBy("key").orderBy("block")) == 1
    return found.where("path is not null").select("key", "path", "head", "branch", first.alias("is_main"), "is_detached", "is_locked")
