"""Pull requests and issues of code forges, from their JSON, as rows of one shape.

Each reader takes rows with ``value``, one JSON object each (JSON lines, or the exploded array of a page),
and keeps the other columns.  Malformed objects and those without a number are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON = ("number", "title", "head", "base", "state", "draft", "author", "comments", "updated_at", "labels")

#: What each forge sends, as far as it is read.  Fixed formats.
GITHUB = "number long, title string, headRefName string, baseRefName string, state string, isDraft boolean, author struct<login string>, comments array<struct<id string>>, updatedAt string, labels array<struct<name string>>"
GITLAB = "iid long, title string, source_branch string, target_branch string, state string, draft boolean, author struct<username string>, user_notes_count long, updated_at string, labels array<string>"
GITEA = "number long, title string, head struct<ref string>, base struct<ref string>, state string, draft boolean, merged boolean, user struct<login string>, comments long, updated_at string, labels array<struct<name string>>"
BITBUCKET = "id long, title string, source struct<branch struct<name string>>, destination struct<branch struct<name string>>, state string, draft boolean, author struct<nickname string>, comment_count long, updated_on string"


def _rows(rows: DataFrame, schema: str, forge: str, **columns: str | Column) -> DataFrame:
    """State is OPEN, CLOSED or MERGED; text is trimmed and empty if missing, counts are 0, labels an empty list."""
    found = rows.withColumn("j", F.from_json("value", schema))
    col = {k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()}
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    state = F.upper(F.coalesce(col["state"], F.lit("open")))
    kept = [c for c in rows.columns if c not in ("value", "forge", *COMMON)]
    return found.where(col["number"].isNotNull()).select(
        *kept,
        F.lit(forge).alias("forge"),
        col["number"].alias("number"),
        *(text(col[c]).alias(c) for c in ("title", "head", "base")),
        F.when(state == "OPENED", "OPEN").when(state.isin("DECLINED", "SUPERSEDED"), "CLOSED").otherwise(state).alias("state"),
        F.coalesce(col["draft"], F.lit(False)).alias("draft"),
        text(col["author"]).alias("author"),
        F.coalesce(col["comments"].cast("long"), F.lit(0)).alias("comments"),
        F.try_to_timestamp(col["updated_at"]).alias("updated_at"),
        F.coalesce(F.filter(col["labels"], lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("labels"),
    )


def github(rows: DataFrame) -> DataFrame:
    return _rows(rows, GITHUB, "github", number="j.number", title="j.title", head="j.headRefName", base="j.baseRefName", state="j.state", draft="j.isDraft", author="j.author.login", comments=F.nullif(F.size("j.comments"), F.lit(-1)), updated_at="j.updatedAt", labels="j.labels.name")


def gitlab(rows: DataFrame) -> DataFrame:
    return _rows(rows, GITLAB, "gitlab", number="j.iid", title="j.title", head="j.source_branch", base="j.target_branch", state="j.state", draft="j.draft", author="j.author.username", comments="j.user_notes_count", updated_at="j.updated_at", labels="j.labels")


def gitea(rows: DataFrame) -> DataFrame:
    return _rows(rows, GITEA, "gitea", number="j.number", title="j.title", head="j.head.ref", base="j.base.ref", state="if(j.merged, 'merged', j.state)", draft="j.draft", author="j.user.login", comments="j.comments", updated_at="j.updated_at", labels="j.labels.name")


def bitbucket(rows: DataFrame) -> DataFrame:
    return _rows(rows, BITBUCKET, "bitbucket", number="j.id", title="j.title", head="j.source.branch.name", base="j.destination.branch.name", state="j.state", draft="j.draft", author="j.author.nickname", comments="j.comment_count", updated_at="j.updated_on", labels="cast(null as array<string>)")


def all_requests(*sources: DataFrame) -> DataFrame:
    """Rows of several forges together; columns that a source lacks are null."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
