"""Operator 6, secret scans: multipart credential linking.

Base kinds, leftmost and non-overlapping each, are always reported:

    assign  a password-like name, = or :, and a value of 8 or more characters
    access  AKIA and capitals or digits, 16 or more characters in all
    hex     32 or more lower-case hexadecimal digits

Weak kinds say little on their own and are reported only when complementary parts stand near:

    secret      20 or more base64 or base64url characters with capitals, lower case and digits,
                outside base spans, behind = or :, or with digits in two places or more
    identifier  a user, login, client, account or host name and its value; db_user counts
    endpoint    a URL's scheme and host, or an IPv4 address, with an optional port

A weak secret is reported if an access key, identifier or endpoint starts within ``reach``
characters of its own start; an identifier or endpoint if a weak secret, an assign value or hex
digits do.
This is an interval join: starts are cut into bins of ``reach`` characters; per document and bin
only the least and the greatest start of a side are kept, which is enough to decide whether
any start of that side lies in reach, so the join never makes pairs within a group.

Only DataFrame and SQL functions run.  Positions are code points, ends exclusive.  Matches and
the gaps between them (split by the same pattern) give the positions.

Defined results: null and empty texts have no spans.  A text of any length is one row; work grows
in proportion to its length and its matches.  Repeated rows come back each; documents are
told apart by (doc_id, hash of text), rows equal in both have equal spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .positions import positions

#: The base patterns.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: A value told by what stands before it, or by digits in two places or more, as a long word of a text rarely has.
SECRET = (
    r"""(?<![A-Za-z0-9+/_.-])(?:(?<=[:=])|(?<=[:=]["'])|(?<=[:=]\x20)|(?<=[:=]\x20["'])|(?=(?:[A-Za-z+/_-]*+[0-9]++){2}))"""
    r"(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
)
#: The name may be the last part of a longer one, as in DB_USER or aws_account_id.
IDENTIFIER = r"""(?<![A-Za-z0-9])(?i:user|user_?name|login|client_?id|account|account_?id|account_?name|host|host_?name|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
ENDPOINT = r"(?:\b[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.]))"

KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")


def spans(text: str, pattern: str, least: int | None = None) -> Column:
    """array<struct<s, e>> of the matches in column ``text``; with ``least`` only those whose
    first group has so many characters.  Texts without a match are only searched once."""
    t, p = F.col(text), F.lit(pattern)
    lengths = F.transform(F.regexp_extract_all(t, p, F.lit(0)), lambda m: F.length(m))
    values = F.transform(F.regexp_extract_all(t, p, F.lit(1)), lambda m: F.length(m)) if least else lengths
    gaps = F.transform(F.split(t, pattern, -1), lambda g: F.length(g))
    kept = F.filter(positions(gaps, lengths, values), lambda x: x["v"] >= (least or 0))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return F.when(t.rlike(pattern), F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).otherwise(none)


def _joined(array: Column) -> Column:
    """kind:start:end by start, then kind, with commas between."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(array), lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def _tagged(column: str, k: int) -> Column:
    return F.transform(column, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, h, and an array of spans for each kind); one pass over the texts."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).select(
        "doc_id", "t", F.xxhash64("t").alias("h"),
        spans("t", ASSIGN, 8).alias("assign"), spans("t", ACCESS).alias("access"), spans("t", HEX).alias("hex"),
        spans("t", SECRET).alias("secret"), spans("t", IDENTIFIER).alias("identifier"), spans("t", ENDPOINT).alias("endpoint"),
    )
    return base.drop("t")


def _apart(parts: DataFrame) -> DataFrame:
    """``parts`` without weak secrets that overlap a base span, by running bounds over a document."""
    base = F.col("k") < 3
    before = Window.partitionBy("doc_id", "h").orderBy("s")
    after = Window.partitionBy("doc_id", "h").orderBy(F.desc("s"))
    bounded = parts.withColumn("reached", F.max(F.when(base, F.col("e"))).over(before)).withColumn("next", F.min(F.when(base, F.col("s"))).over(after))
    overlaps = (F.coalesce("reached", F.lit(0)) > F.col("s")) | F.coalesce(F.col("next") < F.col("e"), F.lit(False))
    return bounded.where(~((F.col("k") == 3) & overlaps)).drop("reached", "next")


def linked(scanned: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, h, weak): the weak spans with a complementary part within ``reach``."""
    side = F.when(F.col("k").isin(0, 2, 3), 0).otherwise(1)  # values on one side, names and places on the other
    each = F.concat(*(_tagged(name, k) for k, name in enumerate(KINDS)))
    parts = scanned.where(F.size("secret") + F.size("identifier") + F.size("endpoint") > 0).select("doc_id", "h", F.explode(each).alias("x")).select("doc_id", "h", "x.*").distinct()
    parts = _apart(parts).withColumn("side", side).withColumn("bin", F.floor(F.col("s") / reach))
    bounds = (
        parts.groupBy("doc_id", "h", "side", "bin").agg(F.min("s").alias("low"), F.max("s").alias("high"))
        .withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
        .withColumnsRenamed({"doc_id": "d2", "h": "h2", "side": "side2", "bin": "bin2"})
    )
    # Of a neighbouring bin the nearest start is its least or greatest; of the own bin any is in reach.
    near = (F.col("low").between(F.col("s") - reach, F.col("s") + reach)) | (F.col("high").between(F.col("s") - reach, F.col("s") + reach))
    weak = parts.where("k >= 3").join(
        bounds,
        F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("bin") == F.col("bin2")) & (F.col("side") != F.col("side2")) & near,
        "left_semi",
    )
    return weak.groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "k", "e")).alias("weak"))


def report(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    scanned = written(scan(docs), "spans")
    weak = linked(scanned, reach).withColumnsRenamed({"doc_id": "d2", "h": "h2"})
    base = F.concat(*(_tagged(name, k) for k, name in enumerate(KINDS[:3])))
    return scanned.join(weak, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select(
        "doc_id",
        *(F.size(name).cast("long").alias(f"n_{name}") for name in KINDS[:3]),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, F.coalesce("weak", F.array().cast("array<struct<s:int,k:int,e:int>>")))).alias("spans"),
    )
