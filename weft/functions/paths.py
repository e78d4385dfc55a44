"""Column functions over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def directories(path: Column) -> Column:
    """The segments of a path without its last one."""
    parts = segments(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def stem(path: Column) -> Column:
    """The last segment without its rightmost extension; a leading dot is no extension."""
    return F.regexp_replace(F.element_at(segments(path), -1), r"(?<=.)\.[^.]*$", "")


def shared_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their start."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(F.array_append(equal, F.lit(False)), False) - 1


def path_affinity(a: Column, b: Column) -> Column:
    """Share of common leading directories times the Dice coefficient of the common start of the stems.

    1 for equal paths, 0 where either part has nothing in common, null for a null path.
    """
    da, db, sa, sb = directories(a), directories(b), stem(a), stem(b)
    characters = [F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)) for s in (sa, sb)]
    deepest, letters = F.greatest(F.size(da), F.size(db)), F.length(sa) + F.length(sb)
    level = F.when(deepest > 0, shared_prefix(da, db) / deepest).otherwise(0.0)
    name = F.when(letters > 0, 2.0 * shared_prefix(*characters) / letters).otherwise(0.0)
    return F.when(a == b, 1.0).when(a.isNotNull() & b.isNotNull(), level * name)


#: Parts of lower-case paths, and their ends, by kind.  Fixed values.
KINDS = {
    "generated": (("/generated/", "/gen/"), (".g.dart", ".pb.dart", ".gr.dart", ".designer.cs", ".generated.ts", ".generated.js", ".min.js")),
    "vendor": (("/vendor/", "/third_party/", "/node_modules/"), ()),
    "doc": (("/docs/", "/doc/"), ("/readme.md", "/readme.mdx", ".md", ".mdx", ".rst")),
    "manifest": ((), ("package.json", "pubspec.yaml", "pubspec.yml", "cargo.toml", "package.swift", "requirements.txt", "pyproject.toml")),
    "lockfile": ((), ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "pubspec.lock", "poetry.lock", "composer.lock", "gemfile.lock", ".lock")),
    "output": (("/build/", "/dist/", "/coverage/", "/.dart_tool/", "/target/"), ()),
}
RITUAL = ("generated", "vendor", "lockfile", "output")


def path_kind(path: Column, *kinds: str) -> Column:
    """Whether a path is of one of the kinds, without regard to case; null for null."""
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    inner, ends = (sum((KINDS[k][i] for k in kinds), ()) for i in (0, 1))
    quoted = [rf"\Q{x}\E" for x in inner] + [rf"\Q{x}\E\z" for x in ends]
    return lower.rlike("|".join(quoted))


def ritual_path(path: Column) -> Column:
    """Generated, vendored, lock or build output."""
    return path_kind(path, *RITUAL)


def cited_paths(text: Column) -> Column:
    """Distinct paths in free text: ``path="..."`` or ``file="..."``, and bare ones with a slash and an extension."""
    named = F.transform(F.regexp_extract_all(text, F.lit(r'(?:path|file)\s*=\s*"([^"]+)"'), F.lit(1)), lambda x: F.trim(x))
    bare = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_\-./]+/[A-Za-z0-9_\-./]+\.[A-Za-z0-9]{1,8}"), F.lit(0))
    return F.array_distinct(F.concat(named, F.filter(bare, lambda x: ~(F.startswith(x, F.lit("http")) | F.startswith(x, F.lit("www."))))))
