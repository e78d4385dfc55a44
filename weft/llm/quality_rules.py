"""Operator 10, quality rules: a short-circuit cascade ordered by rejection per cost.

Each rule is a SQL predicate that is true for a document to reject.  A bounded sample gives
every rule's share of rejections and its time per row; the cascade tries the rules in descending
order of rejection per cost and stops at the first that rejects (``CASE`` evaluates lazily).
The verdict is the conjunction of all rules, so it does not depend on the order found.

Defined results: a null text has no words; an empty text likewise; both fail the base rule on
the number of words.  Repeated rows and null ids are judged row by row.  Columns other than the
ones named here are not touched.  Everything is row-local: no shuffle, no Python on executors.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``reject``: SQL over the text column ``t``, its word array ``w`` and the base columns."""

    name: str
    reject: str


#: Thresholds keep ordinary prose; they follow published web-text heuristics.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("capitals", "length(regexp_replace(t, '[^A-Z]+', '')) * 10 > word_chars * 3"),
    Rule("duplicate_lines", "n_dup_lines * 100 > 35 * n_lines"),
    Rule("no_letters", r"regexp_count(t, '(?<!\\S)[^\\p{L}\\s]+(?!\\S)') * 10 > n_words * 3"),
    Rule("digits", "length(regexp_replace(t, '[^0-9]+', '')) * 2 > word_chars"),
    Rule("ellipses", r"size(filter(split(t, '\n'), x -> x rlike '(\\.\\.\\.|…)[ \t\r]*$')) * 10 > n_lines * 3"),
)


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


#: 64-bit hashes of the 5-word windows, from hashes of the words.  ``transform(array(x), ..)``
#: binds x once, so that no lambda evaluates it again for each element.
WINDOWS = """
case when size(w) < 6 then array(0L) else
  transform(array(transform(w, x -> xxhash64(x))), v ->
    transform(sequence(0, size(w) - 5), i -> xxhash64(get(v, i), get(v, i + 1), get(v, i + 2), get(v, i + 3), get(v, i + 4))))[0]
end
"""

#: Words inside 5-word windows that occur twice or more in the text.  Windows are compared by
#: hash within one text, and most texts repeat none.  Else sorted (hash, start) pairs put equal
#: windows side by side, and each start covers five words less its overlap with the next.
REPEATS = """
case when size(array_distinct(h)) = size(h) then 0L else
  transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as p)))), s ->
    aggregate(
      transform(array(sort_array(transform(
        filter(s, (x, k) -> get(s, k - 1).h <=> x.h or get(s, k + 1).h <=> x.h), x -> x.p))), p ->
          transform(p, (x, k) -> least(5, coalesce(get(p, k + 1), x + 5) - x)))[0],
      0L, (a, x) -> a + x))[0]
end
"""


def with_base(docs: DataFrame) -> DataFrame:
    """(doc_id, t, w) and the base columns for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    return (
        docs.select("doc_id", text.alias("t"))
        .withColumn("w", word_array(F.col("t")))
        .withColumn("l", lines)
        .withColumn("h", F.expr(WINDOWS))
        .select(
            "doc_id", "t", "w",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("l").cast("long").alias("n_lines"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            F.expr(REPEATS).cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    )


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = 400, rounds: int = 3, repeat: int = 20) -> list[Rule]:
    """Rules by descending rejection per second over about ``sample_rows`` rows from the whole table.

    A rule's cost is the least time of ``rounds`` runs over the cached sample, each row ``repeat``
    times, less that of a rule that is always false; so what a job costs by itself falls out, and a
    first run that compiles does not count.  The sample is only for the order: a wrong estimate costs
    time, never a verdict.
    """
    texts = docs.select("doc_id", "text")
    share = min(1.0, sample_rows / max(1, docs.count()))
    rows = (texts if share == 1.0 else texts.sample(share, seed=1)).limit(2 * sample_rows).collect()  # bounded, whatever the table
    sample = with_base(docs.sparkSession.createDataFrame(rows, texts.schema).coalesce(1)).cache()
    try:
        n, again = max(1, sample.count()), sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("again"))

        def timed(reject: str) -> tuple[float, int]:
            least, hits = float("inf"), 0
            for _ in range(rounds):
                began = time.perf_counter()
                # The added column keeps the predicate from being evaluated once for all repeats.
                (hits,) = again.agg(F.count_if(F.expr(f"again > 0 and ({reject})"))).first()
                least = min(least, time.perf_counter() - began)
            return least, hits / repeat

        idle, _ = timed("n_words < -again")
        rated = []
        for rule in rules:
            seconds, rejected = timed(rule.reject)
            rated.append(((rejected + 1) / (n + 2) / max(1e-3, seconds - idle), rule))
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(rated, key=lambda x: -x[0])]


def cascade(rules: list[Rule]) -> Column:
    """True for a row that no rule rejects; later rules are evaluated only if needed."""
    return F.expr("case " + " ".join(f"when {r.reject} then false" for r in rules) + " else true end")


def judge(docs: DataFrame, rules=RULES, sample_rows: int = 400) -> DataFrame:
    """One row per document: base columns, ``base_failed`` and the verdict ``kept``."""
    ordered = order_rules(docs, rules, sample_rows)
    return with_base(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(cascade(ordered)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules=RULES, sample_rows: int = 400) -> DataFrame:
    """The rows of ``docs``, unchanged, that pass the base rule and the cascade."""
    ordered = order_rules(docs, rules, sample_rows)
    inner = with_base(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    verdict = F.when(F.col("base_failed"), False).otherwise(cascade(ordered))
    # A generator of no row or one in place of a filter: a filter would be pushed below the base
    # columns and evaluate them all a second time.
    one = F.when(verdict, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return inner.select("doc_id", F.explode(one).alias("good")).select(F.col("doc_id.*"))


ORACLE_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1), range(5) AS o(k) GROUP BY rid),
b AS (SELECT w.rid, doc_id, t, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      NOT (n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
        OR length(regexp_replace(t, '[^A-Z]+', '', 'g')) * 10 > word_chars * 3
        OR n_dup_lines * 100 > 35 * n_lines
        OR len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) * 10 > n_words * 3
        OR length(regexp_replace(t, '[^0-9]+', '', 'g')) * 2 > word_chars
        OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) * 10 > n_lines * 3) AS verdict FROM b)
"""
ORACLE = ORACLE_BASE.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND verdict) AS kept FROM v
"""
