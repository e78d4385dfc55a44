"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as st
from ..operators import text as x
from .registry import query

TOKENS = """
WITH d AS (SELECT doc_id AS doc, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS ts FROM documents),
tok AS (SELECT doc, unnest(ts) AS token FROM d), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
fr AS (SELECT token, df, ln(1 + n / (1 + df)) AS idf FROM (SELECT token, count(*) AS df FROM tok GROUP BY 1), n)
"""


def tokens(t):
    return x.token_rows(t("documents"), "doc_id", st.path_tokens(F.col("text"), 4))


def frequency(t):
    return x.document_frequency(tokens(t), t("documents").count())


@query(TOKENS + "SELECT token, df, round(idf, 6) AS idf FROM fr")
def token_frequency(t):
    return frequency(t)


@query(TOKENS + "SELECT doc, round(sum(1 / (1 + df / n)), 6) AS score FROM tok JOIN fr USING (token), n WHERE token IN ('tion', 'theaea', 'ingre', 'auch') GROUP BY 1 ORDER BY round(sum(1 / (1 + df / n)), 9) DESC, 1 LIMIT 20")
def keyword_search(t):
    """The twenty best documents for four words (a top-k report)."""
    return x.search(tokens(t), ["tion", "theaea", "ingre", "auch"], t("documents").count())


CLASSES = TOKENS + """, c AS (SELECT doc, min(doc) OVER (PARTITION BY s) AS cls FROM (SELECT doc, list_sort(ts) AS s FROM d WHERE len(ts) > 0))"""


@query(CLASSES + "SELECT doc, cls FROM c")
def token_classes(t):
    """Documents of equal token sets."""
    return x.token_classes(tokens(t))


@query(CLASSES + """, u AS (SELECT tok.doc, token, idf FROM tok JOIN c ON c.doc = tok.doc AND c.cls = c.doc JOIN fr USING (token)), w AS (SELECT doc, sum(idf) AS w FROM u GROUP BY 1),
i AS (SELECT p.doc AS a, q.doc AS b, sum(p.idf) AS i FROM u p JOIN u q ON p.token = q.token AND p.doc < q.doc GROUP BY 1, 2)
SELECT a, b, round(i / (x.w + y.w - i), 6) AS score FROM i JOIN w x ON x.doc = a JOIN w y ON y.doc = b WHERE i / (x.w + y.w - i) >= 0.2""")
def idf_jaccard(t):
    """Pairs of token sets with an idf-weighted Jaccard of 0.2 or more."""
    return x.idf_jaccard(tokens(t), frequency(t), 0.2)


@query(TOKENS + """, h AS (SELECT df, ln(df) AS t, ln(sum(count(*)) OVER (ORDER BY df DESC)) AS y FROM fr GROUP BY 1),
e AS (SELECT min(t) AS a, max(t) AS b, arg_min(y, t) AS p, arg_max(y, t) AS q FROM h),
k AS (SELECT arg_min(df, (-abs((q - p) * (t - a) - (b - a) * (y - p)), t)) AS cut FROM h, e)
SELECT token, df FROM fr, k WHERE df > cut""")
def stop_tokens(t):
    return x.stop_tokens(frequency(t))


@query(TOKENS + "SELECT token, any_value(df) AS df, (doc // 1000)::BIGINT AS part, array_to_string(list_sort(list(doc)), ',') AS docs FROM tok JOIN fr USING (token) GROUP BY token, doc // 1000")
def inverted_index(t):
    out = x.inverted_index(tokens(t))
    return out.withColumn("docs", F.array_join(F.col("docs").cast("array<string>"), ","))


@query(TOKENS + """, c AS (SELECT source AS bucket, token, count(*) AS c FROM tok JOIN documents ON doc_id = doc GROUP BY 1, 2 HAVING count(*) >= 3),
b AS (SELECT source AS bucket, count(*) AS nb FROM documents GROUP BY 1),
s AS (SELECT bucket, token, ln((c / n) / (nb / n) / (df / n)) / -ln(c / n) AS npmi FROM c JOIN b USING (bucket) JOIN fr USING (token), n WHERE c < n)
SELECT bucket, token, round(npmi, 6) AS npmi, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY round(npmi, 9) DESC, token)::INT AS rank FROM s) WHERE rank <= 3""")
def source_labels(t):
    return x.npmi_labels(tokens(t), t("documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("bucket")))


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), k AS (SELECT p_partkey, ch, count(*) / sum(count(*)) OVER (PARTITION BY p_partkey) AS p FROM c GROUP BY 1, 2)
SELECT p_partkey, round(CASE WHEN count(*) < 2 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS entropy FROM k GROUP BY 1""")
def name_entropy(t):
    return t("part").select("p_partkey", x.char_entropy(F.col("p_name")).alias("entropy"))


@query("SELECT doc_id AS doc, k::INT AS chunk, (k * 1000)::INT AS start, substring(text, k * 1000 + 1, 1000) AS content FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, ceil(length(text) / 1000.0))::BIGINT)) AS k)")
def text_chunks(t):
    return x.text_chunks(t("documents"), "doc_id", "text", 1000)


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^([a-z]+)://', 1) AS protocol,
list_aggregate(list_distinct(list_filter(string_split_regex(lower(url), '[^a-z0-9]+'), lambda x: length(x) >= 2)), 'count')::INT AS n_tokens,
CASE WHEN regexp_matches(url, '[?]') THEN true ELSE false END AS has_query FROM pages""")
def url_parts(t):
    return t("pages").select("page_id", F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)), r"^www\.", "").alias("host"), st.protocol(F.col("url")).alias("protocol"), F.size(st.path_tokens(F.col("url"))).alias("n_tokens"), F.col("url").contains("?").alias("has_query"))


@query("""SELECT p_partkey, regexp_replace(substring(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 16), '-$', '') AS slug FROM part""")
def part_slugs(t):
    return t("part").select("p_partkey", st.slug(F.concat_ws(" ", "p_name", "p_type"), 16).alias("slug"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[0-9]+.*$', '') || lpad(regexp_replace(regexp_extract(c_name, '[0-9]+', 0), '^0+(.)', '\\1'), 12, '0') AS key FROM customer WHERE regexp_matches(c_name, '^[^0-9]+[0-9]+$')")
def natural_keys(t):
    return t("customer").where(F.col("c_name").rlike("^[^0-9]+[0-9]+$")).select("c_custkey", st.natural_key(F.col("c_name")).alias("key"))


@query("""WITH l AS (SELECT doc_id AS doc, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
r AS (SELECT doc, content, min(line) AS first, count(*) AS n FROM l WHERE length(content) >= 20 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc, first::INT AS first_line, n FROM r""")
def repeated_lines(t):
    """Lines of twenty characters or more that a document repeats."""
    lines = x.line_rows(t("documents"), "doc_id", "text").where(F.length("content") >= 20)
    return lines.groupBy("doc", "content").agg(F.min("line").alias("first_line"), F.count("*").alias("n")).where("n > 1").select("doc", "first_line", "n")


@query("""WITH l AS (SELECT doc_id AS doc, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
r AS (SELECT doc, content, any_value(line) AS i FROM l WHERE doc % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1), a AS (SELECT doc - 1 AS doc, content, any_value(line) AS j FROM l WHERE doc % 2 = 1 GROUP BY 1, 2 HAVING count(*) = 1),
m AS (SELECT doc, i, j - i AS shift, j, i - row_number() OVER (PARTITION BY doc, j - i ORDER BY i) AS run FROM r JOIN a USING (doc, content))
SELECT doc, min(i)::INT AS from_line, min(j)::INT AS to_line, count(*) AS length FROM m GROUP BY doc, shift, run""")
def line_moves(t):
    """Blocks of lines that each even document shares with the next one, with their shift."""
    lines = x.line_rows(t("documents"), "doc_id", "text").select("doc", "line", F.col("content").alias("hash"))
    return x.moves(lines.where("doc % 2 = 0"), lines.where("doc % 2 = 1").withColumn("doc", F.col("doc") - 1))


@query("SELECT doc_id, bit_count(xor(hash_a, hash_b))::INT AS d FROM (SELECT doc_id, doc_id * 7919 AS hash_a, doc_id * 104729 AS hash_b FROM documents)")
def bit_distance(t):
    return t("documents").select("doc_id", st.hamming(F.col("doc_id") * 7919, F.col("doc_id") * 104729).alias("d"))
