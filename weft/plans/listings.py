"""Listings, forge records, paths, contents and diffs, written as text from the standard tables and read back.

The SQL never parses: it states what the text was made from.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contents, paths
from ..operators import coupling
from ..operators import diffs as d
from ..sources import forges, listings
from .registry import query

HASH = "md5(l_orderkey::VARCHAR) || left(md5(l_orderkey::VARCHAR), 8)"


def text(*parts: str) -> F.Column:
    return F.expr("concat(" + ", ".join(parts) + ")").alias("value")


def blocks(rows, key: str, order: list[str], *lines: str):
    """(key, line_no, text): the lines of each row in turn; null lines are left out."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) * 100
    numbered = rows.withColumn("at", n).select(F.col(key).alias("key"), "at", F.posexplode(F.array(*map(F.expr, lines))).alias("pos", "text"))
    return numbered.where("text is not null").select("key", (F.col("at") + F.col("pos")).alias("line_no"), "text")


@query("""SELECT 'work ' || o_orderkey AS name, o_orderkey % 7 = 0 AS current, CASE WHEN o_orderkey % 3 > 0 THEN 'origin/' || o_custkey END AS upstream,
 CASE WHEN o_orderkey % 3 = 1 THEN o_custkey ELSE 0 END::INT AS ahead, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey ELSE 0 END::INT AS behind, o_orderkey % 3 = 2 AS gone, epoch(o_orderdate)::BIGINT AS committed FROM orders""")
def branch_listing(t):
    track = "case o_orderkey % 3 when 1 then concat('[ahead ', o_custkey, ', behind ', o_orderkey, ']') when 2 then '[gone]' else '' end"
    lines = t("orders").select(text("'work '", "o_orderkey", "'\t'", "if(o_orderkey % 7 = 0, '*', ' ')", "'\t'", "if(o_orderkey % 3 > 0, concat('origin/', o_custkey), '')", "'\t'", track, "'\t'", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')", "' +0000'"))
    return listings.branches(lines).withColumn("last_commit_at", F.unix_timestamp("last_commit_at")).withColumnRenamed("last_commit_at", "committed")


@query("""SELECT 'v' || l_orderkey || '.' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'tag' ELSE 'commit' END AS tag_type, CASE WHEN l_linenumber % 2 = 0 THEN left(md5(l_partkey::VARCHAR), 8) END AS target_hash,
 strftime(l_shipdate, '%Y-%m-%d') AS created_at, CASE WHEN l_linenumber % 2 = 0 THEN 'S ' || l_suppkey END AS creator_name, l_linestatus AS subject FROM lineitem""")
def tag_listing(t):
    even = "l_linenumber % 2 = 0"
    lines = t("lineitem").select(text("'v'", "l_orderkey", "'.'", "l_linenumber", "'\t'", f"if({even}, 'tag', 'commit')", "'\t'", f"if({even}, md5(cast(l_partkey as string)), '')", "'\t'", "date_format(l_shipdate, 'yyyy-MM-dd')", "'\t'", f"if({even}, concat('S ', l_suppkey), '')", "'\t '", "l_linestatus"))
    return listings.tags(lines)


@query("""SELECT md5(event_id::VARCHAR) AS commit_hash, left(md5(event_id::VARCHAR), 7) AS short_hash, 'HEAD@{' || event_id || '}' AS ref_selector, event_type || ': step' AS action_summary,
 'u' || user_id AS author_name, strftime(ts, '%Y-%m-%d') AS authored_at FROM events WHERE event_id % 10 > 0""")
def reflog_listing(t):
    """One line of ten lacks its last two fields."""
    h = "md5(cast(event_id as string))"
    lines = t("events").select(text(h, "'\t'", f"left({h}, 7)", "'\tHEAD@{'", "event_id", "'}\t'", "event_type", "': step'", "if(event_id % 10 > 0, concat('\tu', user_id, '\t', date_format(ts, 'yyyy-MM-dd')), '')"))
    return listings.reflog(lines)


@query("SELECT CASE WHEN event_id % 5 > 0 THEN event_id ELSE -1 END::INT AS \"index\", md5(event_id::VARCHAR) AS hash, strftime(ts, '%Y-%m-%d') AS created_at, 'On {9}: ' || event_type AS message FROM events")
def stash_listing(t):
    lines = t("events").select(text("if(event_id % 5 > 0, concat('stash@{', event_id, '}'), 'stash')", "'\x1f'", "md5(cast(event_id as string))", "'\x1f'", "date_format(ts, 'yyyy-MM-dd')", "'\x1fOn {9}: '", "event_type"))
    return listings.stashes(lines).fillna(-1, ["index"])


@query("SELECT 'refs/tags/' || p_name AS name, count(*) AS n FROM part GROUP BY 1")
def ref_names(t):
    lines = t("part").select(text("'refs/tags/'", "p_name", "'\t'", "p_partkey"))
    return listings.refs(lines).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment || ' ' || c_name AS author, c_custkey::INT AS commits FROM customer")
def shortlog_counts(t):
    return listings.shortlog(t("customer").select(text("'   '", "c_custkey", "'\t'", "c_mktsegment", "' '", "c_name", "' '")))


@query("SELECT p_brand || '/' || p_name AS path, sum(p_size)::BIGINT AS bytes, count(*) AS files FROM part WHERE p_partkey % 9 > 0 GROUP BY 1")
def tree_bytes(t):
    """Every ninth entry is a submodule without a size."""
    lines = t("part").select(text("'100644 blob '", "md5(p_name)", "'  '", "if(p_partkey % 9 > 0, cast(p_size as string), '-')", "'\t'", "p_brand", "'\\\\'", "p_name"))
    return listings.tree_sizes(lines).groupBy("path").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query("""SELECT DISTINCT 'r' || s_nationkey AS remote, CASE WHEN s_nationkey % 2 = 0 THEN 'https://github.com/n/' ELSE 'git@gitlab.com:n/' END || s_nationkey AS url,
 CASE WHEN s_nationkey % 2 = 0 THEN 'https' ELSE 'ssh' END AS protocol, CASE WHEN s_nationkey % 2 = 0 THEN 'github' ELSE 'gitlab' END AS host_kind FROM supplier""")
def remote_listing(t):
    """A fetch and a push line for each supplier, many of one nation."""
    both = t("supplier").select("s_nationkey", F.explode(F.array(F.lit("fetch"), F.lit("push"))).alias("way"))
    return listings.remotes(both.select(text("'r'", "s_nationkey", "'\t'", "if(s_nationkey % 2 = 0, 'https://github.com/n/', 'git@gitlab.com:n/')", "s_nationkey", "' ('", "way", "')'")))


@query(f"""SELECT l_suppkey AS key, l_linenumber AS line_number, {HASH} AS commit_hash, left(md5(l_orderkey::VARCHAR), 8) AS short_hash, 'A ' || l_orderkey AS author_name, l_orderkey::VARCHAR AS authored_at,
 l_linestatus || l_partkey AS content FROM lineitem""")
def blame_lines(t):
    """Suppliers stand for files, orders for commits, whose author is told once a file."""
    own = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")  # that of the blocks: one sort
    lineitem = t("lineitem")
    dealt = coupling.dealt(lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"), coupling.partitions(lineitem), "l_suppkey")
    rows = dealt.withColumn("again", F.coalesce(F.lag("l_orderkey").over(own) == F.col("l_orderkey"), F.lit(False)))
    h = "concat(md5(cast(l_orderkey as string)), left(md5(cast(l_orderkey as string)), 8)"
    lines = blocks(
        rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"],
        f"{h}, ' 1 ', l_linenumber)", "if(again, null, concat('author A ', l_orderkey))", "if(again, null, concat('author-time ', l_orderkey))", "if(again, null, 'summary author B')", "concat('\t', l_linestatus, l_partkey)",
    )
    return listings.blame(lines)


@query("""SELECT o_custkey AS key, '/w/' || o_orderkey AS path, md5(o_orderpriority) AS head, CASE WHEN o_orderstatus <> 'P' THEN 'b' || o_orderkey END AS branch,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS is_main, o_orderstatus = 'P' AS is_detached, o_orderkey % 4 = 0 AS is_locked FROM orders""")
def worktree_listing(t):
    lines = blocks(
        t("orders"), "o_custkey", ["o_orderkey"],
        "concat('worktree /w/', o_orderkey)", "concat('HEAD ', md5(o_orderpriority))", "if(o_orderstatus = 'P', 'detached', concat('branch refs/heads/b', o_orderkey))", "if(o_orderkey % 4 = 0, 'locked by hand', null)", "''",
    )
    return listings.worktrees(lines)


@query("""SELECT ['github', 'gitlab', 'gitea', 'bitbucket'][o_orderkey % 4 + 1] AS forge, o_orderkey AS number, 'T ' || o_orderpriority AS title, 'h' || o_custkey AS head, 'main' AS base,
 CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'MERGED' END AS state, o_orderkey % 3 = 0 AND o_orderkey % 4 < 3 AS draft, 'u' || o_custkey AS author,
 CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE o_custkey END AS comments, epoch(o_orderdate)::BIGINT AS updated, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE o_orderpriority END AS labels FROM orders""")
def pull_requests(t):
    """Orders as the pull requests of four forges, by the rest of their key."""
    o = t("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    state = lambda opened, closed: f"case o_orderstatus when 'O' then '{opened}' when 'F' then '{closed}' else 'merged' end"
    title, head, author, draft = "concat(' T ', o_orderpriority)", "concat('h', o_custkey)", "concat('u', o_custkey)", "o_orderkey % 3 = 0"
    names = "array(named_struct('name', o_orderpriority))"
    wire = [
        (forges.github, f"'number', o_orderkey, 'title', {title}, 'headRefName', {head}, 'baseRefName', 'main', 'state', upper({state('open', 'closed')}), 'isDraft', {draft}, 'author', named_struct('login', {author}), 'comments', array(named_struct('id', 'a'), named_struct('id', 'b')), 'updatedAt', day, 'labels', {names}"),
        (forges.gitlab, f"'iid', o_orderkey, 'title', {title}, 'source_branch', {head}, 'target_branch', 'main', 'state', {state('opened', 'closed')}, 'draft', {draft}, 'author', named_struct('username', {author}), 'user_notes_count', o_custkey, 'updated_at', day, 'labels', array(o_orderpriority)"),
        (forges.gitea, f"'number', o_orderkey, 'title', {title}, 'head', named_struct('ref', {head}), 'base', named_struct('ref', 'main'), 'state', if(o_orderstatus = 'O', 'open', 'closed'), 'merged', o_orderstatus = 'P', 'draft', {draft}, 'user', named_struct('login', {author}), 'comments', o_custkey, 'updated_at', day, 'labels', {names}"),
        (forges.bitbucket, f"'id', o_orderkey, 'title', {title}, 'source', named_struct('branch', named_struct('name', {head})), 'destination', named_struct('branch', named_struct('name', 'main')), 'state', upper({state('open', 'declined')}), 'author', named_struct('nickname', {author}), 'comment_count', o_custkey, 'updated_on', day"),
    ]
    sources = [read(o.where(f"o_orderkey % 4 = {k}").select(F.expr(f"to_json(named_struct({fields}))").alias("value"))) for k, (read, fields) in enumerate(wire)]
    found = forges.all_requests(*sources)
    return found.withColumns({"updated": F.unix_timestamp("updated_at"), "labels": F.array_join("labels", ",")}).drop("updated_at")


@query("""SELECT p_partkey, p_partkey % 8 IN (1, 2) AS generated, p_partkey % 8 = 3 AS vendor, p_partkey % 8 IN (4, 5) AS doc, p_partkey % 8 = 6 AS manifest, p_partkey % 8 = 7 AS lockfile, p_partkey % 8 IN (1, 2, 3, 7) AS ritual FROM part""")
def path_kinds(t):
    forms = ["concat('src/', p_name, '.dart')", "concat('a/Gen/', p_name)", "concat(p_name, '.min.js')", "concat('a\\\\vendor\\\\', p_name)", "concat('x/docs/', p_name)", "concat(p_name, '.MD')", "concat(p_brand, '/package.json')", "concat(p_brand, '/yarn.lock')"]
    p = F.get(F.array(*map(F.expr, forms)), (F.col("p_partkey") % 8).cast("int"))
    return t("part").select("p_partkey", *(paths.path_kind(p, k).alias(k) for k in ("generated", "vendor", "doc", "manifest", "lockfile")), paths.ritual_path(p).alias("ritual"))


@query("""WITH c AS (SELECT l_orderkey, unnest(['a/' || l_partkey || '.c', 'b' || l_suppkey || '/x.dart']) AS path FROM lineitem) SELECT DISTINCT * FROM c""")
def cited_parts(t):
    """Paths in a note on each order, some in attributes, some bare; links are no paths."""
    one = F.expr("concat('<f path=\"a/', l_partkey, '.c\"> see b', l_suppkey, '/x.dart, not http/x/y.org (1.2)')")
    notes = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(one), "\n").alias("note"))
    return notes.select("l_orderkey", F.explode(paths.cited_paths(F.col("note"))).alias("path"))


@query("""SELECT event_id, ['PNG', 'Unknown', 'WebP', 'MP4', 'GZIP', 'Unknown'][event_id % 6 + 1] AS format, ['image', 'unknown', 'image', 'video', 'archive', 'unknown'][event_id % 6 + 1] AS "class", event_id % 6 IN (2, 3, 5) AS "binary" FROM events""")
def content_classes(t):
    heads = ["'89504E470D0A1A0A'", "'FF'", "'524946461000000057454250'", "'0000001866747970'", "'1F8B08'", "'6100'"]
    x = F.expr(f"unhex(concat(element_at(array({', '.join(heads)}), cast(event_id % 6 + 1 as int)), hex(event_type)))")
    found = t("events").select("event_id", contents.content_class(x).alias("c"), contents.looks_binary(x).alias("binary"))
    return found.select("event_id", "c.format", "c.class", "binary")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, 'p/' || l_partkey AS path, string_agg('+' || l_suppkey || l_linestatus, chr(10)) FILTER (last) AS added FROM (SELECT *, n = max(n) OVER (PARTITION BY l_orderkey, l_partkey) AS last FROM l) GROUP BY 1, 2""")
def diff_file_sections(t):
    """Each order is a diff with a section for each of its lines; of two on one part the last counts."""
    piece = "concat('diff --git a/p/', l_partkey, ' b/p/', l_partkey, '\n@@ -0,0 +1 @@\n+', l_suppkey, l_linestatus)"
    texts = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(piece).alias("x")))), lambda r: r["x"]), "\n").alias("diff"))
    return d.diff_sections(texts, "l_orderkey", "diff").select("l_orderkey", "path", F.split("text", "\n")[2].alias("added"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, lower(replace(l_linestatus, ' ', '_')) || '_' || l_partkey AS name FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, string_agg(name, ' ' ORDER BY length(name) DESC, name) AS symbols FROM s GROUP BY 1""")
def changed_symbols(t):
    """Lines not returned are context and give no symbol."""
    line = "concat(case l_returnflag when 'N' then ' ' when 'A' then '+' else '-' end, 'if ', lower(replace(l_linestatus, ' ', '_')), '_', l_partkey, ' 12 x')"
    texts = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.expr(line)), "\n").alias("diff"))
    return texts.select("l_orderkey", F.array_join(d.diff_symbols(F.col("diff"), 1000), " ").alias("symbols")).where("symbols <> ''")


@query("SELECT l_orderkey, 'p/' || l_partkey AS path FROM lineitem GROUP BY ALL")
def diff_touched_paths(t):
    one = F.expr("if(l_partkey % 2 = 0, concat('diff --git \"a/p/', l_partkey, '\" \"b/p/', l_partkey, '\"'), concat('diff --git a/q b/p/', l_partkey, '\n+diff'))")
    texts = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(one), "\n").alias("diff"))
    return texts.select("l_orderkey", F.explode(d.diff_paths(F.col("diff"))).alias("path"))


@query("SELECT split_part(p_name, ' ', 1) AS verb, count(*) AS n FROM part WHERE p_partkey % 5 < 3 GROUP BY 1")
def verb_counts(t):
    """Two of five subjects begin with a number or a hash."""
    forms = ["concat('fix(', p_brand, '): ', p_name)", "concat(' ', upper(p_name))", "concat('** ', p_name)", "concat('feat: 12 ', p_name)", "concat('deadbeef1 ', p_name)"]
    return d.verb_counts(t("part").select(F.get(F.array(*map(F.expr, forms)), (F.col("p_partkey") % 5).cast("int")).alias("subject")), "subject")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT p_type) AS types, min(p_type) AS t, count(DISTINCT p_brand) AS brands, min(p_brand) AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN n = 1 OR types = 1 AND brands = 1 THEN b WHEN types = 1 THEN t END AS label FROM g""")
def prefix_labels(t):
    """Paths root/type/brand/line of the parts of an order."""
    rows = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("line")).join(t("part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    return d.prefix_label(rows.select("l_orderkey", F.concat_ws("/", F.lit("root"), "p_type", "p_brand", "line").alias("path")), "l_orderkey", "path")
