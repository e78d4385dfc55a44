"""Text operators: token statistics, search, label mining, line diffs and moves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .ordering import numbered


def token_rows(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(doc, token): the distinct tokens of each document."""
    return rows.select(F.col(key).alias("doc"), F.explode(F.array_distinct(tokens)).alias("token"))


def document_frequency(tokens: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf): idf = ln(1 + n / (1 + df))."""
    return tokens.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + F.lit(float(n_docs)) / (1 + F.col("df"))))


def inverted_index(tokens: DataFrame, width: int = 1000) -> DataFrame:
    """(token, df, part, docs): the documents of each token, in lists of ids that share id div width.

    A token that all documents hold has as many rows as there are such ranges, none of them longer
    than ``width``.
    """
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    lists = tokens.groupBy("token", F.floor(F.col("doc") / width).alias("part")).agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    return df.join(lists, "token")


def search(tokens: DataFrame, query: list[str], n_docs: int, k: int = 20) -> DataFrame:
    """(doc, score): sum over matched query tokens of 1 / (1 + df / n), the best k."""
    hit = tokens.where(F.col("token").isin(*query))
    df = hit.groupBy("token").agg(F.count("*").alias("df"))
    return hit.join(F.broadcast(df), "token").groupBy("doc").agg(F.sum(1 / (1 + F.col("df") / float(n_docs))).alias("score")).orderBy(F.round("score", 9).desc(), "doc").limit(k)


def token_classes(tokens: DataFrame) -> DataFrame:
    """(doc, cls): documents of equal token sets are one class, named by the least of them."""
    sets = tokens.groupBy("doc").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("token")), "\n"), 256).alias("digest"))
    least = sets.groupBy("digest").agg(F.min("doc").alias("cls"))
    return sets.join(least, "digest").select("doc", "cls")


#: Documents of a block at least, blocks at least (if there are as many), and token numbers of a block at most.
BLOCK_DOCS, BLOCKS, BLOCK_TOKENS = 1000, 6, 8 << 20


def idf_jaccard(tokens: DataFrame, frequency: DataFrame, similarity: float = 0.5) -> DataFrame:
    """(a, b, score): class representatives whose idf-weighted Jaccard over all tokens reaches ``similarity``.

    A low similarity leaves no token out, so all pairs are scored, but none is a row before it is known to
    count: a document is one row of token numbers, the documents are dealt in blocks, and a task multiplies
    two blocks (see :func:`_multiplied`).  What is shuffled is each document once for each block, so it
    grows as the documents do; the work grows with their square.  Copies are one representative, see
    :func:`token_classes`.
    """
    ids = numbered(frequency.select("token", "idf"), [F.col("idf"), F.col("token")], "id")
    sets = tokens.join(ids.select("token", F.col("id").cast("int").alias("id")), "token").groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    own = cut(sets.groupBy("ids").agg(F.min("doc").alias("doc")))
    docs, total = own.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    n = max(1, min(BLOCKS, docs // BLOCK_DOCS), -(-total // BLOCK_TOKENS))
    # A number stands for the weight of its run; as k frequencies take k * k / 2 rows of tokens, runs are few.
    runs = ids.groupBy("idf").agg(F.min("id").alias("id")).orderBy("id").collect()
    starts, weights = np.array([r["id"] for r in runs], np.int64), np.array([r["idf"] for r in runs], np.float64)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.select("doc", "ids", (F.col("block") != low).alias("right"), (low == high).alias("same"), (low * n - F.expr("least(block, other) * (least(block, other) + 1) div 2") + high).cast("int").alias("pair"))
    pairs = dealt.repartitionById(n * (n + 1) // 2, F.col("pair")).drop("pair")
    kind = dict(own.dtypes)["doc"]
    found = pairs.mapInArrow(_multiplied(starts, weights, similarity), f"x {kind}, y {kind}, score double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def _multiplied(starts: np.ndarray, weights: np.ndarray, s: float, cells: int = 1 << 20, met: int = 1 << 21):
    """Task over two blocks (doc, ids, right, same): the pairs of one with the other, or of one within itself.

    Common tokens are columns of two matrices, the others meet by their postings, a tile of documents at a
    time.  Documents are sorted by weight, so that a tile meets only those whose weight allows ``s``.
    """

    def side(table: pa.Table):
        ids = table["ids"].combine_chunks()
        token, size = ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        w = np.bincount(row, weights[np.searchsorted(starts, token, "right") - 1], len(size))
        order = np.argsort(w, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        row = place[row]
        by = np.argsort(row, kind="stable")
        return table["doc"].combine_chunks().take(pa.array(order)), w[order], row[by], token[by]

    def task(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        same = table["same"][0].as_py()
        x = side(table if same else table.filter(pc.invert(table["right"])))
        y = x if same else side(table.filter(table["right"]))
        (docs_x, wx, row_x, tok_x), (docs_y, wy, row_y, tok_y) = x, y
        nx, ny = len(wx), len(wy)
        if not nx or not ny:
            return
        shared = np.intersect1d(tok_x, tok_y)
        keep_x, keep_y = np.isin(tok_x, shared), np.isin(tok_y, shared)
        row_x, tok_x, row_y, tok_y = row_x[keep_x], np.searchsorted(shared, tok_x[keep_x]), row_y[keep_y], np.searchsorted(shared, tok_y[keep_y])
        idf = weights[np.searchsorted(starts, shared, "right") - 1]
        count = np.bincount(tok_y, minlength=len(shared))
        common = np.flatnonzero(np.bincount(tok_x, minlength=len(shared)) * count > nx * ny / 100)
        column = np.full(len(shared), -1)
        column[common] = np.arange(len(common))
        of_y = column[tok_y]
        right = np.zeros((len(common), ny))
        right[of_y[of_y >= 0], row_y[of_y >= 0]] = 1.0
        by = np.argsort(tok_y, kind="stable")
        listed, first = row_y[by], np.cumsum(count) - count
        of_x = column[tok_x]
        load = np.where(of_x < 0, count[tok_x], 0)
        ends = np.searchsorted(row_x, np.arange(nx + 1))
        done = np.concatenate(([0], np.cumsum(load)))[ends]
        at = 0
        while at < nx:
            to = max(at + 1, min(at + max(1, cells // ny), int(np.searchsorted(done, done[at] + met, "right")) - 1, nx))
            a, b = ends[at], ends[to]
            rare, dense = a + np.flatnonzero(of_x[a:b] < 0), a + np.flatnonzero(of_x[a:b] >= 0)
            n = load[rare]
            hit = np.repeat(first[tok_x[rare]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(np.repeat((row_x[rare] - at) * ny, n) + listed[hit], np.repeat(idf[tok_x[rare]], n), (to - at) * ny).astype(np.float64, copy=False).reshape(to - at, ny)
            low, high = np.searchsorted(wy, s * wx[at] - 1e-9), ny if s <= 0 else np.searchsorted(wy, wx[to - 1] / s + 1e-9)
            left = np.zeros((to - at, len(common)))
            left[row_x[dense] - at, of_x[dense]] = idf[tok_x[dense]]
            both[:, low:high] += left @ right[:, low:high]
            both = both[:, low:high]
            i, j = np.nonzero((both > 0) & (both * (1 + s) >= s * (wx[at:to, None] + wy[low:high]) - 1e-6))
            score = both[i, j] / (wx[at + i] + wy[low + j] - both[i, j])
            good = score >= s
            if same:
                good &= at + i < low + j
            if good.any():
                i, j = at + i[good], low + j[good]
                yield pa.RecordBatch.from_arrays([docs_x.take(pa.array(i)), docs_y.take(pa.array(j)), pa.array(score[good])], ["x", "y", "score"])
            at = to

    return task


def stop_tokens(frequency: DataFrame) -> DataFrame:
    """(token, df): tokens above the knee of the document-frequency distribution.

    The knee is taken over the distinct frequencies (a histogram, small beside the vocabulary):
    the frequency farthest from the chord of (ln df, ln number of tokens with at least df).
    """
    hist = frequency.groupBy("df").agg(F.count("*").alias("n"))
    at_least = hist.select("df", F.sum("n").over(Window.orderBy(F.col("df").desc())).alias("above"))
    points = at_least.select("df", F.log("df").alias("t"), F.log("above").alias("y"), F.lit(0).alias("series"))
    from .series import knee

    cut = knee(points).select(F.round(F.exp("knee_t")).cast("long").alias("cut"))
    return frequency.crossJoin(F.broadcast(cut)).where("df > cut").select("token", "df")


def npmi_labels(tokens: DataFrame, buckets: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    """(bucket, token, npmi, rank): the tokens most bound to each bucket.  ``buckets``: (doc, bucket)."""
    n = buckets.count()
    both = tokens.join(buckets, "doc").groupBy("bucket", "token").agg(F.count("*").alias("c"))
    per_bucket = buckets.groupBy("bucket").agg(F.count("*").alias("nb"))
    per_token = tokens.join(buckets, "doc", "left_semi").groupBy("token").agg(F.count("*").alias("nt"))
    p = F.col("c") / float(n)
    npmi = F.log(p / (F.col("nb") / float(n)) / (F.col("nt") / float(n))) / -F.log(p)
    scored = both.where(F.col("c") >= least).join(per_bucket, "bucket").join(per_token, "token").where(F.col("c") < n).select("bucket", "token", npmi.alias("npmi"))
    order = Window.partitionBy("bucket").orderBy(F.round("npmi", 9).desc(), "token")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def char_entropy(text: Column) -> Column:
    """Entropy of the characters over ln of their number."""
    chars = F.split(text, "")
    return F.transform(F.array(F.array_distinct(chars)), lambda kinds: F.when(F.size(kinds) < 2, 0.0).otherwise(
        -F.aggregate(F.transform(kinds, lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)), F.lit(0.0), lambda a, p: a + p * F.log(p)) / F.log(F.size(kinds))))[0]


def line_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line, content)."""
    return rows.select(F.col(key).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "content"))


def parse_diff(diffs: DataFrame) -> DataFrame:
    """(diff_id, line_no, kind, old_no, new_no, hunk, path, text) of unified diffs (diff_id, text)."""
    lines = diffs.select("diff_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("line_no", "text"))
    kind = (
        F.when(F.col("text").startswith("@@"), "hunk")
        .when(F.col("text").rlike(r"^(diff |index |--- |\+\+\+ |new file|deleted file|old mode|new mode|similarity|rename |Binary |\\)"), "meta")
        .when(F.col("text").startswith("+"), "add")
        .when(F.col("text").startswith("-"), "del")
        .otherwise("context")
    )
    w = Window.partitionBy("diff_id").orderBy("line_no")
    header = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    tagged = lines.withColumn("kind", kind).withColumn("path", F.last(F.when(F.col("text").startswith("+++ "), F.regexp_extract("text", r"^\+\+\+ (?:b/)?([^\t]*)", 1)), True).over(w))
    tagged = tagged.withColumn("hunk", F.sum(F.when(F.col("kind") == "hunk", 1).otherwise(0)).over(w))
    old0 = F.last(F.when(F.col("kind") == "hunk", F.regexp_extract("text", header, 1).cast("int")), True).over(w)
    new0 = F.last(F.when(F.col("kind") == "hunk", F.regexp_extract("text", header, 2).cast("int")), True).over(w)
    inside = Window.partitionBy("diff_id", "hunk").orderBy("line_no")
    tagged = tagged.withColumns({"o": old0, "n": new0, "dels": F.sum(F.when(F.col("kind").isin("del", "context"), 1).otherwise(0)).over(inside), "adds": F.sum(F.when(F.col("kind").isin("add", "context"), 1).otherwise(0)).over(inside)})
    return tagged.select(
        "diff_id", "line_no", "kind",
        F.when(F.col("kind").isin("del", "context") & (F.col("hunk") > 0), F.col("o") + F.col("dels") - 1).alias("old_no"),
        F.when(F.col("kind").isin("add", "context") & (F.col("hunk") > 0), F.col("n") + F.col("adds") - 1).alias("new_no"),
        "hunk", "path", "text",
    )


def diff_counts(parsed: DataFrame) -> DataFrame:
    """(diff_id, adds, dels, hunks, files)."""
    return parsed.groupBy("diff_id").agg(F.count_if(F.col("kind") == "add").alias("adds"), F.count_if(F.col("kind") == "del").alias("dels"), F.count_if(F.col("kind") == "hunk").alias("hunks"), F.count_distinct("path").alias("files"))


def touched_ranges(parsed: DataFrame) -> DataFrame:
    """(diff_id, path, low, high): runs of added lines, gaps and islands."""
    w = Window.partitionBy("diff_id", "path").orderBy("new_no")
    adds = parsed.where("kind = 'add'").select("diff_id", "path", "new_no", (F.col("new_no") - F.row_number().over(w)).alias("island"))
    return adds.groupBy("diff_id", "path", "island").agg(F.min("new_no").alias("low"), F.max("new_no").alias("high")).drop("island")


def moves(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(doc, from_line, to_line, length): blocks of lines deleted in one place and added in another.

    Both: (doc, line, hash).  Lines match by hash within a document, through hashes that stand once
    on either side; runs with one offset are blocks.
    """
    one = Window.partitionBy("doc", "hash")
    r = removed.withColumn("n", F.count("*").over(one)).where("n = 1").select("doc", "hash", F.col("line").alias("i"))
    a = added.withColumn("n", F.count("*").over(one)).where("n = 1").select("doc", "hash", F.col("line").alias("j"))
    met = r.join(a, ["doc", "hash"]).withColumn("shift", F.col("j") - F.col("i"))
    w = Window.partitionBy("doc", "shift").orderBy("i")
    runs = met.withColumn("run", F.col("i") - F.row_number().over(w))
    return runs.groupBy("doc", "shift", "run").agg(F.min("i").alias("from_line"), F.min("j").alias("to_line"), F.count("*").alias("length")).select("doc", "from_line", "to_line", "length")


def text_chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(doc, chunk, start, content): fixed-size pieces of each text."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return rows.select(F.col(key).alias("doc"), F.col(text).alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("doc", "chunk", (F.col("chunk") * size).alias("start"), F.substring(F.col("t"), F.col("chunk") * size + 1, F.lit(size)).alias("content"))


#: A word of a subject: a letter, then up to 47 letters, digits, _ or -.  Fixed value.
SUBJECT_WORD = r"\p{L}[\p{L}\p{N}_\-]{0,47}"


def structural_words(rows: DataFrame, subject: str, share: float = 0.10, longest: int = 4, first: float = 0.25, upper: float = 0.35, least: int = 3) -> DataFrame:
    """(word, subjects, leading, shouted): short words that hold subjects together, found in the corpus alone.

    Such a word stands in a ``share`` of the subjects (two at least), is short, seldom leads, and is
    seldom written in capitals.  Subjects count behind "kind(scope): "; those of one word, of one letter
    held down, or of "update" and a file name are noise.  Below ``least`` subjects there is no word.
    """
    plain = F.regexp_replace(F.trim(subject), r"\A\w+(\([^)]*\))?\s*:\s*", "")
    split = rows.select(plain.alias("s")).select("s", F.regexp_extract_all("s", F.lit(SUBJECT_WORD), F.lit(0)).alias("w"))
    letters = F.lower(F.regexp_replace("s", r"[^\p{L}]", ""))
    held_down = (F.length(letters) >= 4) & (F.replace(letters, F.substring(letters, 1, 1), F.lit("")) == "")
    named = F.col("s").rlike(r"(?i)\Aupdate\s+[\w\-./]{1,80}\.[\w]{1,8}\z")
    clean = split.withColumn("low", F.transform("w", lambda x: F.lower(x))).where((F.size(F.array_distinct("low")) > 1) & ~held_down & ~named)
    seen = clean.select("low", F.posexplode("w").alias("at", "raw")).withColumn("word", F.lower("raw"))
    shouted = F.col("raw").rlike(r"\p{Lu}") & ~F.col("raw").rlike(r"\p{Ll}") & (F.length("raw") >= 2)
    counts = seen.groupBy("word").agg(
        F.count_if(F.array_position("low", F.col("word")) == F.col("at") + 1).alias("subjects"), F.count_if(F.col("at") == 0).alias("leads"), F.count("*").alias("n"), F.count_if(shouted).alias("caps")
    )
    total = clean.agg(F.count("*").alias("total"))
    enough = (F.col("total") >= least) & (F.col("subjects") >= F.greatest(F.lit(2), F.floor(F.col("total") * share)))
    ranked = counts.crossJoin(F.broadcast(total)).select("word", "subjects", (F.col("leads") / F.col("subjects")).alias("leading"), (F.col("caps") / F.col("n")).alias("shouted"), enough.alias("enough"))
    return ranked.where(F.col("enough") & (F.length("word") <= longest) & (F.col("leading") <= first) & (F.col("shouted") <= upper)).drop("enough")
