"""Operators across documents against brute force: lines, suffixes, SimHash, windows, pages."""

import collections
import hashlib
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import components, html_diff, line_dedup, simhash_mih, suffix_dedup, wu_manber
from weft.llm.induced_sort import descending


def multiset(rows):
    return collections.Counter(map(tuple, rows))


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 51), (60, 60)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50 and 60 not in got
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs, corpus, empty):
    got = simhash_mih.near_duplicates(docs).collect()
    prints = [simhash_mih.fingerprint(t) for _, t in corpus]
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    group = roots(len(prints), links)
    least = {}
    for g, (i, _) in zip(group, corpus, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert multiset(got) == multiset((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(corpus, prints, group, strict=True))
    kept = simhash_mih.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {least.get(g) for g in group} and kept.count() == len(set(group))
    assert simhash_mih.near_duplicates(empty).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    words = "a b c d e".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(2)]
    assert simhash_mih.fingerprint("A  b\tC\nd e") == hashes[0] & hashes[1]
    assert simhash_mih.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash_mih.fingerprint(None) == simhash_mih.fingerprint(" \n") == 0


def test_all_links_within_four_bits_are_found(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << k
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for block in (4096, 2):
        links = simhash_mih.links(spark.createDataFrame([(s,) for s in signed], "fp long"), block=block).collect()
        at = {s: k for k, s in enumerate(signed)}
        assert roots(len(prints), [(at[r["a"]], at[r["b"]]) for r in links]) == want


def test_line_simhash_by_hand():
    import xxhash

    lines = [[b"a", b"b", b"c"], [b"x"] * 300 + [b"y"] * 301, [b"z"], [b"w%d" % k for k in range(700)], [b"q%d" % k for k in range(9)]]

    def simhash(words):
        hashes = [xxhash.xxh64_intdigest(w) for w in words]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(words))

    prints, keys = line_dedup.line_prints(lines)
    assert prints.view(np.uint64).tolist() == [simhash(line) for line in lines]
    assert not keys[0].any() and not keys[2].any()  # too short for fuzzy links
    mixed = lambda words: (h := sum(map(xxhash.xxh64_intdigest, words)) % 2**64, (h ^ h >> 31) * 0xD6E8FEB86659FD93 % 2**64)[1]
    runs = {mixed(line[a:b]) for line in lines for a in range(len(line)) for b in range(a + 3, min(len(line), a + 60) + 1) if len(line) < 20 or b - a > 3}
    assert {k for k in keys[3:].view(np.uint64).ravel().tolist() if k} <= runs and keys[3:].any(axis=1).all()


def test_blocks_do_not_depend_on_other_lines():
    rng = random.Random(9)
    lines = [[b"%x" % rng.getrandbits(12) for _ in range(rng.randint(1, 60))] for _ in range(200)]
    prints, keys = line_dedup.line_prints(lines)
    for k, line in enumerate(lines):
        own, mine = line_dedup.line_prints([line])
        assert own[0] == prints[k] and (mine[0] == keys[k]).all()


def test_edit_similarity():
    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = (" ".join(rng.choices(["ab", "c", "dab", "bb"], k=rng.randint(4, 9))) for _ in range(2))
        for s in (0.3, 0.5):
            assert line_dedup.edit_similar(a, b, s) == (levenshtein(a, b) <= int((1 - s) * max(len(a), len(b)) + 1e-9))
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(2))
        s = rng.choice([0.3, 0.5, 0.8])
        assert line_dedup.edit_similar(a, b, s) == (levenshtein(a, b) <= int((1 - s) * max(len(a), len(b)) + 1e-9))


def brute_lines(table):
    """{row: numbers of the lines to remove}, by comparing all pairs of lines that share a key."""
    table.sort(key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    found = []
    for row, _, text in table:
        for k, line in enumerate(text.split("\n")):
            norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")
            if norm:
                found.append((row, k, norm))
    names = sorted({x[2] for x in found})
    prints, keys = line_dedup.line_prints([n.encode().split(b" ") for n in names])
    prints, keys = prints.view(np.uint64), [set(k.tolist()) - {0} for k in keys]
    links = [(i, j) for i in range(len(names)) for j in range(i) if keys[i] & keys[j] and int(prints[i] ^ prints[j]).bit_count() <= 12 and line_dedup.edit_similar(names[i], names[j], 0.8)]
    group, seen, gone = roots(len(names), links), set(), collections.defaultdict(list)
    at = {n: k for k, n in enumerate(names)}
    for row, k, norm in found:
        if group[at[norm]] in seen:
            gone[row].append(k)
        seen.add(group[at[norm]])
    return gone


def test_fuzzy_lines(spark, docs, corpus, empty):
    table = [(r["row"], r["doc_id"], r["text"]) for r in line_dedup.text_of(docs).collect()]
    gone = brute_lines(table)
    assert {r["row"]: r["lines"] for r in line_dedup.removed_lines(docs).collect()} == gone and gone
    assert {r["row"]: r["lines"] for r in line_dedup.removed_lines(docs, block=2).collect()} == gone
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    want = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[row]) for row, _, t in table]
    assert collections.Counter(r["text"] or "" for r in out.collect()) == collections.Counter(want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
    rows = [(i, t.count("\n") + 1, len(gone[row]), gone[row]) for row, i, t in table]
    assert collections.Counter((r[0], r[1], r[2], tuple(r[3])) for r in line_dedup.decisions(docs).collect()) == collections.Counter((*r[:3], tuple(r[3])) for r in rows)
    assert line_dedup.decisions(empty).count() == line_dedup.without_repeats(empty).count() == 0
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("__row", F.lit(5))
    assert line_dedup.without_repeats(odd).columns == odd.columns


def test_short_lines_go_only_when_equal(spark):
    rows = [(1, "See also\nSee  ALSO!\nSee alsos\n\n\n...\nx"), (2, "x\n"), (3, "y" * 3_000_000 + "\nx")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [1], 2: [0], 3: [1]}


def test_similar_lines_are_found():
    """Recall of the candidates against edit similarity alone, on lines with words changed."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    pairs = found = 0
    for _ in range(1500):
        a = rng.choices(vocabulary, k=rng.randint(8, 80))
        b, n = list(a), rng.randint(1, max(1, len(a) // 12))
        for _ in range(n):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [rng.choice(vocabulary)], [b[k], rng.choice(vocabulary)]])
        if line_dedup.edit_similar(" ".join(a), " ".join(b), 0.8):
            prints, keys = line_dedup.line_prints([[w.encode() for w in x] for x in (a, b)])
            pairs += 1
            found += (int(prints[0] ^ prints[1]) & ((1 << 64) - 1)).bit_count() <= 12 and bool((set(keys[0].tolist()) & set(keys[1].tolist())) - {0})
    assert pairs > 1300 and found / pairs >= 0.9


@pytest.mark.parametrize("memory", [3, 1_000_000])
def test_induced_sorting(memory):
    rng = random.Random(6)
    for n in range(250):
        text = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 50))] * rng.choice([1, 1, 3])
        text = np.array([*text, 0], np.uint16)
        with tempfile.TemporaryDirectory() as folder:
            blocks = list(descending(text, 7, folder, 9, memory))
        order, prefix = np.concatenate([a for a, _ in blocks]).tolist(), np.concatenate([p for _, p in blocks]).tolist()
        s = text.tolist()
        assert order == sorted(range(len(s)), key=lambda i: s[i:], reverse=True)
        for k in range(1, len(order)):
            a, b = s[order[k] :], s[order[k - 1] :]
            same = next((d for d, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert prefix[k] == min(same, 9)


def test_suffix_dedup(docs, corpus, empty):
    data = [(i, (t or "").encode()) for i, t in corpus]
    starts = collections.Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    want = []
    for i, b in data:
        spans = []
        for k in range(len(b) - 199):
            if starts[b[k : k + 200]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 200
                else:
                    spans.append([k, k + 200])
        rest = suffix_dedup.kept_bytes(b, spans)
        want.append((i, len(b), len(b) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
    assert multiset(suffix_dedup.digests(docs).collect()) == multiset(want)
    assert multiset(suffix_dedup.digests(docs, shard_bytes=500, memory=50).collect()) == multiset(want)
    assert multiset(suffix_dedup.digests(docs, hot=1).collect()) == multiset(want)
    assert suffix_dedup.digests(empty).count() == 0


def test_hot_keys_are_cut_down(spark):
    """A passage of 150 to 260 bytes in different surroundings: one key, many distinct pieces."""
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, tails = word(260), [word(40) for _ in range(3)]
    texts = [word(rng.randint(50, 200)) + core[: rng.choice([150, 199, 200, 201, 260])] + rng.choice([word(120), rng.choice(tails) + word(90)]) for _ in range(60)]
    texts += [word(10) + core[60:] + tails[0] + word(100) for _ in range(20)] + ["z" * 100_000 + core]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = multiset(suffix_dedup.digests(docs).collect())
    for hot in (2, 10):
        assert multiset(suffix_dedup.digests(docs, hot=hot).collect()) == plain
    data = [t.encode() for t in texts]
    starts = collections.Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    gone = {i: {k + j for k in range(len(b) - 199) if starts[b[k : k + 200]] > 1 for j in range(200)} for i, b in enumerate(data[:-1])}
    assert all(r["n_removed"] == len(gone[r["doc_id"]]) for r in suffix_dedup.digests(docs, hot=2).collect() if r["doc_id"] < 80)


def test_recursion_through_files():
    rng = np.random.default_rng(5)
    for n, sigma, bits in ((3000, 3, 4), (4000, 2, 6), (2500, 200, 9)):
        text = np.append(rng.integers(1, sigma + 1, n), 0).astype(np.uint16)
        text[n // 2 : n - 1] = text[: n - 1 - n // 2]  # long repeats, so that names repeat
        with tempfile.TemporaryDirectory() as folder:
            blocks = list(descending(text, sigma + 1, folder, 9, 40, bits))
        order, s = np.concatenate([a for a, _ in blocks]).tolist(), text.tolist()
        assert order == sorted(range(len(s)), key=lambda i: s[i:], reverse=True)


def test_wu_manber(spark, docs, corpus, empty):
    texts = [t for _, t in corpus if t]
    items = [(1, " ".join(texts[0].split()[3:30])), (2, texts[1]), (3, "x Y"), (4, None), (5, "..."), (2, texts[5]), (None, texts[6])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(fold))
        for k in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = []
    for i, t in corpus:
        w, hit, found = word.findall((t or "").translate(fold)), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in patterns:
                    hit.update(range(k, k + n))
                    found |= patterns[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert multiset(wu_manber.hits(docs, bench).collect()) == multiset(want)
    assert multiset(wu_manber.hits(docs, bench, most=20).collect()) == multiset(want)
    clean = wu_manber.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    assert wu_manber.hits(docs, empty.selectExpr("doc_id as item_id", "text")).where("contaminated").count() == 0
    assert wu_manber.hits(empty, bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">Accept</div><article><h1>Head &amp; line</h1><p>One<br>two  <b>three</b><p>Four &lt;5</p><div class=ad>Buy</div><form><input>Send</form></article>
<aside>Side</aside><section id="comments"><p>Nice</p></section><!-- <p>no</p> --><footer>&copy;</footer></body></html>"""


def test_structure():
    assert html_diff.main_text(html_diff.lines_of(PAGE), None) == "Head & line\nOne two three\nFour <5"
    assert html_diff.lines_of(None) == html_diff.lines_of("") == []
    assert html_diff.lines_of("a < b and <p>open") == [("a < b and", False), ("open", False)]


def test_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got, rest = html_diff.common(a, b), iter(b)
        assert len(got) == table[-1][-1] and all(a[k] in rest for k in sorted(got))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div role="main"><p>In</p></div><div>Out</div>', [("In", True), ("Out", False)]),
        ("<article><figure><img src=x><figcaption>Caption</figcaption></figure></article>", [("Caption", True)]),
        ("<article><header><h1>Head</h1><p>Standfirst</p></header><p>Body</p><footer>By</footer></article>", [("Head", True), ("Standfirst", True), ("Body", True)]),
        ("<article><p>One</p><aside>Never closed<p>x</article><p>After</p>", [("One", True), ("After", False)]),
        ("<nav>Open<ul><li>a<li>b<main><p>Text</main>", [("Text", True)]),
        ('<article>Story<h2 id="discussion">Discussion of results</h2></article><article class="comment">Nice</article>', [("Story", True), ("Discussion of results", True)]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [("a b", False), ("c", False)]),
        ("</div></p>x<br>y", [("x y", False)]),
    ],
)
def test_lines_of_awkward_pages(page, want):
    assert html_diff.lines_of(page) == want


def brute_pages(rows):
    """Texts by sorting all pages at once."""
    pages = sorted(((html_diff.address(u), i is not None, i or 0, k) for k, (i, u, _) in enumerate(rows)))
    lines = [html_diff.lines_of(rows[k][2]) for *_, k in pages]
    out = []
    for n, (place, *_, k) in enumerate(pages):
        near = [m for m in (n - 1, n + 1) if 0 <= m < len(pages) and pages[m][0][0] == place[0]]
        near = max(near, key=lambda m: html_diff.closeness(pages[m][0], place), default=None)
        own, shared = lines[n], set()
        if near is not None:
            shared = html_diff.common([x for x, _ in own], [x for x, _ in lines[near]])
            if not any(i for _, i in own) and 10 * sum(len(own[j][0]) for j in shared) >= 9 * sum(len(x) for x, _ in own):
                shared = set()
        text = "\n".join(x for j, (x, inside) in enumerate(own) if inside or j not in shared)
        out.append((rows[k][0], rows[k][1], text, len(text)))
    return out


def test_differencing_decides_alike_for_any_partitions(spark):
    rng = random.Random(21)
    rows = []
    for i in range(90):
        host = rng.choice(["big.example", "big.example", "www.big.example", "a.example", "b.example"])
        body = "".join(f"<p>{' '.join(rng.choices(['one', 'two', 'three', 'four'], k=9))} {i}</p>" for _ in range(3))
        around = f"<div>Welcome to {host.removeprefix('www.')}</div>", "<div>Contact us by post</div>", f"<div>Line of page {i}</div>"
        main = rng.choice(["<article>%s</article>", "<div>%s</div>", "<div role=main>%s</div>"]) % (body + ("<p>Contact us by post</p>" if i % 3 else ""))
        rows.append((i if i % 17 else None, f"http://{host}/{rng.choice('xyz')}/{i}" if i % 13 else None, around[0] + main + around[1] + around[2]))
    rows += [(200, None, None), (201, "http://[bad", ""), (5, "http://alone.example/", "<p>Alone</p>"), (300, "http://long.example/", "<article>" + "<p>long text</p>" * 30_000 + "</article>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("clash"))
    want = multiset(brute_pages(rows))
    texts = [t for _, _, t, _ in want]
    assert sum("Contact us by post" in t for t in texts) > 20 and sum("Welcome" in t for t in texts) < 20
    for partitions in (1, 7, 64):
        assert multiset(html_diff.extract(table, partitions).collect()) == want


def test_pages_without_structure_lose_what_neighbours_share(spark):
    def page(body):
        return f"<div>Home of the site</div><div>{body}</div><div>All rights reserved</div>"

    rows = [(1, "http://h.example/a/1", page("First story told at length")), (2, "http://www.h.example/a/2?q=1", page("Second story, quite another one")), (3, "http://other.example/", page("Alone")), (4, None, None), (5, "http://z.example/x", PAGE), (5, "http://z.example/x", PAGE)]
    got = html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 1).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "First story told at length" and texts[2] == "Second story, quite another one"
    assert texts[3].split("\n")[1] == "Alone" and texts[4] == "" and texts[5].startswith("Head & line\n")
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_piece_meets_the_hot_keys_of_its_own_level_only(spark):
    rng = random.Random(5)
    some = lambda n: bytes(rng.randrange(256) for _ in range(n))
    gram, after = some(8), some(14)
    key = int(suffix_dedup.gram_hashes(np.frombuffer(gram, np.uint8), 8).view(np.int64)[0])
    rows = [(key, bytes([i]) * 16, some(20) + gram + after + some(6), 2) for i in range(40)]
    ready, back = suffix_dedup.cooled(spark.createDataFrame(rows, "key long, digest binary, piece binary, n long"), 28, 8, 10)
    assert len(back) == 2 and ready._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 2
    assert ready.count() == 120
