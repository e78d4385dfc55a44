"""Alignment at any size, structure inside articles, and support from both neighbours."""

import random
import time

import pytest

from weft.llm import html_diff as h


def table(a, b):
    """The plain table of lengths and its trace from the ends."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    r, c, out = len(a), len(b), []
    while r and c:
        if a[r - 1] == b[c - 1] and t[r][c] == t[r - 1][c - 1] + 1:
            out.append(r - 1)
            r, c = r - 1, c - 1
        elif t[r - 1][c] >= t[r][c - 1]:
            r -= 1
        else:
            c -= 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_alignment_is_that_of_the_whole_table(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(2 + seed * 3) for _ in range(rng.randrange(90))] for _ in range(2))
    keep = set(a) & set(b)
    a, b = [x for x in a if x in keep], [x for x in b if x in keep]
    assert h._pairs(a, b) == table(a, b)


@pytest.mark.parametrize("n", [4_900, 6_000])
def test_long_pages_align_by_the_same_rule(n):
    rng = random.Random(1)
    a, b = ([f"line {rng.randrange(50)}" for _ in range(n)] for _ in range(2))
    began = time.perf_counter()
    found = sorted(h.common(a, b))
    assert time.perf_counter() - began < 60
    rest = iter(b)
    assert all(a[k] in rest for k in found)  # a common subsequence
    row = [0] * (n + 1)  # of the greatest length
    import numpy as np

    row, cb = np.zeros(n + 1, np.int32), np.array(b)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(cb == x, row[:-1] + 1, 0)))
    assert len(found) == row[-1] > n // 5


ARTICLE = "<article><h1>Title</h1><p>First paragraph of it.</p>{}<p>Last one.</p></article>"


@pytest.mark.parametrize("inner", [
    '<section id="discussion"><p>Kept text.</p></section>', '<div class="share-price">Kept text.</div>', '<p class="notice">Kept text.</p>', '<p id="reply-to-critics">Kept text.</p>', '<div class="header-wrap"><p>Kept text.</p></div>',
])
def test_words_in_names_hide_nothing_inside(inner):
    assert h.main_text(h.lines_of(ARTICLE.format(inner)), None) == "Title\nFirst paragraph of it.\nKept text.\nLast one."


@pytest.mark.parametrize("inner", ['<div class="comments"><p>Gone.</p></div>', '<section class="wide comment-section">Gone.</section>', '<div id=ad>Gone.</div>', "<form><p>Gone.</p></form>", '<div class="Advertisement">Gone.</div>', "<aside>Gone.</aside>"])
def test_whole_names_of_comments_adverts_and_forms_hide_inside(inner):
    assert h.main_text(h.lines_of(ARTICLE.format(inner)), None) == "Title\nFirst paragraph of it.\nLast one."


def test_an_element_that_never_ends_does_not_hide_the_article():
    page = "<body><aside><p>Side.</p>" + ARTICLE.format("") + "</body>"
    assert h.main_text(h.lines_of(page), None).endswith("Title\nFirst paragraph of it.\nLast one.")
    closed = "<body><aside><article><p>Teaser.</p></article></aside>" + ARTICLE.format("") + "</body>"
    assert h.main_text(h.lines_of(closed), None) == "Title\nFirst paragraph of it.\nLast one."


def page(n, extra='<p><a href="/x">Share this</a> <a href="/y">Read also</a></p>'):
    return f"<html><body><article><h1>Story {n}</h1><p>Own words of story number {n} here.</p><p>A passage that all of them quote.</p>{extra}</article></body></html>"


def test_rows_of_links_go_if_both_neighbours_have_them(spark):
    rows = [(n, f"http://h.example/s/{n}", page(n)) for n in range(1, 5)] + [(9, "http://alone.example/s/1", page(9)), (10, "http://two.example/a", page(10)), (11, "http://two.example/b", page(11))]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 3).collect()}
    quoted = "A passage that all of them quote."
    for n in (2, 3):  # between two neighbours
        assert got[n] == f"Story {n}\nOwn words of story number {n} here.\n{quoted}"
    for n in (1, 4, 9, 10, 11):  # without support from both sides nothing goes
        assert got[n].endswith(f"{quoted}\nShare this Read also")


def test_copies_keep_their_links(spark):
    rows = [(n, f"http://h.example/s/{n}", page(1)) for n in range(4)]
    got = {r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 2).collect()}
    assert got == {"Story 1\nOwn words of story number 1 here.\nA passage that all of them quote.\nShare this Read also"}
