"""Wrappers: what the alignment of a host's pages decides."""

import random
import time

import pytest

from lineseek.llm import html


def learned(pages):
    whole = None
    for page in pages:
        new = html.tree(page)
        whole = new if whole is None else html.merge(whole, new)
    return html.rules(html.load(html.dump(whole)))


def text(n, words=60):
    rng = random.Random(n)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(words))


def site(n, top="top", mid="mid", low="low"):
    return (f'<html><body><div class="{top}"><p>Home of all pages</p></div><div class="{mid}"><h2>T{n}</h2><p>{text(n)}</p></div>'
            f'<div class="{low}"><p>{"All rights are reserved by the owner of these pages. " * 4}</p></div></body></html>')


@pytest.mark.parametrize("names", [{}, {"low": "content"}, {"top": "main", "low": "post"}, {"top": "x1", "mid": "x2", "low": "x3"}])
def test_text_that_varies_is_the_article_whatever_the_names(names):
    pages = [site(n, **names) for n in range(3)]
    rule = learned(pages)
    assert [html.extract(p, rule) for p in pages] == [f"T{n} {text(n)}" for n in range(3)]


def test_alignment_decides():
    long = "All rights are reserved by the owner of these pages. "
    pages = [site(n, low="content").replace(long, long * 9) for n in range(3)]
    alone = html.extract(pages[0], html.rules(html.tree(pages[0])))
    assert alone != html.extract(pages[0], learned(pages)) == f"T0 {text(0)}"


def test_classes_numbered_by_page_meet():
    pages = [site(n, mid=f"item-{n + 10}") for n in range(4)]
    rule = learned(pages)
    assert rule["main"] == [["html", "body", "~div.item-0"]]
    assert [html.extract(p, rule) for p in pages] == [f"T{n} {text(n)}" for n in range(4)]


def test_template_inside_an_unnamed_region_is_dropped():
    pages = [f'<body><div class=a>Always the same words here</div><p>{text(n)}</p><div class=b>And these as well</div><p>{text(n + 50)}</p></body>' for n in range(4)]
    rule = learned(pages)
    assert [html.extract(p, rule) for p in pages] == [f"{text(n)} {text(n + 50)}" for n in range(4)]


def test_names_choose_between_holders_of_the_text():
    pages = [f'<body><div class=w><article><p>{text(n)}</p></article><div class=z>{text(n + 90, 9)}</div></div></body>' for n in range(3)]
    assert html.extract(pages[1], learned(pages)) == text(1)


def test_two_templates_of_a_host():
    pages = [f"<body><article>{text(n)}</article></body>" for n in range(5)] + [f"<body><div class=q><div class=post>{text(n)}</div><b>x</b></div></body>" for n in range(5, 8)]
    rule = learned(pages)
    assert [html.extract(p, rule) for p in pages] == [text(n) for n in range(8)]


def test_copies_and_single_pages_count_all_text():
    page = site(1)
    assert html.extract(page, learned([page])) == html.extract(page, learned([page, page]))


def test_deep_pages(spark):
    deep = lambda n: "<div>" * 10_000 + f"<p>{text(n)}</p>" + "</div>" * 10_000
    df = spark.createDataFrame([(n, f"http://deep.org/{n}", deep(n), 1) for n in range(2)], "page_id long, url string, html string, share int")
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == {n: text(n) for n in range(2)}


def test_long_lists_of_siblings_are_aligned_in_time():
    def page(n):
        rng = random.Random(n)
        return "<body>" + "".join(f"<{t}>{i}</{t}>" for i, t in enumerate(rng.choices(["p", "h2", "ul", "div", "pre"], k=6000))) + "</body>"

    start = time.time()
    html.rules(html.merge(html.tree(page(1)), html.tree(page(2))))
    assert time.time() - start < 5


def test_match_against_brute_force():
    def longest(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(row[j], best[j + 1]))
            best = row
        return best[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = (rng.choices("pqrs", k=rng.randrange(12)) for _ in range(2))
        got = html.match(a, b)
        assert [i for i, _ in got if i is not None] == list(range(len(a))) and [j for _, j in got if j is not None] == list(range(len(b)))
        both = [(i, j) for i, j in got if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in both) and len(both) == longest(a, b)


def test_wrapper_survives_its_table():
    w = html.merge(html.tree(site(1)), html.tree(site(2, mid="item-7")))
    assert html.expression(html.load(html.dump(w))) == html.expression(w)
