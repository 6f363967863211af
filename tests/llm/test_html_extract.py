from __future__ import annotations

import random

import pytest

from outcomelens.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string"


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(n))


def article_page(r, host):
    paragraphs = [words(r, r.randrange(5, 60)) for _ in range(r.randrange(1, 6))]
    title = words(r, 3)
    body = "".join(f"<p>{p[:20]}<b>{p[20:30]}</b>{p[30:]}</p>" for p in paragraphs)
    html = (
        f'<!DOCTYPE html><html><head><title>{words(r, 4)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        f"<nav><ul>{''.join(f'<li><a href=x>{words(r, 1)}</a></li>' for _ in range(5))}</ul></nav><!-- ad --><div class='ad'>{words(r, 9)}</div>"
        f"<article><h1>A &amp; B&nbsp; {title}</h1>{body}</article><footer>&copy; {words(r, 6)}</footer></body></html>"
    )
    return html, "\n".join([f"A & B {title}", *paragraphs])


def plain_page(r, host):
    """No telling elements: the template's texts recur, the article's vary."""
    paragraphs = [words(r, r.randrange(20, 60)) for _ in range(r.randrange(2, 6))]
    html = (
        f"<html><body><div class='wrap'><div id='head'><a href=/>{host}</a> <a href=/a>about us</a></div><div class='sidebar'><p>{words(r, 8)}</p></div>"
        f"<div id='post-{r.randrange(999)}' class='text'><p>Printed from {host}.</p>{''.join(f'<p>{p}<p>' for p in paragraphs)}</div>"
        f"<div class='comments'><p>{words(r, 12)}</p></div><form><input value=x>search</form></div></body></html>"
    )
    return html, "\n".join(paragraphs)


@pytest.mark.parametrize("seed", [1, 2])
def test_articles_and_induced_templates(spark, scratch, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for k in range(140):
        host, make = r.choice([("one.example", article_page), ("two.example", article_page), ("plain.example", plain_page)] + [("hot.example", article_page)] * 3)
        html, want[k] = make(r, host)
        rows.append((k, f"https://user@{host.upper()}:80/p{k}?q#f", html, "x"))
    rows += [(500, "https://one.example/", None, "x"), (501, None, "", "x"), (502, None, "just text &lt;b", "x"), (503, "u", "<p>a<p>b", None)]
    rows += [(504, "https://one.example/", "<article>" + "<div>" * 400 + "deep" + "</article>", "x"), (505, "https://two.example/", "<article><p>long" + " word" * 200_000, "x")]
    rows += [(506, "https://one.example/", "<article><p>cut off <a href='x", "x"), (0, rows[0][1], rows[0][2], "x")]
    want |= {500: "", 501: "", 502: "just text <b", 503: "a\nb", 504: "deep", 505: "long" + " word" * 200_000, 506: "cut off"}
    got = H.main_text(spark.createDataFrame(rows, SCHEMA).repartition(5), scratch)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert sorted(x.page_id for x in got) == sorted(x[0] for x in rows)
    for x in got:
        assert x.text == want[x.page_id], x.page_id
        assert x.n_chars == len(x.text)


def test_empty_table(spark, scratch):
    assert H.main_text(spark.createDataFrame([], SCHEMA), scratch).count() == 0


def shape(spec):
    """('a', 'b', ('c', 'd')): a node with kids; text for a leaf."""
    if isinstance(spec, str):
        return H.Shape(spec, spec, False)
    one = H.Shape(spec[0], spec[0], False)
    one.kids = [shape(k) for k in spec[1:]]
    return one


def brute_matching(a, b):
    """The most matched nodes over all order-keeping alignments, by recursion over the lists."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute_matching(x[0], y[0]))

    return 1 + best(a.kids, b.kids)


def test_tree_matching_against_all_alignments():
    r = random.Random(3)

    def grow(depth):
        return r.choice("xyz") if depth == 0 or r.random() < 0.3 else (r.choice("xyz"), *[grow(depth - 1) for _ in range(r.randrange(1, 4))])

    for _ in range(300):
        a, b = shape(("r", grow(2), grow(2))), shape(("r", grow(2), grow(2), grow(1)))
        same = [k.label for k in a.kids] == [k.label for k in b.kids]
        assert H.matching(a, b) == brute_matching(a, b) or same
        pairs = [(p, q) for p, q in H.align(a.kids, b.kids) if p is not None and q is not None]
        assert 1 + sum(H.matching(p, q) for p, q in pairs) == H.matching(a, b)


def test_wrappers_merge_alike_in_any_grouping():
    r = random.Random(4)
    shapes = [H.page_shape(article_page(r, "h")[0])[1] for _ in range(12)]
    rows = [s.to_list() for s in shapes]
    one, other = H.Shape.from_list(rows[0]), H.Shape.from_list(rows[6])
    for k in range(1, 6):
        H.merge(one, H.Shape.from_list(rows[k]))
        H.merge(other, H.Shape.from_list(rows[6 + k]))
    H.merge(one, other)
    whole = H.Shape.from_list(rows[0])
    for row in rows[1:]:
        H.merge(whole, H.Shape.from_list(row))
    assert whole.pages == one.pages == 12
    assert [s.label for s in H.Wrapper(whole).way] == [s.label for s in H.Wrapper(one).way] == ["#root", "html", "body", "article"]


def test_outgrown_wrappers_lose_their_rarest_nodes(monkeypatch):
    monkeypatch.setattr(H, "NODES", 30)
    r = random.Random(5)
    whole = H.page_shape("<body><article><p>x</p></article></body>")[1]
    for k in range(60):
        H.merge(whole, H.page_shape(f"<body><article><p>{words(r, 3)}</p></article><div id='{words(r, 1)}'><p>y</p></div></body>")[1])
    H.prune(whole)
    assert whole.size() <= 30 and [s.label for s in H.Wrapper(whole).way][-1] == "article"


def test_template_texts_of_long_pages_in_any_grouping(spark, scratch):
    """Many texts a page and one page a task: every template text is found, whatever its hash."""
    r = random.Random(6)
    fixed = [f"fixed {words(r, 6)}" for _ in range(8)]
    rows, want = [], {}
    for k in range(12):
        own = [words(r, 12) for _ in range(60)]
        html = "".join(f"<p>{p}</p>" for p in [*fixed[:4], *own, *fixed[4:]])
        rows.append((k, "http://long.example/", f"<html><body><div class='text'>{html}</div></body></html>", "x"))
        want[k] = "\n".join(own)
    pages = spark.createDataFrame(rows, SCHEMA)
    for tasks in (12, 1):
        got = {x.page_id: x.text for x in H.main_text(pages.repartition(tasks), scratch).collect()}
        assert got == want


LAYOUTS = {
    "headline beside the text": lambda h, a, b: f"<div id=post><h1>{h}</h1><div class=entry><p>{a}</p><p>{b}</p></div></div>",
    "headline in main": lambda h, a, b: f"<main><h1>{h}</h1><div class=entry><p>{a}</p><p>{b}</p></div></main>",
    "header in main": lambda h, a, b: f"<main><header><h1><a href=x>{h}</a></h1></header><article><p>{a}</p><p>{b}</p></article></main>",
    "lead beside the text": lambda h, a, b: f"<div class=page><div class=title>{h}</div><div class=lead>{a}</div><div class=body><p>{b}</p></div></div>",
    "long terms": lambda h, a, b: f"<div id=post><h1>{h}</h1><p>{a}</p><p>{b}</p></div><div class=terms><p>{'terms ' * 400}</p></div>",
}


def test_content_holds_all_varying_text(spark, scratch):
    r = random.Random(7)
    rows, want = [], {}
    for place, make in enumerate(LAYOUTS.values()):
        for _ in range(8):
            headline, lead, text = words(r, 3), words(r, 20), words(r, 90)
            html = f"<body><div class=top>Daily paper</div>{make(headline, lead, text)}<div class=list><a href=x>{words(r, 5)}</a></div></body>"
            want[len(rows)] = "\n".join([headline, lead, text])
            rows.append((len(rows), f"http://h{place}.example/", html, "x"))
    got = {x.page_id: x.text for x in H.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch).collect()}
    for k in want:
        assert got[k] == want[k], list(LAYOUTS)[k // 8]


def test_the_way_outlasts_pruning(monkeypatch):
    monkeypatch.setattr(H, "NODES", 5)
    tree = H.page_shape("<body><div id=a><div id=b><h2>x y</h2><p>z</p></div><div id=c></div><div id=d></div></div></body>")[1]
    one = H.Wrapper.from_json(H.Wrapper(tree).to_json(), frozenset())
    assert [s.label for s in one.way] == ["#root", "body", "div.a", "div.b"] and one.tree.size() <= 8  # with what stands beside it


def test_end_tags_of_deep_elements_close_only_them():
    deep, up = "<div>" * 400, "</div>" * 400
    page = f"<div class=wrap><article>{deep}a<div>b</div>c<nav><div>menu<aside>x</aside></div></nav>{up}<p>rest</p></article></div><p>after</p>"
    root = H.parse(page)
    assert [b[1] for b in H.blocks(root)] == ["a", "b", "c", "rest", "after"]
    assert H.extract(page, None) == "a\nb\nc\nrest"


def test_template_texts_go_from_all_pages_of_a_host_or_stay_in_all(spark, scratch):
    r = random.Random(8)
    notice = words(r, 60)
    rows, want = [], {}
    for k in range(24):
        own = words(r, 400 if k % 3 == 0 else 4) if k < 12 else words(r, 4)
        url, html = ("http://some.example/", f"<p>{notice}</p><p>{own}</p>") if k < 12 else ("http://copies.example/", f"<p>{notice}</p><p>{own}</p>")
        rows.append((k, url, f"<body><div class=text>{html}</div></body>", "x"))
        want[k] = own if k < 12 else f"{notice}\n{own}"
    for k in range(24, 30):  # nothing varies
        rows.append((k, "http://same.example/", f"<body><nav>menu</nav><article><p>{notice}</p></article><div>end</div></body>", "x"))
        want[k] = notice
    got = {x.page_id: x.text for x in H.main_text(spark.createDataFrame(rows, SCHEMA).repartition(4), scratch).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p title=it's>It isn't lost at all</p><p>next</p>", "It isn't lost at all\nnext"),
        ("<p><a href=/o'brien>O Brien</a> who said it's fine</p>", "O Brien who said it's fine"),
        ("<p title = 'a > b'>one</p><p title=\"it's > x\">two</p>", "one\ntwo"),
        ("<p title=a\"b>one</p><p 'x>two</p>", "one\ntwo"),
        ("<p title='never ends>one</p><p>two</p>", "one\ntwo"),
        ("<p a=b'c=d>one</p><p a= >two</p><p =x>three</p>", "one\ntwo\nthree"),
        ("<p class=x/y hidden>gone</p><p data-x=hidden>stays</p>", "stays"),
    ],
)
def test_quotes_open_strings_only_after_an_equals_sign(html, text):
    assert H.extract(html, None) == text


def test_long_tags_are_read_in_one_go():
    many = "<p " + "a='b' c=d'e \"f\" " * 30_000 + ">one</p><p>two</p>"
    assert H.extract(many, None) == "one\ntwo"


@pytest.mark.parametrize("partitions", [1, 5, 20])
def test_names_are_confirmed_by_recurrence(spark, scratch, partitions):
    """Named sections of one article stay, elements of like names that all pages have go; the tasks' shares do not matter."""
    r = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        own = [f"own {words(r, 9)} {k}", f"more {words(r, 9)} {k}"]
        special = "<section class='copyright-law'><p>law matter</p></section><div class=social-history><p>past matter</p></div>" if k == 7 else ""
        body = f"<main><p>{own[0]}</p>{special}<p>{own[1]}</p><div class='comment-q7z'><p>said {words(r, 5)} {k}</p></div></main>"
        rows.append((k, "http://one.example/a", f"<body><div class=q0><a href=/>Home</a> <a href=/x>News {k}</a></div>{body}</body>"))
        want[k] = "\n".join([own[0], *(["law matter", "past matter"] if special else []), own[1]])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    got = {x.page_id: x.text for x in H.main_text(pages, scratch).collect()}
    assert got == want
    # a page by itself cannot tell the comments from a section of the text
    assert sum(H.extract(html, None) != want[k] for k, _, html in rows) == 40


def test_names_alone():
    article = "<article><p>one</p><section class='copyright-law'><p>two</p></section><div class='social-history'><p>three</p></div></article>"
    assert H.extract(article, None) == "one\ntwo\nthree"
    page = f"<body>{article}<div class='ad-slot'><p>buy</p></div><div class='newsletter-x9'><p>mail</p></div></body>"
    assert H.extract(page, None) == "one\ntwo\nthree"
    assert H.extract("<article><p>one</p><div class='share-buttons'><p>share</p></div><div id=comments><p>said</p></div></article>", None) == "one"
