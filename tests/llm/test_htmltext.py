import pytest

from weftmine.llm import htmltext

PAGES = "page_id long, url string, html string"
TREE = htmltext.learned()
ARTICLE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style>
<script>var t="</p>";track(0);</script></head><body class="has-sidebar"><nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav><!-- ad 0 -->
<div class="ad">Buy this and that and more of it now.</div><div id="cookie-notice"><p>We use cookies to make this page better for all who read it every day.</p></div>
<article><h1>A title &amp; more</h1><p><b>First line<br>goes   on&nbsp;here.<p>Of.</p><form><label>Mail</label><input></form><p>Third &lt;one&gt; &#233;&eacute;.</p><aside><p>Read this other piece too, it is long enough to look like prose.</p></aside><ul><li>item one<li>item two</ul></article>
<section class="comments"><h2>Comments</h2><article class="comment"><p>I have read this whole thing and it is very good indeed, thanks to all.</p></article></section>
<footer>&copy; example &middot; All that is left to say goes here at the end of the page.</footer></body></html>"""
WANT = "A title & more\n\nFirst line goes on here.\n\nOf.\n\nThird <one> éé.\n\nitem one\n\nitem two"


def test_an_article():
    assert htmltext.main_text(ARTICLE, TREE) == WANT


def test_the_table_is_learnt():
    x, y = htmltext.examples()
    assert ((htmltext.shares(TREE, x) >= 0.5) == (y == 1)).all()


def outcomes(tree, row):
    """All outcomes that a block with these hints may have, whatever its words and links; and whether its own is reached by words and links alone."""
    if not isinstance(tree, htmltext.Split):
        return {tree >= 0.5}, True
    sides = [outcomes(side, row) for side in (tree.below, tree.above)]
    own = sides[int(row[tree.feature] >= tree.at)]
    if tree.feature >= htmltext.TEXT:
        return own[0], False
    return sides[0][0] | sides[1][0], own[1]


def test_words_and_links_decide_most_blocks():
    import duckdb

    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    found = [outcomes(TREE, row) for (page,) in rows for row in htmltext.features(htmltext.blocks(page))]
    alone, open_ = sum(a for _, a in found), sum(len(o) > 1 for o, _ in found)
    assert TREE.feature < htmltext.TEXT
    assert len(found) > 4000 and alone > 0.25 * len(found) and open_ > 0.5 * len(found)
    assert sum(a or len(o) > 1 for o, a in found) > 0.85 * len(found)


def made_up(r):
    """A page of parts in page order, each (html, its main text blocks)."""
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé&<") for _ in range(r.randint(1, 9)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    links = "".join(f"<li><a href='/{i}'>{safe(word())}</a>" for i in range(r.randint(4, 9)))
    main, body = [], []
    for kind in ["h1", "p", *r.choices(["p", "p", "p", "short", "h2", "list", "link"], k=r.randint(3, 9)), "p"]:
        if kind == "link":  # between paragraphs
            lines = [prose(26, 60), prose(2, 9), prose(26, 60)]
            body.append(f"<p>{safe(lines[0])}</p><p><a href='/x'>{safe(lines[1])}</a></p><p>{safe(lines[2])}</p>")
        else:
            lines = [prose(*{"h1": (3, 9), "h2": (2, 6), "p": (26, 90), "short": (1, 5), "list": (12, 25)}[kind]) for _ in range(3 if kind == "list" else 1)]
            texts = [safe(t).replace(" ", r.choice([" ", "\n  ", "&nbsp;"]), 1) for t in lines]
            body.append("<ul>" + "".join(f"<li>{t}" for t in texts) + "</ul>" if kind == "list" else f"<{kind}>{texts[0]}</{kind}>" if kind != "short" else f"<p>{texts[0]}")
        main += lines
    article = "".join(body)
    whole = r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div role='main'>{}</div>", "<div class='no-sidebar with-footer'>{}</div>", "<div class='comments-open'><article>{}</article></div>", "<div id=content>{}</div>"])
    around = [
        (f"<nav><ul>{links}</ul></nav>", f"<div><ul>{links}</ul></div>", f"<header><ul>{links}</ul></header>"),
        (f"<div class='ad'>{safe(prose(5, 30))}</div>", f"<div id='cookie-notice'><p>{safe(prose(9, 30))}</p></div>", ""),
        (f"<script>var x = '<p>{prose(1, 3)}</p>'</script>", "<style>p { margin: 0 }</style>", f"<!-- <p>{prose(2, 5).replace('-', '')}</p> -->"),
    ]
    after = [
        (f"<aside><h3>More</h3><p>{safe(prose(20, 60))}</p></aside>", ""),
        (f"<section class='comments'><h2>Comments</h2><article class='comment'><p>{safe(prose(5, 40))}</p></article></section>", ""),
        (f"<form><label>{safe(prose(1, 4))}</label><input></form>", ""),
        (f"<footer>&copy; {safe(prose(3, 25))}</footer>", f"<div class='footer'><p>{safe(prose(3, 25))}</p></div>"),
    ]
    pick = lambda parts: "".join(r.choice(p) for p in parts)
    return f"<html><head><title>{safe(word())}</title></head><body>{pick(around)}{whole.format(article)}{pick(after)}</body></html>", "\n\n".join(main)


@pytest.mark.parametrize("seed", range(60))
def test_made_up_pages(seed):
    import random

    page, want = made_up(random.Random(seed))
    assert htmltext.main_text(page, TREE) == want


def test_an_article_that_is_only_a_card():
    page = "<article><h3>Card</h3></article>" + "".join(f"<p>{PROSE} {PROSE}</p>" for _ in range(3))
    assert htmltext.main_text(page, TREE).endswith("\n\n".join([f"{PROSE} {PROSE}"] * 3))


def test_link_lists_in_an_article():
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(6))
    assert htmltext.main_text(f"<article><p>{PROSE}</p><ul>{links}</ul></article>", TREE) == PROSE


def test_a_page_without_an_article():
    links = "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(8))
    prose = "This is a paragraph of prose with quite a few words in it, so that it looks like main text. " * 2
    page = f"<div><ul>{links}</ul></div><div><h2>Heading</h2><p>{prose}</p><p>{prose}</p><p>Short one.</p><p>{prose}</p></div><div><ul>{links}</ul></div><div class='page-footer'>{prose}</div>"
    got = htmltext.main_text(page, TREE).split("\n\n")
    assert got == ["Heading", prose.strip(), prose.strip(), "Short one.", prose.strip()]


PROSE = "This is a paragraph of prose with quite a few words in it, so that it looks like main text."


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><article><p>{0}</p></article></div>",
        "<div class='sidebar-layout'><article><p>{0}</p></article></div>",
        "<article class='post comments-open'><p>{0}</p></article>",
        "<div class='no-header'><p>{0}</p></div>",
        "<div class='page-widget'><p>{0}</p></div><div class='footer'>All the rest.</div>",
        "<article><section id='related-work'><p>{0}</p></section></article><section class='comments'><article class='comment'><p>{0} {0}</p></article></section>",
        "<article><section id='sharing-data'><p>{0}</p></section></article>",
    ],
)
def test_names_that_only_tell_of_other_elements(page):
    assert htmltext.main_text(page.format(PROSE), TREE) == PROSE


@pytest.mark.parametrize("html", [None, "", "<", "<p", "plain", "<article><p>a<b>b</p>c</i></article></div>", "<!-- open", "<script>x", "</p></p><nav>a", "<p>" * 5000 + "x", "<div>" * 3000, "&#xfffffff; &bad; &amp", "\0<p\0>x"])
def test_damaged_pages(html):
    assert isinstance(htmltext.main_text(html, TREE), str)


@pytest.mark.parametrize("page", ["<div class=ad>" * 200_000 + "x", "<div class=ad>" * 100_000 + "<article><p>x", "<form><div id=ads>" * 50_000 + "<p>x</p>" * 50_000])
def test_deep_nesting_takes_memory_in_proportion(page):
    import tracemalloc

    tracemalloc.start()
    found = htmltext.blocks(page)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert {b.text for b in found} == {"x"} and most < 150e6


def test_whole_table_with_nulls_ties_and_clashing_names(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (2, "v", ""), (3, "w", "<article>" + "<p>word</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], PAGES + ", text string, n_chars int")
    got = sorted(map(tuple, htmltext.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (None, None, "", 0), (2, "v", "", 0), (3, "w", "\n\n".join(["word"] * 20000), 6 * 20000 - 2)], key=str)
    assert htmltext.extract(spark.createDataFrame([], PAGES)).collect() == []
