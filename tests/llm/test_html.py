import math
import random
import time

import pytest

from sealframe.llm import html_extract

LONG = "One sentence of the article, with commas, and a full stop. " * 4


def page(inner: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inner}</body></html>"


BESIDE = [
    "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>",
    "<header><h1>The Site</h1><p>A slogan, of the site, that is not short at all, really.</p></header>",
    "<div class='sidebar'><p>" + LONG + "</p></div>",
    "<aside>" + LONG + "</aside>",
    "<div class='ad'>Buy this, buy that. Now!</div>",
    "<div id='cookie-notice'>We use cookies, as all do. Accept?</div>",
    "<form><label>Your name, please.</label><input name=x><button>Send</button></form>",
    "<div class='comments'><p>" + LONG + "</p></div>",
    "<section class='relatedPosts'><p>" + LONG + "</p></section>",
    "<footer>&copy; 2024 example.com &middot; All rights reserved.</footer>",
    "<!-- <p>no</p> --><noscript>Turn on scripts.</noscript>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div>{}</div>"])
@pytest.mark.parametrize("beside", BESIDE)
def test_article_only(wrap, beside):
    inner = f"<h2>Its heading</h2><p>{LONG}</p><p>Second &amp; last\n  <b>part</b>, he said.</p>"
    for html in (page(beside + wrap.format(inner)), page(wrap.format(inner) + beside)):
        assert html_extract.main_text(html) == f"Its heading\n{LONG.strip()}\nSecond & last part, he said."


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("no markup at all, just words.", "no markup at all, just words."),
        ("<article><p>One<p>Two<br>Three</article>", "One\nTwo\nThree"),
        ("<article><p><b>Open bold.<p>Next.</article>", "Open bold.\nNext."),
        ("<article><p>Cut off, in the mid", "Cut off, in the mid"),
        ("<article><p>x &lt; y &#233; &nbsp; z &unknown; &am</article>", "x < y é z &unknown; &am"),
        ("<article><ul><li>a, b.<li>c, d.</ul></article>", "a, b.\nc, d."),
        ("<article><div class='comment'>no</div></article>", ""),
        ("<nav>only a menu</nav>", ""),
        ("<article><h1>Short.</h1></article><div class='ad'>" + LONG + "</div>", "Short."),
    ],
)
def test_cases(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("many", [7, 90])
def test_short_blocks_beside_a_long_paragraph(many):
    cells = [str(1900 + i) for i in range(24)]
    table = "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2], strict=True)) + "</table>"
    items = [f"item {i} of it" for i in range(20)]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    html = page(f"<nav>Menu</nav><article><p>{LONG * many}</p>{table}{listed}</article><footer>Foot</footer>")
    assert html_extract.main_text(html) == "\n".join([(LONG * many).strip(), *cells, *items])


def test_links_beside_plain_divs():
    html = page("<div><a href=1>One</a> <a href=2>Two</a></div><div><p>" + LONG + "</p></div>")
    assert html_extract.main_text(html) == LONG.strip()


@pytest.mark.parametrize("name", ["sidebar no-print", "comments has-replies", "ad-slot-top", "relatedPosts", "site-notice", "alert alert-info", "legal", "cookie-banner box"])
def test_names_that_mark(name):
    html = page(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article>")
    assert html_extract.main_text(html) == LONG.strip()


@pytest.mark.parametrize("name", ["legal-text", "related-work-list", "text-alert", "search-results-analysis", "no-sidebar", "with-comments", "load-more", "story"])
def test_names_that_do_not(name):
    html = page(f"<article><p>{LONG}</p><div class='{name}'><p>Inner words, of it.</p></div></article>")
    assert html_extract.main_text(html) == f"{LONG.strip()}\nInner words, of it."


UNNAMED = [
    # No article element and no telling name: length and punctuation alone tell a list of words from the text.
    (f"<div><ul>{'<li>Home</li><li>News</li>' * 9}</ul></div><section><p>{LONG}</p><p>{LONG}</p></section>", f"{LONG.strip()}\n{LONG.strip()}"),
    # A list of links in the article.
    (f"<article><p>{LONG}</p><ul><li><a href=a>One more</a><li><a href=b>Another</a></ul></article>", LONG.strip()),
    # The article element holds a teaser only, so it is no reference for what stands beside it.
    (f"<main><p>Go on, read.</p></main><div><p>{LONG * 3}</p></div>", f"Go on, read.\n{(LONG * 3).strip()}"),
]


@pytest.mark.parametrize("inner,text", UNNAMED)
def test_ratios_decide(inner, text):
    assert html_extract.main_text(page(inner)) == text


def test_without_ratios_all_is_kept(monkeypatch):
    inner, text = UNNAMED[0]
    monkeypatch.setattr(html_extract, "fuse", lambda length, marks: length * 0 + 1.0)
    assert "Home" in html_extract.main_text(page(inner)) and "Home" not in text


def test_linked_text_of_an_article_stays():
    inner = f"<article><p>{LONG}</p><ul><li><a href=a>A whole sentence, that is linked.</a><li><a href=b>Another one, as long.</a></ul></article>"
    assert html_extract.main_text(page(inner)) == f"{LONG.strip()}\nA whole sentence, that is linked.\nAnother one, as long."


def brute_scores(found):
    """Smoothed and fused ratios of blocks (path, text), each path as the list of its steps, by going over all blocks for each."""

    def ratio(chosen):
        texts = [t for p, t in found if chosen(p)]
        return [sum(map(len, texts)) / max(len(texts), 1), sum(len(html_extract.PUNCTUATION.findall(t)) for t in texts) / max(len(texts), 1)]

    out = {}
    for path in {tuple(p) for p, _ in found}:
        near = [(1.0, ratio(lambda p, path=path: tuple(p) == path))]
        for level in range(1, html_extract.LEVELS):
            if level <= len(path):
                top = path[: len(path) - level]
                near.append((math.exp(-0.5 * (level / html_extract.SMOOTHING) ** 2), ratio(lambda p, top=top: tuple(p[: len(top)]) == top)))
        length, marks = (sum(k * r[i] for k, r in near) / sum(k for k, _ in near) for i in (0, 1))
        out[path] = math.log1p(length) * (1 + math.log1p(marks))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    found = []

    def made(steps):
        html = ""
        for _ in range(rng.randrange(1, 5)):
            text = " ".join(rng.choice(["word", "and,", "so.", "longer", "why?"]) for _ in range(rng.randrange(1, 30)))
            if rng.random() < 0.5:
                found.append((steps, text))
                html += f"{text}<br>"
            elif len(steps) < 7:
                tag = rng.choice(["div", "section", "blockquote"])
                html += f"<{tag}>{made([*steps, tag])}</{tag}>"
        return html

    page = html_extract.parse(f"<html><body>{made(['html', 'body'])}</body></html>")
    assert [t for _, t, _ in page.found] == [t for _, t in found]
    if found:
        score, reference = html_extract.path_scores(page)
        want = brute_scores(found)
        assert all(score[x[0]] == pytest.approx(want[tuple(p)]) for x, (p, _) in zip(page.found, found, strict=True))
        assert reference == pytest.approx(max(want.values()))


@pytest.mark.parametrize(
    "html",
    [
        "<div>word " * 50_000,
        "<article>" + "<div>word, word. " * 50_000,
        "<b>" * 50_000 + "<p>x</p>" * 50_000,
        "<p>a<!--" * 50_000 + ">",
        "<p title='" * 50_000 + ">",
        "<span>" * 50_000 + "</a>" * 50_000,
        "<article><p>" + "One of the many words, it is. " * 40_000,
    ],
)
def test_deep_and_long_pages(html):
    began = time.time()
    html_extract.main_text(html)
    assert time.time() - began < 15


def test_unfinished_markup():
    assert html_extract.main_text("<article><p>One, two.</p><p>Three &lt; four.</p><!-- never <p>closed") == "One, two.\nThree < four."
    assert html_extract.main_text("<article><p>One, two.</p><a href='x") == "One, two."
    assert html_extract.main_text("<script>var s = '<!--';</script><article><p>One, two.</p></article>") == "One, two."


def test_table(spark):
    rows = [(1, "u", "<article><p>Hi.</p></article>", "x"), (1, "u", "<article><p>Hi.</p></article>", "x"), (2, None, None, None), (None, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_extract.extract(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(None, "", 0), (1, "Hi.", 3), (1, "Hi.", 3), (2, "", 0)]
    assert html_extract.extract(pages.where("false")).count() == 0
