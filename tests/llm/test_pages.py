import random
import re
from collections import Counter
from pathlib import Path

import pytest

from tessera.llm import pages

SMALL = Path("/root/testdata/sf0.01")

BODY = "<p>First, long enough to count, with commas, and words that go on for a good while so that points gather here.</p><p>Second paragraph &amp; more   text,\n with <b>bold</b><i>ness</i> and a <a href=x>link</a>.</p>"
TEXT = "First, long enough to count, with commas, and words that go on for a good while so that points gather here.\nSecond paragraph & more text, with boldness and a link."

CASES = [
    (f"<html><body><nav><ul><li><a href=/a>menu, one</a></li></ul></nav><article><h1>Title</h1>{BODY}</article><footer>foot</footer></body></html>", f"Title\n{TEXT}"),
    (f"<body><div class='sidebar'><p>{'side, ' * 60}</p></div><div id='content'>{BODY}</div><div class='comments'><p>{'nice, ' * 50}</p></div></body>", TEXT),
    (f"<body><div><div class=ad>buy, buy, buy</div>{BODY}<form><p>sign up, now</p></form></div><script>var t='</p>';</script><style>p{{}}</style></body>", TEXT),
    (f"<body><header><h1>Site</h1></header><main>{BODY}<aside>see also, this</aside></main><div class='cookie-notice'>we use, cookies</div></body>", TEXT),
    (f"<body><article>{BODY}<section class='comments'><article><p>{'reply, ' * 99}</p></article></section></article></body>", TEXT),
    ("<article><h1>One</h1><p><b>Two<br><p>Three</p></article><footer>&copy; x", "One\nTwo\nThree"),
    ("<p>a &lt;b&gt; &#233; &nbsp; c<!-- gone --> d</p>", "a <b> é c d"),
    ("plain text, no tags", "plain text, no tags"),
    ("<ul><li>one item of text, yes<li>two items of text, yes</ul>", "one item of text, yes\ntwo items of text, yes"),
    ("<table><tr><td>x, one cell</td><td>y, another</td></tr></table>", "x, one cell\ny, another"),
    ("<article><p>don't</p><p class='x y' data-a=\"a > b\">kept</p></article>", "don't\nkept"),
    (f"<body><div class='post'><p>{'Text, ' * 40}</p><div><p>{'More, ' * 40}</p></div></div><div class='related'><a href=1>x, y</a></div></body>", ("Text, " * 40).strip() + "\n" + ("More, " * 40).strip()),
    (f"<article><header><h1>In the article</h1></header>{BODY}</article>", f"In the article\n{TEXT}"),
    ("", ""),
    (None, ""),
    ("<nav>only a menu</nav>", ""),
    ("<<<>>> <p", "<<<>>>"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    assert pages.extract(page) == want


def test_nothing_is_capped():
    long = "".join(f"<p>Paragraph {i}, with text.</p>" for i in range(20_000))
    assert pages.extract(f"<article>{long}</article>").count("\n") == 19_999
    assert pages.extract("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"


def test_links_are_discounted():
    assert pages.points(200, 3, 200) == 0 and pages.points(200, 3, 0) == 6 and pages.points(1000, 0, 500) == 2


def test_rows_and_edges(spark):
    rows = [(i, f"u{i}", p, "x", -1) for i, (p, _) in enumerate(CASES)] + [(0, "again", CASES[0][0], "x", 0), (None, None, "<p>x</p>", None, 1)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["url"] != "again"}[3] == CASES[3][1]
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><article>{BODY}</article><div class=ad>buy, this</div><article>{BODY}</article></body>", f"{TEXT}\n{TEXT}"),
        (f"<body><p>A lead, before it.</p><article>{BODY}</article><p>It goes on, after.</p></body>", f"A lead, before it.\n{TEXT}\nIt goes on, after."),
        (f"<body><div id=content>{BODY}</div><article><h3><a href=1>Another story, elsewhere</a></h3></article></body>", TEXT),
        (f"<body><article><h1><a href=1>Title</a></h1><div>{BODY}</div></article></body>", f"Title\n{TEXT}"),
    ],
)
def test_named_tags_only_add_to_the_points(page, want):
    assert pages.extract(page) == want


RENAMED = {"article", "nav", "footer", "header", "aside", "main", "section"}


def neutral(page):
    """The page with sectioning tags renamed to div, and without classes."""
    page = re.sub(r"<(/?)(\w+)", lambda m: f"<{m[1]}div" if m[2] in RENAMED else m[0], page)
    return re.sub(r"\sclass=(\"[^\"]*\"|'[^']*'|\w+)", "", page)


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_points_alone_find_the_article_of_the_test_pages():
    import duckdb

    rows = [h for (h,) in duckdb.sql(f"SELECT html FROM '{SMALL}/pages.parquet'").fetchall()]
    same = sum(pages.extract(neutral(h)) == pages.extract(h) for h in rows)
    assert same >= 0.96 * len(rows)


def test_everyday_names_remove_nothing_inside():
    for name in ("follow", "legal", "print", "form", "side", "tags", "alert", "popular", "search", "register", "header", "notice"):
        assert pages.extract(f"<article>{BODY}<p class={name}>A short one, kept.</p><div class={name}>And this.</div></article>") == f"{TEXT}\nA short one, kept.\nAnd this.", name


@pytest.mark.parametrize(
    "page,want",
    [
        # A cookie notice and reader comments that bear no telling name.
        (f"<body><div><div>{BODY}{BODY}</div></div><div>We use cookies, as all do, and by going on, you accept.</div></body>", f"{TEXT}\n{TEXT}"),
        (f"<body><div>{BODY}</div><div><h3>2 Comments</h3><div><p>{'Nice, ' * 20}</p></div><div><p>{'Yes, ' * 30}</p></div></div></body>", TEXT),
        (f"<body><div>{BODY}<div><h3>Comments (2)</h3><p>{'Nice, ' * 20}</p></div></div></body>", TEXT),
        # A menu inside the article's container; a few links in a sentence stay.
        (f"<body><div>{BODY}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div></body>", TEXT),
        # The second part has points near the first's, the box beside them has not.
        (f"<body><div class=part>{BODY}{BODY}</div><div>Buy this.</div><div class=part>{BODY}</div></body>", f"{TEXT}\n{TEXT}\n{TEXT}"),
        # Equal points: the first in page order is the best, the other is kept as its sibling.
        (f"<body><div id=x>{BODY}</div><div id=y>{BODY}</div></body>", f"{TEXT}\n{TEXT}"),
        # A form around the whole page.
        (f"<body><form>{BODY}</form></body>", TEXT),
    ],
)
def test_points_decide_where_names_do_not(page, want):
    assert pages.extract(page) == want


def test_points_change_the_outcome():
    page = f"<body><div>Buy this, now.</div><div>{BODY}</div><div>Some more small print.</div></body>"
    root = pages.parse(page)
    pages.trim(root)
    assert "\n".join(pages.blocks([root])) != pages.extract(page) == TEXT


def brute_scores(root):
    """Points of every node, by its identity, from the rule: each block's run of text gives to its parent (or itself) and those above."""
    out = Counter()

    def inner(n):
        return "".join(c if isinstance(c, str) else inner(c) for c in n.children)

    def visit(n):
        parts = [(c, False) if isinstance(c, str) else (c, True) for c in n.children if isinstance(c, str) or c.tag in pages.INLINE]
        chars = commas = linked = 0
        for c, element in parts:
            stack = [(c, False)]
            while stack:
                x, link = stack.pop()
                if isinstance(x, str):
                    t = " ".join(x.split())
                    chars, commas, linked = chars + len(t), commas + t.count(","), linked + len(t) * link
                else:
                    stack += [(y, link or x.tag == "a") for y in x.children]
        if chars and n.tag not in pages.INLINE:
            gain = (1 + commas + min(chars / 100, 3)) * (1 - linked / chars)
            up, k = (n.parent if n.tag in pages.PARAGRAPHS and n.parent else n), 1
            while up is not None and k <= 5:
                out[id(up)] += gain / k
                up, k = up.parent, k + 1
        for c in n.children:
            if not isinstance(c, str):
                visit(c)

    visit(root)
    return out


def test_scores_against_brute_force():
    rng = random.Random(3)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join(rng.choice(["one,", "two", "three", "four,"]) for _ in range(rng.randrange(1, 40)))
            return f"<a href=x>{words}</a>" if rng.random() < 0.2 else words
        tag = rng.choice(["div", "section", "p", "ul", "b", "li", "blockquote", "article"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rng.randrange(1, 5)))}</{tag}>"

    for _ in range(80):
        root = pages.parse(f"<body>{tree(5)}{tree(5)}</body>")
        want = brute_scores(root)
        for n in pages.score(root):
            assert n.score == pytest.approx(want[id(n)])


PROSE = "The old mill by the river still grinds the corn of three villages, as it did before."


@pytest.mark.parametrize(
    "part",
    [
        f"<section><h2>Responses</h2><p>{PROSE}</p></section>",
        f"<div>Comments:<p>{PROSE}</p></div>",
        f"<div>This site of the old bakery still sells cookies to all who come by.<p>{PROSE}</p></div>",
        f'<section class="market-share"><p>{PROSE}</p></section>',
        f'<section id="the-banner-of-war"><p>{PROSE}</p></section>',
        f'<div class="widget review"><p>{PROSE}</p></div>',
        f'<div class="menu"><p>{PROSE}</p></div>',
        f'<div role="note"><p>{PROSE}</p></div>',
    ],
)
def test_words_and_openings_remove_no_story(part):
    got = pages.extract(f"<body><article><h1>Title</h1>{BODY}{part}{BODY}</article></body>")
    want = "\n".join(pages.blocks([pages.parse(part)]))
    assert got == f"Title\n{TEXT}\n{want}\n{TEXT}"


@pytest.mark.parametrize(
    "part",
    [
        '<div class="ad">Buy this now, and save.</div>', f'<div class="ad-slot-2"><p>{PROSE}</p></div>', f'<div class="comments"><p>{PROSE}</p></div>', f'<section id="user-comments"><p>{PROSE}</p></section>',
        '<div class="share-buttons">Share this</div>', '<div class="menu"><a href=1>One</a> <a href=2>Two</a></div>', f"<div><h3>3 Comments</h3><p>{PROSE}</p></div>", '<div class="sidebar">More to read here.</div>', '<div class="cookie-banner">We use cookies.</div>', f'<div class="newsletter signup"><p>{PROSE}</p></div>',
    ],
)
def test_furniture_in_an_article_still_goes(part):
    assert pages.extract(f"<body><article>{BODY}{part}{BODY}</article></body>") == f"{TEXT}\n{TEXT}"


def test_size_decides_nothing_about_cookies_and_comments():
    notice = f"<div>We use cookies here.<p>{'Our partners store things on your device. ' * 60}</p></div>"
    assert pages.extract(f"<body><div>{BODY * 40}</div>{notice}</body>") == "\n".join([TEXT] * 40)
    # What is most of the page is its story, whatever it is named or opens with.
    assert pages.extract(f'<body><div class="banner">{BODY * 5}</div><p>Short end.</p></body>').startswith(TEXT)
    assert pages.extract(f"<body><div>Our site is about cookies, and how to bake them.{BODY * 5}</div></body>").endswith(TEXT)


def test_a_form_around_the_story_is_its_container():
    assert pages.extract(f"<body><form>{BODY}{BODY}</form><p>Nineteen characters.</p></body>").startswith(f"{TEXT}\n{TEXT}")
    assert pages.extract(f"<body><div>{BODY}{BODY}</div><form><p>Your name, please, and your address.</p><input></form></body>") == f"{TEXT}\n{TEXT}"


def test_a_second_article_of_another_class_stays():
    assert pages.extract(f"<body><article class=a>{BODY * 6}</article><article class=b><p>{PROSE}</p></article><article class=teaser><a href=1>Another story, elsewhere</a></article></body>") == "\n".join([TEXT] * 6 + [PROSE])
    # Ties between named articles: both, in page order.
    assert pages.extract(f"<body><article>{BODY}</article><article>{BODY}</article></body>") == f"{TEXT}\n{TEXT}"
