import random

import pytest
from llm_fixtures import prose

from seqtok.llm import html_extract as hx

pytest_plugins = ["llm_fixtures"]

PROSE = prose(3, 120)

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head>
<body><nav><ul><li><a href="/x>y">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First
  para<br>goes&nbsp;on<p>Second <i>one</i>, &lt;b&gt;<ul><li>a<li>b</ul><form>q<input></form>
<section class="reader comments"><p>nice post</p></section></article>
<aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_article_blocks():
    assert hx.extract(PAGE) == "Head & line\n\nFirst para goes on\n\nSecond one, <b>\n\na\n\nb"


def test_broken_pages():
    assert hx.extract(None) == "" and hx.extract("") == "" and hx.extract("<nav>x</nav>") == ""
    assert hx.extract("plain text") == "plain text"
    assert hx.extract("<article><p>cut off &am") == "cut off &am"
    assert hx.extract("<article><p>cut off</p><p cla") == "cut off"
    assert hx.extract("<article><p>a < b and 3 <4</p></article>") == "a < b and 3 <4"
    assert hx.extract("<article></div></p>x</article>y") == "x"
    assert hx.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert hx.extract("<p>" + "x " * 200_000).count("x") == 200_000


def _stm(a, b):
    """Simple tree matching by its definition: a table over all pairs of children."""
    if a.sig != b.sig:
        return 0
    x, y = list(a.kids.values()), list(b.kids.values())
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + _stm(x[i - 1], y[j - 1]))
    return best[-1][-1] + 1


def _pairs(pairs):
    return sum(1 + _pairs(inner) for _, _, inner in pairs)


def test_tree_matching_equals_its_definition():
    rng = random.Random(4)
    tags = ["div", "p", "h2", "ul", "li", "section"]

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(tags, k=rng.randrange(5)))

    for _ in range(150):
        a, b = (hx.shape(hx.parse(page(3))) for _ in range(2))
        score, pairs = hx.tree_match(a, b)
        assert score == _stm(a, b) == _pairs(pairs) + 1
    many = [hx.shape(hx.parse("".join(f'<p class="c{i}">{i}</p><h2>x</h2>' for i in range(8000)))) for _ in range(2)]
    assert hx.tree_match(*many)[0] == 8002
    packed = hx.pack_tree(many[0])
    assert hx.pack_tree(hx.unpack_tree(packed)) == packed


def test_constant_texts_become_template_and_slots_stay():
    shell = "<body><div id=top>Site name</div><div class=body><p>{}</p><p>{}</p></div><div>All rights</div></body>"
    pages = [shell.format(f"text {i}", f"more {i}") for i in range(5)]
    wrapper = hx.induce(pages)
    assert hx.extract(pages[0], wrapper) == "text 0\n\nmore 0"
    assert hx.extract(pages[0]) == "Site name\n\ntext 0\n\nmore 0\n\nAll rights"
    assert not hx.induce(pages[:1]).constant and not hx.induce([]).constant


def test_a_constant_text_beside_a_varying_like_sibling_goes():
    pages = [f"<body><p>Subscribe to our daily mail</p><p>text {i} of the page</p></body>" for i in range(8)]
    assert hx.extract(pages[3], hx.induce(pages)) == "text 3 of the page"


def test_copies_of_a_page_are_no_template():
    copies = [f"<body><p>{PROSE}</p></body>"] * 8
    assert hx.extract(copies[0], hx.induce(copies)) == PROSE
    words = PROSE.split()
    near = ["<body><p>" + " ".join([*words[:i], f"edit{i}", *words[i + 1:60]]) + "</p><p>" + " ".join(words[60:]) + "</p></body>"
            for i in range(20)]
    others = [f"<body><p>{' '.join(f'{w}{i}' for w in words)}</p></body>" for i in range(20)]
    wrapper = hx.induce(others + near)
    assert hx.extract(near[5], wrapper).endswith(" ".join(words[60:]))


def test_the_wrapper_decides_inside_an_article_too():
    page = "<body><article><p>Share this story</p><p>{}</p></article></body>"
    pages = [page.format(" ".join(f"word{i}x{k}" for k in range(30))) for i in range(12)]
    assert hx.extract(pages[1], hx.induce(pages)).startswith("word1x0")
    some = [p if i < 8 else p.replace("Share this story", f"lead {i}") for i, p in enumerate(pages)]
    assert hx.extract(some[1], hx.induce(some)).startswith("Share this story")      # on 8 of 12 pages: stays
    few = pages[:4]
    assert hx.extract(few[1], hx.induce(few)).startswith("Share this story")        # too few pages to tell


def test_a_teaser_article_does_not_replace_the_main_text():
    page = f"<body><div><p>{PROSE}</p></div><article>teaser</article></body>"
    assert hx.extract(page) == f"{PROSE}\n\nteaser"


def test_deep_menus_regions_and_odd_elements():
    assert hx.extract("<div>" * 160 + "<nav>menu</nav>text" + "</div>" * 160) == "text"
    text = f"<article><p>{PROSE}</p>{{}}</article>"
    for part, kept in (('<p class="search-results">found it</p>', True), ('<div class="social-policy">policy</div>', True),
                       ('<div class="responses"><p>me too</p></div>', False), ('<div id="comments-section">hi</div>', False),
                       ('<p>x <math><mi>a</mi><mo>=</mo></math></p>', True)):
        assert (len(hx.extract(text.format(part))) > len(PROSE)) == kept, part
    assert hx.extract("<p>before<svg><text>no</text></svg>after</p>") == "before after"
    assert hx.extract("<p>see <math><mi>a</mi><mo>=</mo></math></p>") == "see a="


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_over_a_table(shipped, monkeypatch, limit):
    monkeypatch.setattr(hx, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(hx, "ROWS_PER_SALT", 4)
    shell = "<body><div id=top>Site {h}</div><div class=body><p>text {i}</p></div></body>"
    rows = [(i, f"http://h{i % 3}.com/{i}", shell.format(h=i % 3, i=i), "x") for i in range(30)]
    rows += [(100, "http://h0.com/a", None, "x"), (101, None, "<p>no url", "x"), (102, "http://h1.com/", "", "x"),
             (3, rows[3][1], rows[3][2], "x"), (None, "http://solo.com", "<p>alone", "x")]
    df = shipped.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in hx.extract_pages(df).collect())
    want = [(str(i), f"text {i}", len(f"text {i}")) for i in [*range(30), 3]]
    want += [("100", "", 0), ("101", "no url", 6), ("102", "", 0), ("None", "alone", 5)]
    assert got == sorted(want)
    assert hx.extract_pages(df.limit(0)).collect() == []


def test_words_of_class_do_not_take_the_main_text():
    text = "long main text of the page " * 4
    want = text.strip()
    for open_, close in (('<main class="with-sidebar">', "</main>"), ('<article class="post no-comments">', "</article>"),
                         ('<div id="header-and-body"><article class="social">', "</article></div>"),
                         ('<div class="notice-board">', "</div>"), ('<section id="search-results"><p>', "</section>"),
                         ('<div class="no-comments"><main>', "</main></div>")):
        assert hx.extract(f'<body><div class="ad">Buy</div>{open_}{text}{close}</body>') == want, open_
    page = f'<main><p>{text}</p><div class="share">Share this</div><div role="alert">{text}</div></main>'
    assert hx.extract(page) == want
    notes = [f'<body><div class="cookie-notice">{text}</div><div>{i}</div></body>' for i in range(4)]
    assert hx.extract(notes[0], hx.induce(notes)) == "0"


def test_template_tree_is_merged_from_all_pages(spark, shipped, monkeypatch):
    # a part that only some of 40 pages have is a place of the template, wherever their hashes fall
    pages = [f"<body><h1>t{i}</h1><div class=p{i}>x{i}</div>" + ("<section>s</section>" if i % 13 == 5 else "") for i in range(40)]
    df = spark.createDataFrame([(i, "http://a.org/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for limit in (1000, 7):                # one group, and groups merged in rounds
        monkeypatch.setattr(hx, "MERGE_TREES", limit)
        rows = hx._template_trees(hx._hosts(df, "url", "html")).collect()
        assert len(rows) == 1 and rows[0]["__n"] == 40
        assert "section" in rows[0]["__tree"] and all(f"div.p{i}\"" in rows[0]["__tree"] for i in range(40))
