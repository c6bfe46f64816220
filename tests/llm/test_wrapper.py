import random

import pytest

from quarrylens.llm import queries, wrapper

SCHEMA = "page_id long, url string, html string"


def text(html, template=()):
    return wrapper.main_text(wrapper.Page(html), set(template))


@pytest.mark.parametrize(
    "html, expected",
    [
        ("", ""),
        ("plain  words\n here", "plain words here"),
        ("<nav>menu</nav><article><h1>A&amp;B</h1><p>x<b>y</b> z<p>second&nbsp;one</article><footer>f</footer>", "A&B\n\nxy z\n\nsecond one"),
        ('<article><script>var t="</p>";</script><p>a<!-- no --> b</p><style>p{}</style></article>', "a b"),
        ('<div class="ad">buy</div><div id="sidebar">s</div><div class="post-content"><p>real</p></div><div class="comments"><p>me too</p></div>', "real"),
        ("<article><p>one<br>two</p><form><p>name</p></form><aside>s</aside><ul><li>i<li>j</ul></article>", "one two\n\ni\n\nj"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>b</p></article>", "T\n\nb"),
        ('<div id="header"><h1>Site</h1></div><div id="main-header">x</div><div id="main"><div class="entry-header"><h1>T</h1></div><p>b</p></div>', "T\n\nb"),
        ('<article><section class="reader-comments"><article><p>a reply that is longer than the text</p></article></section><p>b</p></article>', "b"),
        ('<div role="navigation">n</div><div class="cookie-notice">c</div><td class="side"><p>s</p></td><main><article><p>b</p></article></main>', "b"),
        ("<header><h1>Site</h1></header><main><p>b</p></main>", "b"),
        ("<article>cut off <b", "cut off"),
        ("<article><p>a</article><article><p>the longer one</article>", "a\n\nthe longer one"),
        ('<div class="content-lead"><p>lead</p></div><p>x</p><div class="content-body"><p>body of it</p></div>', "lead\n\nbody of it"),
        ('<h1>T</h1><div class="entry-content"><p>b</p></div><h1>later</h1>', "T\n\nb"),
        ('<h1>Site</h1><article><h1>T</h1><p>b</p></article>', "T\n\nb"),
        ("<main><p>the text of the page, all of it</p><article><p>see too</p></article></main>", "the text of the page, all of it\n\nsee too"),
        ("<main><p>skip</p><article><p>the text of the page, all of it</p></article></main>", "the text of the page, all of it"),
        ('<article><p hidden>h</p><p style="display: none">n</p><p>v</p></article>', "v"),
        ("<p>1 &lt; 2 &#233; &#x41;</p>", "1 < 2 é A"),
        # inline elements that are never closed, or close nothing
        ("<article><div><label>x</div><p>Main text here</p></article>", "Main text here"),
        ("<article><p>Before</p><button>Share<p>Main text here</p></article>", "Before\n\nMain text here"),
        ("<article><p>a <button>Share <button>Like</button> b</p><p>c</label> d</p></article>", "a b\n\nc d"),
        ("<article><button><p>Share</p></button><p>a<select><option>x</select>b</p></article>", "a\n\nb"),
        # names that what they name overrules
        ("<div class='related'><article><p>Real body</p></article></div>", "Real body"),
        ("<div class='ad-free post'><p>Real body</p></div>", "Real body"),
        ("<article class='widget'><div class='article-notice'><p>Real body</p></div></article>", "Real body"),
        ("<main><h1>T</h1><div class='share-price'><p>Market text</p></div></main>", "T\n\nMarket text"),
        ("<main><p>Body</p><div class='share'><p><a href='/'>Share this with everybody that you know</a></p></div></main>", "Body"),
        ("<div class='ad'><p>buy</p></div><div class='comments post'><p>first</p></div>", ""),
    ],
)
def test_main_text(html, expected):
    assert text(html) == expected


@pytest.mark.parametrize("depth", [3, 251, 252, 4000])
def test_what_goes_goes_at_any_depth(depth):
    page = "<article>" + "<div>" * depth + "<nav><ul><li>MENU</nav><p>main" + "</div>" * depth + "</article>"
    assert text(page) == "main"
    match = wrapper.Matcher()
    a, b = wrapper.Page(page), wrapper.Page(page.replace("<p>main", "<p>main<p>more"))
    assert match.score(a.root, b.root) == a.root.size


def test_deep_and_long_pages():
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


def brute(a, b):
    """Simple tree matching by the definition."""
    if a.tag != b.tag:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute(x, y))
    return 1 + m[-1][-1]


@pytest.mark.parametrize("cells", [wrapper.CELLS, 4])
def test_matching_is_the_largest_there_is(cells, monkeypatch):
    monkeypatch.setattr(wrapper, "CELLS", cells)
    rng = random.Random(1)

    def tree(depth):
        tag = rng.choice(["div", "section", "p"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4) if depth and tag != "p" else 0)) + f"</{tag}>"

    for _ in range(60):
        a, b = (wrapper.Page("<main>" + tree(3) + tree(3) + "</main>").root for _ in range(2))
        match = wrapper.Matcher()
        assert match.score(a, b) == brute(a, b) == len(list(match.pairs(a, b)))


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shop(k):
    return f'<body><div><p>Call us now</p><p>Story number {k} of many</p><p>Free delivery</p><p>More on {k}</p></div></body>'


def test_constant_slots_are_template(spark):
    rows = [(k, f"http://shop.example/{k}", shop(k)) for k in range(8)] + [(90, "http://other.example/1", shop(90)), (91, None, shop(91)), (92, "http://shop.example/x", None)]
    got = {r.page_id: r.text for r in wrapper.extract(pages(spark, rows)).collect()}
    assert all(got[k] == f"Story number {k} of many\n\nMore on {k}" for k in range(8))
    assert got[90] == "Call us now\n\nStory number 90 of many\n\nFree delivery\n\nMore on 90" and got[92] == ""


NOTICE = "This long notice stands on every page of the site, whatever the page is about. " * 6


def neutral(k):
    """A page whose elements and names tell nothing."""
    rng = random.Random(k)
    story = "".join(f"<div>{' '.join(rng.choice('red green blue one two three'.split()) for _ in range(rng.randint(8, 20)))} {k}.{j}</div>" for j in range(rng.randint(2, 5)))
    return f"<body><div><div>Home</div><div>Shop</div></div><div>{NOTICE}</div><div>{story}</div><div><div>Imprint</div></div></body>", story


def test_votes_decide_on_neutral_markup(spark):
    rows = [(k, f"http://n.example/{k}", neutral(k)[0]) for k in range(12)]
    # the least pages are empty, null, or of a layout of their own
    odd = [(-3, "http://n.example/e", ""), (-2, "http://n.example/n", None), (-1, "http://n.example/f", "<body><table><tr><td>front</td></tr></table></body>")]
    got = {r.page_id: r for r in wrapper.extract(pages(spark, rows + odd)).collect()}
    for k in range(12):
        assert got[k].text == neutral(k)[1].replace("</div><div>", "\n\n").removeprefix("<div>").removesuffix("</div>")
        assert got[k].n_template == 4
    assert [got[k].text for k in (-3, -2, -1)] == ["", "", "front"]


def test_each_layout_has_its_own_template(spark):
    def other(k):
        return f"<body><table><tr><td>Menu</td><td><p>Entry {k} of the list</p></td><td>Contact</td></tr></table></body>"

    rows = [(k, "http://n.example/", neutral(k)[0]) for k in range(6)] + [(k, "http://n.example/", other(k)) for k in range(10, 14)]
    got = {r.page_id: r.text for r in wrapper.extract(pages(spark, rows)).collect()}
    assert all("Home" not in got[k] and "notice" not in got[k] for k in range(6)) and all(got[k] == f"Entry {k} of the list" for k in range(10, 14))


def test_near_copies_do_not_vote(spark):
    body = "".join(f"<p>Paragraph {j} of one article that many pages have.</p>" for j in range(8))
    rows = [(k, "http://h.example/a", f"<article>{body}<p>Only on page {k}</p></article>") for k in range(6)]
    assert all("Paragraph 7" in r.text for r in wrapper.extract(pages(spark, rows)).collect())


def test_query_like_the_definition(spark, data):
    """All steps again, page by page, on the test pages."""
    rows = [(r.page_id, r.url, r.html or "") for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    host = {r.url: r.host for r in spark.createDataFrame([(u,) for _, u, _ in rows], "url string").select("url", wrapper.host_of("url").alias("host")).collect()}
    groups = {}
    for page_id, url, html in sorted(rows):
        page = wrapper.Page(html)
        if any(n.own() for n in page.nodes):
            groups.setdefault(host[url], {}).setdefault(page.layout(), []).append((page_id, html))
    expected = {}
    for page_id, url, html in rows:
        page, of = wrapper.Page(html), groups.get(host[url], {})
        if not of:
            expected[page_id] = wrapper.main_text(page, set())
            continue
        main = max(of, key=lambda k: (len(of[k]), k))
        by = page.layout() if len(of.get(page.layout(), ())) >= wrapper.VOTERS else main
        voters = [p for k in of if (k if len(of[k]) >= wrapper.VOTERS else main) == by for p in of[k]]
        reference = wrapper.Reference(of[by][0][1])
        votes = {}
        for _, source in voters:
            for k, alike in reference.votes(wrapper.Page(source), wrapper.Matcher()):
                votes.setdefault(k, []).append(alike)
        constant = {k for k, v in votes.items() if len(v) >= wrapper.VOTERS and sum(v) >= wrapper.ALIKE * len(v)}
        expected[page_id] = wrapper.main_text(page, reference.template(page, wrapper.Matcher(), constant))
    got = queries.op6_wrapper(spark, data).collect()
    assert {r.page_id: r.text for r in got} == expected and all(r.n_chars == len(r.text) for r in got)


def test_copies_on_a_host_do_not_vanish(spark):
    rows = [(k, "http://h.example/a", "<article><h1>Same title</h1><p>The same text.</p></article>") for k in range(6)]
    assert {r.text for r in wrapper.extract(pages(spark, rows)).collect()} == {"Same title\n\nThe same text."}


def test_empty_table_nulls_repeats_and_clashes(spark):
    assert wrapper.extract(pages(spark, [])).collect() == []
    from pyspark.sql import functions as F

    rows = [(None, "http://h/", "<p>a"), (None, "http://h/", "<p>a"), (1, "", "<p>b"), (2, None, None)]
    df = pages(spark, rows).withColumns({"text": F.lit("x"), "host": F.lit("y"), "__html": F.lit("z"), "block": F.lit(1)})
    assert sorted((repr(r.page_id), r.text) for r in wrapper.extract(df).collect()) == [("1", "b"), ("2", ""), ("None", "a"), ("None", "a")]


def test_hosts(spark):
    df = spark.createDataFrame([("HTTP://User@WWW.Example.com:80/x",), ("//cdn.net/y",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in df.select(wrapper.host_of("url")).collect()] == ["www.example.com", "cdn.net", "", ""]
