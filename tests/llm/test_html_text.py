import numpy as np
import pytest

from keystrata.llm import html_text as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def net():
    return H.train()


def texts(page):
    return [b.text for b in H.blocks_of(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("<p>a &amp; b&nbsp;c\n d</p><p>e", ["a & b c d", "e"]),
        ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
        ("<p>one<br>two<br><br>three</p>", ["one two", "three"]),
        ("<script>var p='<p>no</p>';</script><style>p{}</style><p>yes</p><noscript>no</noscript>", ["yes"]),
        ("<!-- <p>no</p> --><p>1 < 2 &lt; 3</p>", ["1 < 2 < 3"]),
        ("<p>kept</p><!-- open <p>gone</p>", ["kept"]),
        ("<ul><li>a<li>b</ul><P CLASS=x>C</P>", ["a", "b", "C"]),
        ("<p>a <b>bold</b> and <a href='x>y'>link</a>.</p>", ["a bold and link."]),
        ("</div></p>text", ["text"]),
        ('<header><svg class="logo"/></header><p>kept</p><svg a="x/>"><text>no</text></svg><p>too</p>', ["kept", "too"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=a>fallback</object><template><p>in</p></template>", ["so x=2 holds", "fallback", "in"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_all_names_of_an_attribute_count():
    names = " ".join(f"u{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5))
    assert ".sidebar" in H.blocks_of(f'<div class="{names} sidebar"><p>x</p></div>')[0].path


HAND_MADE = [
    (
        """<html><body><header><a href="/">My Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
        <main><article><h1>Growing tomatoes</h1><p>Tomatoes need sun, water and patience; start the seeds indoors in March.</p>
        <div class="ad">Buy cheap pots now!</div><p>Plant them outside after the last frost, and keep the soil moist.</p></article>
        <section class="comments"><h3>Comments</h3><p>Great article, thanks a lot!</p></section></main>
        <footer><p>&copy; 2024 My Site</p></footer></body></html>""",
        ["Growing tomatoes", "Tomatoes need sun, water and patience; start the seeds indoors in March.", "Plant them outside after the last frost, and keep the soil moist."],
    ),
    (
        """<body><div class="cookie-notice">We use cookies. <button>Accept</button></div><div id="sidebar"><h3>Related</h3><ul><li><a href=1>Other story</a></li></ul></div>
        <article class="post"><h1>Council votes</h1><p>The council voted on Tuesday to repair the old bridge over the river.</p><blockquote><p>It was about time, said the mayor.</p></blockquote><p>Work begins in June.</p></article>
        <form class="newsletter"><p>Subscribe to our newsletter</p></form></body>""",
        ["Council votes", "The council voted on Tuesday to repair the old bridge over the river.", "It was about time, said the mayor.", "Work begins in June."],
    ),
]


@pytest.mark.parametrize("k", range(len(HAND_MADE)))
def test_hand_labelled_pages(spark, net, k):
    page, want = HAND_MADE[k]
    got = H.extract(spark.createDataFrame([(k, "u", page)], "page_id long, url string, html string"), net).first()
    assert got.text.split("\n") == want


def test_articles_of_the_table_against_their_markup(spark, net):
    """Every plain paragraph of an article element stays, short furniture goes."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r.text.split("\n") for r in H.op7_html_text(spark, "/root/testdata/sf0.01").collect()}
    kept = total = 0
    for r in rows:
        for body in re.findall(r"<article\b[^>]*>(.*?)</article>", r.html or "", re.S):
            for p in re.findall(r"<p>([^<]{40,})</p>", body):
                total += 1
                kept += " ".join(H.html.unescape(p).split()) in found[r.page_id]
        for nav in re.findall(r"<(?:nav|footer)\b[^>]*>(.*?)</(?:nav|footer)>", r.html or "", re.S):
            for item in re.findall(r"<li>\s*<a[^>]*>([^<]+)</a>\s*</li>", nav):
                assert " ".join(H.html.unescape(item).split()) not in found[r.page_id]
    assert total > 500 and kept >= 0.99 * total


def test_deep_and_long_pages(net):
    import time

    began = time.time()
    deep = H.blocks_of("<div>" * 30_000 + "x" + "<p>y</p></div>" * 30_000)
    assert len(deep) == 30_001 and time.time() - began < 20
    pages = [H.blocks_of("<article>" + "<p>some words of an article here.</p>" * 40_000), H.blocks_of("<p>short</p>"), H.blocks_of("")]
    prob = net.label(pages)
    assert [len(p) for p in prob] == [40_000, 1, 0] and (prob[0] >= 0.5).all()


def test_state_is_handed_on(net, monkeypatch):
    pages = [H.blocks_of("<nav><p>home</p></nav>" + "<article>" + "<p>one two three. </p>" * n + "</article><footer>end</footer>") for n in (3, 50, 200)]
    whole = net.label(pages)
    monkeypatch.setattr(H, "CELLS", 7)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, net.label(pages)))


def test_gradient_is_the_slope_of_the_loss():
    net, r = H.Labeller.fresh(3), np.random.default_rng(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.standard_normal((3, 5, H.PATH_DIM + H.WORD_DIM + H.RATIOS))
    mask, y = np.ones((3, 5)), r.integers(0, 2, (3, 5)).astype(float)
    mask[1, 3:] = 0

    def loss():
        p = net.forward(x, mask)[1]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g, _ = net.gradient(x, mask, y)
    for name in g:
        flat, own = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(own))[:3]:
            was = flat[i]
            flat[i] = was + 1e-4
            up = loss()
            flat[i] = was - 1e-4
            down = loss()
            flat[i] = was
            assert own[i] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=1e-3), name


def test_held_out_blocks(net):
    right = total = 0
    data = H.training_pages(150, seed=77)
    for (blocks, labels), prob in zip(data, net.label([b for b, _ in data])):
        right += int(((prob >= 0.5) == (labels > 0.5)).sum())
        total += len(blocks)
    assert right >= 0.95 * total


def test_query(spark):
    found = H.op7_html_text(spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rows = found.collect()
    assert sorted((r.page_id, r.url) for r in rows) == sorted(map(tuple, pages.collect()))
    assert all(r.n_chars == len(r.text) and not any(line != " ".join(line.split()) or not line for line in r.text.split("\n") if r.text) for r in rows)


def test_odd_pages(spark, net):
    article = "<nav class=menu><a href=/>Home</a></nav><article><h1>Title</h1>" + "<p>A long paragraph of an article, with several words in it.</p>" * 5000 + "</article><footer class=footer>Copyright</footer>"
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", article, 0), (None, "u", article, 0), (5, "u", "<div>" * 5000 + "deep", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = H.extract(df, net).collect()
    assert len(found) == 5
    assert [r.text for r in found if r.page_id in (1, 2)] == ["", ""]
    assert all(len(r.text.split("\n")) == 5001 and "Home" not in r.text and "Copyright" not in r.text for r in found if r.page_id is None)
    assert H.extract(df.limit(0), net).count() == 0
