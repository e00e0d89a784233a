import itertools
import time

import numpy as np
import pytest

from counterpoise.llm import html_content as H

PROSE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt. " * 2
SHORT = " ".join(PROSE.split())


@pytest.fixture(scope="module")
def model():
    return H.fit_trees([])


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    tree = H.parse("<div class=menu><a>x</a></div><article><h1>T</h1><p>a <b>b</b></p></article>")
    m = H.TreeModel(rng.normal(size=len(H.FEATURES)), rng.normal(size=(2, 2, 2)))
    kind = H.edge_kinds(tree)
    own = H.features(tree) @ m.weights
    n = len(own)
    assert n < 14
    total, hit = 0.0, np.zeros(n)
    for labels in itertools.product([0, 1], repeat=n):
        y = np.array(labels)
        score = np.exp(own @ y + sum(m.edge[kind[i], y[tree.parent[i]], y[i]] for i in range(1, n)))
        total += score
        hit += score * y
    assert np.allclose(m.marginals(tree), hit / total)


def test_gradient_is_the_slope_of_the_likelihood():
    """Against differences of the likelihood of one small tree, summed over all its labellings."""
    tree = H.parse("<div class=menu data-y=0><a>x y</a></div><article data-y=1><p>a <b>b</b></p></article>")
    labels = H.labels_of_parts(tree)
    grove = H._Grove([(tree, labels)])
    rng = np.random.default_rng(2)
    theta, edge = rng.normal(size=grove.x.shape[1]) * 0.3, rng.normal(size=(2, 2, 2)) * 0.3
    n, kind, x = len(labels), H.edge_kinds(tree), H.features(tree)

    def likelihood(theta, edge):
        def score(y):
            return (x @ theta) @ y + sum(edge[kind[i], y[tree.parent[i]], y[i]] for i in range(1, n))

        every = [score(np.array(y)) for y in itertools.product([0, 1], repeat=n)]
        return (score(labels.astype(int)) - np.logaddexp.reduce(every)) / n

    node, pair = grove.gradient(theta, edge)
    for k in range(0, len(theta), 3):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert np.isclose((likelihood(theta + step, edge) - likelihood(theta - step, edge)) / 2e-5, node[k], atol=1e-6)
    for k in np.ndindex(2, 2, 2):
        step = np.zeros((2, 2, 2))
        step[k] = 1e-5
        assert np.isclose((likelihood(theta, edge + step) - likelihood(theta, edge - step)) / 2e-5, pair[k], atol=1e-6)


MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News today</a></li><li><a href=c>Sports</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<!-- only --><script>x</script>", ""),
        (f"<p>One &amp; two.<p>{PROSE}", f"One & two. {SHORT}"),
        (f"<nav><ul><li><a>m</a></ul></nav><article><h1>T</h1><p><b>in<br>side<p>{PROSE}</article><footer>&copy; x</footer>", f"T in side {SHORT}"),
        (f"<article><p>a</p><script>var t='</p><p>no';</script><p>b&#233;&nbsp;c{PROSE}</p></article>", f"a bé c{SHORT}"),
        (f"<div class=sidebar><p>{PROSE}</p></div><article><p>{PROSE}</p><p>Short.</p></article>", f"{SHORT} Short."),
        (f"<article><p>{PROSE}</p></article><div id=comments><p>{PROSE}</p><p>{PROSE}</p></div>", SHORT),
        (f"<div class='cookie-notice'><p>{PROSE}</p></div><div><h1>T</h1><p>{PROSE}</p></div><form><p>Mail</p></form>", f"T {SHORT}"),
        (f"<article><p>{PROSE}</p><div class=advert>{PROSE}</div><p>end</p></article>", f"{SHORT} end"),
        # words that say what a part is about, or what a page has
        (f"<article><p>{PROSE}</p><section class=related-work><p>{PROSE}</p></section><p class=more>x y z</p></article>", f"{SHORT} {SHORT} x y z"),
        (f"<article><p>{PROSE}</p><div class=rail-history><p>{PROSE}</p></div><address>at home</address></article>", f"{SHORT} {SHORT} at home"),
        (f"<div class='page with-sidebar'><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div>", f"T {SHORT} {SHORT}"),
        (f"<div class='story alert'><h1>T</h1><p>{PROSE}</p></div>", f"T {SHORT}"),
        (f"<div class='post more-news'><h1>T</h1><p>{PROSE}</p></div>", f"T {SHORT}"),
        # classes that say nothing
        (f"<div class=c1>{MENU}</div><div class=c2><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class=c3>&copy; 2024 The Site</div>", f"T {SHORT} {SHORT}"),
        (f"<div class=c1>{MENU}</div><article><h1>T</h1><p>{PROSE}</p></article><div class=c3><p>&copy; 2024 The Site</p></div>", f"T {SHORT}"),
        (f"<header><h1>Site</h1><p>{PROSE[:60]}</p></header><main><h1>T</h1><p>{PROSE}</p></main><aside><p>{PROSE}</p></aside><footer><p>{PROSE}</p></footer>", f"T {SHORT}"),
        (f"<article><header><h1>T</h1><p>By me</p></header><p>{PROSE}</p><form><p>{PROSE}</p><button>x</button></form><section class=comments><p>{PROSE}</p></section></article>", f"T By me {SHORT}"),
        ("<nav><a href=x>a</a></nav><article><h1>Hi</h1><p>Of.</p></article><footer>&copy; a &middot; b</footer>", "Hi Of."),
        (f"<article><p>{PROSE}</p><p>Copyright law is a topic of debate, {PROSE}</p></article>", f"{SHORT} Copyright law is a topic of debate, {SHORT}"),
        ("Hello there", "Hello there"),
    ],
)
def test_pages(model, page, text):
    assert H.main_text(model, page) == text


def test_long_pages_are_whole(model):
    page = "<article>" + "".join(f"<p>word{i} and more words in it, {PROSE}</p>" for i in range(20_000)) + "</article>"
    assert H.main_text(model, page).count("more words in it") == 20_000


def test_held_out_pages(spark, sf):
    """Pages whose article is marked, judged against their marks, with the marks' tag hidden from the text below."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = H.fit(pages.filter("page_id % 2 = 0"))
    rows = pages.filter("page_id % 2 = 1").collect()
    right = 0
    for r in rows:
        tree = H.parse(r.html)
        labels = H.labels_of_marks(tree)
        texts = [t == "" for t in tree.tag]
        right += bool(((model.marginals(tree) > 0.5)[texts] == labels[texts]).all())
    assert right >= 0.98 * len(rows)


def test_frames(spark, model):
    pages = spark.createDataFrame([(1, "u", f"<p>{PROSE}</p>", "x"), (1, "u", f"<p>{PROSE}</p>", "x"), (None, None, None, "x")], "page_id bigint, url string, html string, text string")
    rows = H.extract(pages, model).collect()
    assert sorted(r.text for r in rows) == ["", SHORT, SHORT] and [r.n_chars for r in rows] == [len(r.text) for r in rows]
    assert H.extract(pages.limit(0), H.fit(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body><article><p>{PROSE}</p></article></body></html>",
        f"<head><meta charset=utf-8><title>x</title><article><p>{PROSE}</p></article>",
        f"<head><style>p</style><link rel=x><script>y</script>\n<p>{PROSE}</p></html>",
        f"<head><title>x</title>\n{PROSE}",
        f"<head><head><title>x</title><body>{PROSE}</body>",
        f"<head><title>x</title></head><body><p>{PROSE}</p>",
    ],
)
def test_heads_may_be_left_open(page):
    assert [" ".join(t.split()) for t in H.parse(page).text if t.strip()] == [SHORT]


def test_article_behind_an_open_head(model):
    assert H.main_text(model, f"<html><head><title>x</title><body><article><p>{PROSE}</p></article>") == SHORT


def test_messages_decide(model):
    """Without its edges the model cannot tell what a sidebar or an advert holds from the article's own text."""
    deaf = H.TreeModel(model.weights, np.zeros((2, 2, 2)))
    for page in (f"<article><p>{PROSE}</p><div class=advert>{PROSE}</div><p>end</p></article>", f"<body><div class=sidebar><p>{PROSE}</p></div><div class=content><h1>T</h1><p>{PROSE}</p></div></body>"):
        assert H.main_text(deaf, page) != H.main_text(model, page)
    differ = sum(H.main_text(deaf, p) != H.main_text(model, p) for p in H.composed_pages(60, seed=5))
    assert differ > 20


def test_pages_composed_for_holding_out(model):
    """Labels come from how a page was put together; the features never see them."""
    wrong = total = 0
    for page in H.composed_pages(150, seed=77):
        tree = H.parse(page)
        labels = H.labels_of_parts(tree)
        text = np.array([t == "" for t in tree.tag])
        wrong += int(((model.marginals(tree) > 0.5) != labels)[text].sum())
        total += int(text.sum())
    assert total > 2_000 and wrong <= 0.05 * total
    page = H.composed_pages(1, seed=3)[0]
    assert np.array_equal(H.features(H.parse(page)), H.features(H.parse(page.replace("data-y=1", "data-z=1").replace("data-y=0", "data-z=0"))))


def test_time_is_linear_in_open_elements(model):
    start = time.perf_counter()
    assert H.main_text(model, "<div>" * 200_000 + f"<p>{PROSE}") in (SHORT, "")
    assert H.main_text(model, "<p><b>" * 50_000 + PROSE) is not None
    assert time.perf_counter() - start < 60
