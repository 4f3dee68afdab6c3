import html
import re
import time

import numpy as np
import pytest

from sensorloom.llm import extraction
from sensorloom.llm.html_blocks import leaf_blocks
from tests.oracle import TESTDATA


def test_blocks_of_untidy_markup():
    page = (
        "<HTML><head><title>t</title><style>p{}</style></head><body>plain <b>bold</b>\n  text<p class='a b-c' id=\"mainNav\">one<br>two"
        "<p>three &amp; &eacute;<!-- <p>no --><script>var t='</p>'</script> four<ul><li>x<li>y <a href=#>link</a></ul>tail<"
    )
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["plain bold text", "one two", "three & é four", "x", "y link", "tail<"]
    assert blocks[1].names == {"a", "b", "c", "main", "nav"} and blocks[2].names == frozenset()
    assert blocks[3].tags[-2:] == ("ul", "li") and blocks[4].linked == pytest.approx(4 / 6)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<div></div>", "<!-- open", "<script>never closed"])
def test_pages_without_text(page):
    assert all(b.text for b in leaf_blocks(page))
    assert isinstance(extraction.trained().main_text(page), str)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<head><title>t</title><meta charset=x><body><p>one</p>", ["one"]),
        ("<html><head><title>t</title><link rel=x><div>one<p>two</div>", ["one", "two"]),
        ("<head><title>t</title> one <b>two</b>", ["one two"]),
        ("<head><style>s</style><noscript><p>no</p></noscript></head><p>one", ["one"]),
        ("<p>one</p><svg width='1'/><p>two</p><svg><text>no</text></svg><p>three</p>", ["one", "two", "three"]),
        ("<svg/><p>one <svg><title/><svg><path/></svg><text>no</text></svg> two</p>", ["one two"]),
        ("<select><option>a<p>one</p><select><option>no</select><p>two</p>", ["a", "one", "two"]),
        ("<p>one</p><iframe src=/a/><p>two</p><iframe src=b>no</iframe><p>three", ["one", "two", "three"]),
        ("<template><p>one<noscript><p>two<!-- </template> --><script>'</noscript>'</script>", ["one", "two"]),
        ("<noscript><p>no</p></noscript><select-box>one</select-box><title-bar>two</title-bar>", ["one", "two"]),
        ("<p>one<textarea>no <p>no", ["one"]),
    ],
)
def test_no_text_is_lost_to_open_elements(page, texts):
    assert [b.text for b in leaf_blocks(page)] == texts


def test_many_open_elements_take_linear_time():
    page = "<svg><select><iframe>" * 20_000 + "<p>one</p>"
    assert [b.text for b in leaf_blocks(page)] == ["one"]


BROKEN = ["<x ", "<script ", "<div>t", "<!x", '<a "', "</script", "<a '\"", "</foo>", "<svg>", "<div class=ab>t", "<p><b", "<li><td>"]


@pytest.mark.parametrize("form", BROKEN)
def test_broken_pages_take_linear_time(form):
    def seconds(size):
        page = (form * (size // len(form) + 1))[:size]
        start = time.process_time()
        extraction.BlockLabels({}, np.zeros((0, 2)), np.zeros(2), np.zeros((2, 2))).main_text(page)
        return time.process_time() - start

    small = min(seconds(60_000) for _ in range(3))
    # Square growth would be sixteen times as much.
    assert seconds(240_000) < 9 * small + 0.2


@pytest.mark.parametrize(
    "page",
    [
        "<ul><li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000,
        "<div>" * 20_000 + "x</foo>" * 20_000,
        "".join(f"<div class=name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>t" for i in range(20_000)),
    ],
)
def test_deep_pages_end_soon(page):
    start = time.process_time()
    blocks = leaf_blocks(page)
    extraction.trained().decode(blocks)
    assert blocks and time.process_time() - start < 20


def test_levels_tell_what_is_around_a_block():
    page = "<div class=outer><div class='outer inner'><p id=leaf>x</p></div><p>y</p></div><p>z"
    first, second, third = leaf_blocks(page)
    assert first.tags == ("div", "div", "p") and first.names == {"outer", "inner", "leaf"} and first.nearest == {"leaf"}
    assert second.tags == ("div", "p") and second.names == {"outer"} == second.nearest
    assert third.tags == ("p",) and third.names == third.nearest == frozenset()
    assert [f for f in extraction.features(first) if f.startswith("tag:")].count("tag:div") == 1


def test_scores_are_the_sums_of_the_features():
    blocks = [block for page, _ in extraction.labelled_pages(5, seed=3) for block in page]
    model = extraction.trained()
    plain = [sum(model.weights[model.places[f]] for f in extraction.features(b) if f in model.places) for b in blocks]
    assert np.allclose(model.scores(blocks), np.array(plain))


def test_slope_of_the_likelihood():
    likelihood = extraction.Likelihood(extraction.labelled_pages(4, seed=8))
    random = np.random.Generator(np.random.PCG64(3))
    theta = random.normal(size=likelihood.size) / 3
    _, slope = likelihood(theta)
    for place in [*random.integers(0, likelihood.size - 6, 25), *range(likelihood.size - 6, likelihood.size)]:
        step = np.zeros_like(theta)
        step[place] = 1e-5
        (up, _), (down, _) = likelihood(theta + step), likelihood(theta - step)
        assert slope[place] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_viterbi_finds_the_best_of_all_labellings():
    random = np.random.Generator(np.random.PCG64(2))
    blocks = leaf_blocks("".join(f"<p>w{i}</p>" for i in range(7)))
    for _ in range(30):
        model = extraction.BlockLabels({}, np.zeros((0, 2)), random.normal(size=2), random.normal(size=(2, 2)))
        scores = random.normal(size=(7, 2))
        object.__setattr__(model, "scores", lambda _, s=scores: s)

        def value(labels, model=model, scores=scores):
            moves = sum(model.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))
            return model.first[labels[0]] + moves + sum(scores[i, k] for i, k in enumerate(labels))

        every = [[n >> i & 1 for i in range(7)] for n in range(128)]
        assert value([int(x) for x in model.decode(blocks)]) == pytest.approx(max(map(value, every)))


def test_accuracy_on_pages_not_trained_on():
    model = extraction.trained()
    right = total = 0
    for blocks, labels in extraction.labelled_pages(150, seed=1234):
        right += sum(a == b for a, b in zip(model.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right > 0.98 * total


def article(page):
    """Text of the article element of the table's pages, whose markup is known."""
    inside = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ")
    pieces = re.split(r"</?(?:article|h1|p)>", inside)
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", piece)).split()) for piece in pieces)
    return "\n\n".join(text for text in texts if text)


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(str(TESTDATA / "sf0.01" / "pages.parquet"))
    expected = {r.page_id: article(r.html) for r in pages.collect()}
    found = {r.page_id: r for r in extraction.extraction_digest(pages).collect()}
    assert len(found) == len(expected)
    assert sum(found[i].text == text for i, text in expected.items()) >= 0.99 * len(expected)
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "u", "<p>" + "long text. " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extraction.extracted(pages).collect()
    assert sorted(r.n_chars for r in found)[:3] == [0, 0, 0] and len(found) == 4
    assert extraction.extraction_digest(pages.limit(0)).count() == 0


def test_sites_with_other_names():
    page = (
        "<body><header><a href=/>Site</a></header><div class='cookie-notice'><p>We use cookies here.</p></div>"
        "<main><article><h1>Title</h1><p>First sentence of the article, long enough.</p>"
        "<div class='advert'><p>Buy this now!</p></div><p>Second sentence of the article.</p>"
        "<section id='comments'><p>I liked it.</p><p>Me too.</p></section></article></main>"
        "<aside class=sidebar><p><a href=/x>Related</a></p></aside><form><label>Search</label></form><footer>&copy; 2020 Site</footer>"
    )
    assert extraction.trained().main_text(page) == "Title\n\nFirst sentence of the article, long enough.\n\nSecond sentence of the article."
