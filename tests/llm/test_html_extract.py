"""Main text of pages: reader, field and extraction."""

import itertools
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from millrace.llm import html_extract
from millrace.llm.html_blocks import blocks
from millrace.llm.labelled_pages import labelled_pages

ROWS = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def field(spark):
    return html_extract.fit(spark.read.parquet(ROWS))


class Article(HTMLParser):
    """Texts of the blocks inside ``article``, for pages of headings and paragraphs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.found = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "article"):
            self.found.append("")
        elif tag == "br":
            self.found[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.found.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def plain(html):
    reader = Article()
    reader.feed(html)
    reader.close()
    return "\n".join(t for t in (" ".join(f.split()) for f in reader.found) if t)


def test_table_pages_equal_their_articles(spark, field):
    pages = spark.read.parquet(ROWS)
    got = {r.page_id: r for r in html_extract.extract(pages, field).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        assert got[row.page_id].text == plain(row.html), row.page_id
        assert got[row.page_id].n_chars == len(got[row.page_id].text) and got[row.page_id].url == row.url


def test_held_out_composed_pages(field):
    labeler = html_extract.Labeler(field)
    right = total = 0
    for html in labelled_pages(400, seed=99):
        page = blocks(html)
        main = labeler.main_blocks(html)
        want = [b.text for b in page if b.marked]
        right += len(set(main) & set(want))
        total += len(set(main) | set(want))
    assert right / total > 0.97


@pytest.mark.parametrize("html, want", [
    ("<body><div class='navbar'><a href=x>Home</a> <a href=y>Blog</a></div><div id='cookies'>This site uses cookies.</div>"
     "<div class='post-content'><h1>Of it</h1><p>First paragraph, a long one with words &amp; commas, and more.</p>"
     "<p>Second&nbsp;paragraph\n is <i>he</i>re.</p></div><div class='comments-area'><p>Great post, thanks for this.</p></div>"
     "<div class='footer'>Terms</div></body>",
     "Of it\nFirst paragraph, a long one with words & commas, and more.\nSecond paragraph is here."),
    ("<header><nav><a href=/>A</a></nav></header><main><h1>T one</h1><p>Para one is right here, yes.</p><ul><li>item one is this."
     "<li>item two is that.</ul><p>Para two goes on for a bit.</p></main><section id='comments'><h2>3 Comments</h2>"
     "<p>I disagree with this.</p></section><footer>(c) me</footer>",
     "T one\nPara one is right here, yes.\nitem one is this.\nitem two is that.\nPara two goes on for a bit."),
])
def test_other_layouts(field, html, want):
    assert "\n".join(html_extract.Labeler(field).main_blocks(html)) == want


def test_leaf_blocks():
    def texts(html):
        return [b.text for b in blocks(html)]

    assert texts("<p>a<b>b<p>c</b>d") == ["ab", "cd"]
    assert texts("<ul><li>one<li>two</ul>x &amp y &#233; &am") == ["one", "two", "x & y é &am"]
    assert texts("a < b <i>c</i>d<br>e") == ["a < b cd e"]
    assert texts("<script>var a='</p>';</script>t<textarea>q</textarea><title>zz") == ["t"]
    assert texts("<b><article><p>x</b>y</p>z</article>") == ["xy", "z"]
    assert texts("<!-- <p>no</p> --><p title='<p>'>yes</p><!-- open <p>no") == ["yes"]
    assert texts("") == [] and texts(" \n\t") == []
    assert blocks("<div class='siteHeader top_bar'><p>x")[0].words == {"site", "header", "top", "bar"}


@pytest.mark.parametrize("piece", ["<a \"", "<p title='", "<b", "<!--", "</p>", "<span>", "<div>x", "<li><p>y", "&#", "<title>"])
def test_reading_is_linear(piece):
    started = time.perf_counter()
    blocks(piece * 100_000)
    assert time.perf_counter() - started < 6


def test_viterbi_and_gradient_by_brute_force():
    pick = np.random.default_rng(3)
    field = html_extract.Field({}, tuple(tuple(map(tuple, pick.normal(size=(2, 2)))) for _ in range(2)), tuple(pick.normal(size=2)))
    scores, same = pick.normal(size=7).tolist(), [0, *pick.integers(0, 2, 6).tolist()]

    def value(labels):
        total = field.first[labels[0]] + sum(s for s, y in zip(scores, labels) if y)
        return total + sum(field.steps[same[i]][labels[i - 1]][labels[i]] for i in range(1, 7))

    best = max(itertools.product((0, 1), repeat=7), key=value)
    assert tuple(html_extract.best_labels(scores, same, field)) == best
    assert html_extract.best_labels([], [], field) == []


def test_training_reaches_the_likelihood_optimum():
    pick = np.random.default_rng(5)
    data = [html_extract.Sequence([[f"f{k}" for k in range(4) if pick.random() < 0.5] for _ in range(n)],
                                  [0, *pick.integers(0, 2, n - 1).tolist()], pick.integers(0, 2, n).tolist()) for n in (3, 5, 4, 1) * 4]

    def objective(field):
        total = 0.0
        for s in data:
            def value(labels):
                out = field.first[labels[0]]
                for i, y in enumerate(labels):
                    out += sum(field.weights.get(f, 0.0) for f in s.features[i]) if y else 0.0
                    out += field.steps[s.same[i]][labels[i - 1]][y] if i else 0.0
                return out
            every = [value(y) for y in itertools.product((0, 1), repeat=len(s.labels))]
            total += np.logaddexp.reduce(every) - value(s.labels)
        flat = [*field.weights.values(), *np.ravel(field.steps), *field.first]
        return total + html_extract.PENALTY / 2 * float(np.square(flat).sum())

    best = html_extract.train(data, rounds=200)
    low = objective(best)
    for name in best.weights:
        for shift in (-0.05, 0.05):
            assert objective(best._replace(weights=best.weights | {name: best.weights[name] + shift})) > low


def test_awkward_rows(spark, field):
    long = "<article>" + "<p>word and word, again.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 2), (None, None, "<article><p>Some text here.</p></article>", None, 3),
            (3, "u", long, "x", 4), (3, "u", long, "x", 4), (4, "u", "<nav><a>Home</a></nav>", "x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in html_extract.extract(pages, field).select("page_id", "text", "n_chars").collect()]
    assert len(got) == len(rows)
    assert (1, "", 0) in got and (2, "", 0) in got and (None, "Some text here.", 15) in got
    whole = "\n".join(["word and word, again."] * 20_000)
    assert got.count((3, whole, len(whole))) == 2
    empty = html_extract.extract(pages.limit(0), html_extract.fit(pages.limit(0)))
    assert empty.columns == ["page_id", "url", "text", "n_blocks", "n_chars"] and empty.count() == 0
