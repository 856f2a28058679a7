"""Block cutting, the network against plain loops and numeric gradients, extraction on generated pages and on the table."""

import re

import numpy as np
import pytest

from landpulse.llm import html_extract
from landpulse.llm.html_blocks import blocks

FOLDER = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize("page,want", [
    ("", []), (" \n", []), ("plain", ["plain"]), ("<p>a &amp b&nbsp;&lt;i&gt; \n\t c<p>d<br>e", ["a & b\xa0<i> c", "d e"]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5", ["1", "2", "3", "4", "5"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<script>var x='</p>'; if (a<b) {}</script>x<style>p{}</STYLE >y<!-- <p>no</p> -->z<script>open", ["xyz"]), ("<title>t</title><svg><text>s</text></svg><p>1 < 2 > 1", ["1 < 2 > 1"]),
    ("<p title='a>b' class=\"c>d\">q</p></div></p>r", ["q", "r"]), ("<p>&#233;&#x41;&am &unknown; &copy", ["éA&am &unknown; ©"]), ("a<p", ["a"]), ("<p>b<i>o</i>l<span>d</span></p>", ["bold"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_follow_the_elements():
    inside, outside = blocks('<div class="siteFooter box-2"><p>a</div><p>b')
    plain = blocks("<p>b")[0]
    assert outside.path == plain.path and len(inside.path) > len(outside.path)
    assert blocks('<p>x <a href="#">yy</a>')[0].linked == 0.5


def small(seed=1):
    layouts = html_extract.Layouts(["some words of a text", "more words here and there"], seed)
    return [layouts.page() for _ in range(6)]


def test_generated_pages_have_a_label_per_block():
    layouts = html_extract.Layouts(["Ein Text mit ein paar Wörtern & Zeichen <3"], 4)
    for _ in range(200):
        page, labels = layouts.page()
        assert len(blocks(page)) == len(labels) and 1 in labels


def test_scores_agree_with_plain_loops():
    cut = [blocks(p) for p, _ in small()] + [[]]
    x, network = html_extract.Inputs(cut), html_extract.Labeller()
    inputs, p, size = network.vectors(x).astype(float), network.p, html_extract.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    want, at = [], 0
    for page in cut:
        n = len(page)
        states = np.zeros((n, 2 * size))
        for side, steps in ((0, range(n)), (1, range(n - 1, -1, -1))):
            h, c = np.zeros(size), np.zeros(size)
            gate = lambda k: slice(k * 2 * size + side * size, k * 2 * size + (side + 1) * size)  # noqa: E731, B023
            own = slice(side * size, (side + 1) * size)
            for t in steps:
                g = [inputs[at + t] @ p["input"][:, gate(k)] + p["bias"][gate(k)] + h @ p["state"][own, gate(k)] for k in range(4)]
                c = sigmoid(g[1]) * c + sigmoid(g[0]) * np.tanh(g[3])
                h = sigmoid(g[2]) * np.tanh(c)
                states[t, own] = h
        want += list(sigmoid(states @ p["out"] + p["out_bias"]))
        at += n
    assert np.allclose(network.score(x), want, atol=1e-5)


def test_gradients_agree_with_differences():
    pages = small(3)[:2]
    x, target = html_extract.Inputs([blocks(p) for p, _ in pages]), np.array([y for _, ys in pages for y in ys], np.float32)
    network = html_extract.Labeller()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    grads, _ = network.gradients(x, target)
    draw = np.random.default_rng(0)
    for name, grad in grads.items():
        for place in [np.unravel_index(int(np.abs(grad).argmax()), grad.shape), tuple(draw.integers(0, s) for s in grad.shape)]:
            kept = network.p[name][place]
            loss = []
            for step in (1e-3, -1e-3):
                network.p[name][place] = kept + step
                loss.append(network.gradients(x, target)[1])
            network.p[name][place] = kept
            assert abs((loss[0] - loss[1]) / 2e-3 - grad[place]) < 2e-4 + 0.02 * abs(grad[place]), name


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.fit(html_extract.sample_texts(spark.read.parquet(f"{FOLDER}/pages.parquet")))


def test_held_out_pages(labeller):
    layouts = html_extract.Layouts(["Other words than those of training , in sentences . They go on and on"], 123)
    pages = [layouts.page() for _ in range(150)]
    wrong = total = 0
    for (_, labels), (_, score) in zip(pages, html_extract.labelled([p for p, _ in pages], labeller)):
        wrong += int(((score >= 0.5) != np.array(labels)).sum())
        total += len(labels)
    assert wrong < 0.02 * total


def test_table_and_odd_pages(spark, labeller):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()]
    long = "<nav><a>Home</a></nav><article>" + "".join(f"<p>A sentence with number {k} in it.</p>" for k in range(20_000)) + "</article><footer>&copy; someone</footer>"
    odd = [(9001, None, None), (None, "u", ""), (9002, "u", "<p> </p>"), (9003, "v", long), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows + odd], "page_id long, url string, html string, text string, n_chars int")
    found = [tuple(r) for r in html_extract.extract(frame, labeller).collect()]
    assert len(found) == len(rows) + len(odd) and all(n == len(text) for _, _, text, n in found)
    by_id = {}
    for ident, _, text, _ in found:
        by_id.setdefault(ident, []).append(text)
    assert by_id[9001] == by_id[9002] == by_id[None] == [""]
    assert by_id[9003][0].count("A sentence") == 20_000 and "someone" not in by_id[9003][0]
    assert len(set(by_id[rows[0][0]])) == 1 and len(by_id[rows[0][0]]) == 3
    right = sum(by_id[i][0] == "\n\n".join(texts(re.search("<article>.*</article>", h, re.S)[0])) for i, _, h in rows)
    assert right >= 0.97 * len(rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.sample_texts(empty) == [] and html_extract.extract(empty, labeller).collect() == []
