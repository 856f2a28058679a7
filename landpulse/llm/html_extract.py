"""HTML extraction: a bidirectional LSTM labels every block of a page as main text or not.

A page is its sequence of leaf blocks (``html_blocks``). A block's input is the mean vector of the buckets of its tag path
(element names, classes, ids, roles), the mean vector of its hashed words, and a few measures: length, link share, digits,
punctuation, place on the page. Two LSTMs read the whole sequence in both directions, so each decision uses the
whole page; a logistic unit over both states labels the block. Blocks of 0.5 or more make up the text.

The pages carry no labels. The network is trained in numpy on ``PAGES`` generated pages: layouts drawn at random (articles,
menus, headers, footers, sidebars, notices, adverts, forms, comments, with and without telling names), filled with words of at most
``SAMPLE`` rows of the table, chosen by hash among those of at most ``LONGEST`` code points. Both bounds are parameters of
the fit. Every page is then cut and labelled whole, in parallel, without a shuffle.

Null and empty pages, and pages without any text, have an empty text and no characters. Headings count as part of the article
they stand in. A page of any length is one sequence. Repeated rows get equal texts. An empty table gives an empty table; the network
is then trained on plain words. Other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.llm.html_blocks import PATH_BUCKETS, Block, blocks
from landpulse.llm.tables import query, table
from landpulse.llm.textbytes import LOWER_CODES, Slice, range_hashes, words

THRESHOLD = 0.5
SAMPLE, LONGEST = 200, 20_000
PAGES, STEPS, BATCH, RATE = 2000, 700, 24, 0.01
WORD_BUCKETS, PATH_SIZE, WORD_SIZE, HIDDEN = 1 << 12, 12, 8, 12
MEASURES = 9
B = 2 * HIDDEN
TOGETHER = 1 << 14  # blocks scored in one go, padding included; a longer page goes alone
WORDS_TOGETHER = 1 << 21  # bytes of text hashed in one go
Batches = Iterator[pa.RecordBatch]

DIGIT, STOP, UPPER = (np.isin(np.arange(256), list(s.encode())) for s in ("0123456789", ".,;:!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Inputs:
    """Blocks of some pages, page by page: hashed words, path buckets, measures."""

    def __init__(self, pages: list[list[Block]]) -> None:
        self.sizes = np.array([len(p) for p in pages], np.int64)
        every = [b for p in pages for b in p]
        raw = [b.text.encode("utf-8", "replace") for b in every]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        part = Slice(np.frombuffer(b"".join(raw), np.uint8), ends - size, ends, 0)
        w = words(part)
        self.word = (range_hashes(part.data, w.start, w.end, LOWER_CODES) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.word_at = w.first
        self.path = np.array([x for b in every for x in b.path], np.int64)
        self.path_at = np.concatenate([[0], np.cumsum([len(b.path) for b in every])]).astype(np.int64)
        count = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[part.data])])[np.concatenate([part.starts, [len(part.data)]])]) if len(every) else np.zeros(0)
        n_words, n = np.diff(w.first), np.maximum(size, 1)
        of = np.repeat(np.arange(len(pages)), self.sizes)
        place = np.arange(len(every)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        page = np.bincount(of, size, len(pages))
        self.measure = np.column_stack([
            np.log1p(n_words) / 3, np.log1p(size) / 5, [b.linked for b in every], 4 * count(DIGIT) / n, 8 * count(STOP) / n, 4 * count(UPPER) / n,
            place / np.maximum(self.sizes[of], 1), np.log1p(self.sizes[of]) / 4, np.sqrt(size / np.maximum(page[of], 1))]).astype(np.float32).reshape(len(every), MEASURES)

    def __len__(self) -> int:
        return len(self.measure)


def _means(vectors: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean vector of each run ``index[at[k]:at[k + 1]]``; zero for an empty run."""
    out = np.zeros((len(at) - 1, vectors.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(vectors[index], at[some], axis=0) / np.diff(at)[some, None].astype(np.float32)
    return out


class Labeller:
    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale=0.2: draw.normal(0, scale, shape).astype(np.float32)
        apart = np.zeros((B, 4 * B), np.float32)  # the directions do not see each other's state
        for gate in range(4):
            for side in range(2):
                apart[side * HIDDEN:(side + 1) * HIDDEN, gate * B + side * HIDDEN:gate * B + (side + 1) * HIDDEN] = 1
        self.apart = apart
        bias = np.zeros(4 * B, np.float32)
        bias[B:2 * B] = 1  # remember at first
        self.p = {"path": normal(PATH_BUCKETS, PATH_SIZE), "word": normal(WORD_BUCKETS, WORD_SIZE, scale=0.05), "input": normal(PATH_SIZE + WORD_SIZE + MEASURES, 4 * B), "bias": bias,
                  "state": normal(B, 4 * B) * apart, "out": normal(B), "out_bias": np.zeros(1, np.float32)}

    def vectors(self, x: Inputs) -> np.ndarray:
        return np.concatenate([_means(self.p["path"], x.path, x.path_at), _means(self.p["word"], x.word, x.word_at), x.measure], 1)

    @staticmethod
    def order(first: np.ndarray, sizes: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
        """Block read at each step (steps, pages) by the forward and the backward direction; ``blank`` after a page's end."""
        step = np.arange(int(sizes.max(initial=0)))[:, None]
        inside = step < sizes
        return np.where(inside, first + step, blank), np.where(inside, first + sizes - 1 - step, blank)

    def run(self, projected: np.ndarray, near: np.ndarray, far: np.ndarray, keep: bool = False):
        """States of every block from its gate inputs; the last row of ``projected`` is the blank."""
        n = near.shape[1]
        h, c, states, tape = np.zeros((n, B), np.float32), np.zeros((n, B), np.float32), np.zeros((len(projected), B), np.float32), []
        side = np.tile(np.repeat([True, False], HIDDEN), 4)
        for a, b in zip(near, far):
            g = np.where(side, projected[a], projected[b]) + h @ self.p["state"]
            ifo, new = _sigmoid(g[:, :3 * B]), np.tanh(g[:, 3 * B:])
            i, f, o = ifo[:, :B], ifo[:, B:2 * B], ifo[:, 2 * B:]
            old, c = c, f * c + i * new
            shown = np.tanh(c)
            if keep:
                tape.append((h, old, i, f, o, new, shown))
            h = o * shown
            states[a, :HIDDEN] = h[:, :HIDDEN]
            states[b, HIDDEN:] = h[:, HIDDEN:]
        return (states[:-1], tape) if keep else states[:-1]

    def score(self, x: Inputs) -> np.ndarray:
        """Score of every block; pages of about the same length are read together."""
        projected = np.concatenate([self.vectors(x) @ self.p["input"] + self.p["bias"], np.zeros((1, 4 * B), np.float32)])
        first = np.cumsum(x.sizes) - x.sizes
        by_size = np.argsort(-x.sizes, kind="stable")
        by_size = by_size[x.sizes[by_size] > 0]
        out, low = np.zeros(len(x)), 0
        while low < len(by_size):
            some = by_size[low:low + max(1, TOGETHER // int(x.sizes[by_size[low]]))]
            low += len(some)
            here = np.concatenate([np.arange(first[k], first[k] + x.sizes[k]) for k in some])
            local = np.cumsum(x.sizes[some]) - x.sizes[some]
            near, far = self.order(local, x.sizes[some], len(here))
            out[here] = _sigmoid(self.run(projected[np.append(here, len(x))], near, far) @ self.p["out"] + self.p["out_bias"])
        return out

    def gradients(self, x: Inputs, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean logistic loss over blocks, and the loss."""
        p, n = self.p, len(x)
        inputs = self.vectors(x)
        projected = np.concatenate([inputs @ p["input"] + p["bias"], np.zeros((1, 4 * B), np.float32)])
        near, far = self.order(np.cumsum(x.sizes) - x.sizes, x.sizes, n)
        states, tape = self.run(projected, near, far, True)
        score = _sigmoid(states @ p["out"] + p["out_bias"])
        loss = float(-np.mean(np.log(np.where(target == 1, score, 1 - score) + 1e-7)))
        d = ((score - target) / n).astype(np.float32)
        out = {"out": states.T @ d, "out_bias": np.array([d.sum()], np.float32), "state": np.zeros_like(p["state"])}
        d_states = np.concatenate([d[:, None] * p["out"], np.zeros((1, B), np.float32)])
        d_projected = np.zeros_like(projected)
        dh, dc = np.zeros((near.shape[1], B), np.float32), np.zeros((near.shape[1], B), np.float32)
        side = np.tile(np.repeat([True, False], HIDDEN), 4)
        for t in range(len(near) - 1, -1, -1):
            h, old, i, f, o, new, shown = tape[t]
            dh = dh + np.concatenate([d_states[near[t], :HIDDEN], d_states[far[t], HIDDEN:]], 1)
            dc = dc + dh * o * (1 - shown * shown)
            g = np.concatenate([dc * new * i * (1 - i), dc * old * f * (1 - f), dh * shown * o * (1 - o), dc * i * (1 - new * new)], 1)
            out["state"] += h.T @ g
            d_projected[near[t]] += np.where(side, g, 0)  # a block is read once in each direction
            d_projected[far[t]] += np.where(side, 0, g)
            dh, dc = g @ p["state"].T, dc * f
        out["state"] *= self.apart
        d_projected = d_projected[:-1]
        out["bias"], out["input"] = d_projected.sum(0), inputs.T @ d_projected
        d_inputs = d_projected @ p["input"].T
        for name, index, at, part in (("path", x.path, x.path_at, d_inputs[:, :PATH_SIZE]), ("word", x.word, x.word_at, d_inputs[:, PATH_SIZE:PATH_SIZE + WORD_SIZE])):
            size = np.diff(at)
            grad = np.zeros_like(p[name])
            np.add.at(grad, index, np.repeat(part / np.maximum(size, 1)[:, None].astype(np.float32), size, axis=0))
            out[name] = grad
        return out, loss


# Names of the places that are no article, and words that stand in them; fixed lists of common usage.
PLACES = {
    "nav": "nav navbar menu main-menu top-nav navigation site-nav nav-links topbar", "header": "header site-header masthead top branding page-header head-bar",
    "footer": "footer site-footer foot bottom page-footer copyright colophon", "sidebar": "sidebar side right-rail widget-area secondary aside widget",
    "notice": "cookie-notice cookies consent gdpr notice banner alert popup modal overlay subscribe-box paywall message", "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad ad-slot",
    "form": "search-form login signup contact-form newsletter subscribe feedback", "comments": "comments comment-list responses discussion replies disqus reader-comments comment-section",
    "related": "related related-posts recommended popular trending see-also more-stories read-next", "share": "share social sharing social-links", "crumbs": "breadcrumb breadcrumbs path", "tags": "tags tag-list meta post-meta byline-meta", "pager": "pagination pager",
}
ARTICLE = "content article post entry story main-content post-content article-body entry-content story-body text body page-content main"
SHORT = "Home|About us|Contact|Login|Sign up|Share|Tweet|Subscribe|Privacy policy|Terms of use|Accept|Accept cookies|Advertisement|Sponsored|Related articles|Comments|Reply|Read more|Menu|Search|Next|Previous|Register|Follow us|Log in|Submit|Leave a comment|Popular|Site map|FAQ|Help|Back to top|Close|OK"
LONGER = "We use cookies to improve this site.|All rights reserved.|By using this site you accept our terms.|Sign up for our newsletter.|Leave a reply|Please log in to comment.|This page needs JavaScript.|Subscribe now for full access."
PLAIN = "the of and a in to is was it for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do"


class Layouts:
    """Pages drawn at random, with the label of every block."""

    def __init__(self, texts: list[str], seed: int) -> None:
        self.draw = random.Random(seed)
        self.words = [w for t in texts for w in t.split(" ") if w] or PLAIN.split()

    def prose(self, low: int, high: int) -> str:
        n = self.draw.randint(low, high)
        at = self.draw.randrange(len(self.words))
        return " ".join(self.words[(at + k) % len(self.words)] for k in range(n))

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def open(self, names: str | None, tags: str, telling: float) -> tuple[str, str]:
        """Start and end tag; the element or its name tells what it holds in ``telling`` of the cases."""
        draw = self.draw
        tag = draw.choice(tags.split()) if self.chance(telling) else "div"
        attrs = ""
        if names and self.chance(telling):
            name = draw.choice(names.split())
            name = {0: name, 1: name.replace("-", "_"), 2: name.title().replace("-", ""), 3: f"{draw.choice(['site', 'block', 'c', 'js', 'main', 'region', 'page'])}-{name}", 4: f"{name} {draw.choice(['row', 'col-4', 'box', 'wide', 'clearfix'])}"}[draw.randrange(5)]
            attrs = f' {draw.choice(["class", "class", "id"])}="{name}"'
        elif self.chance(0.4):
            attrs = f' class="{draw.choice("abcdefgh")}{draw.choice("xyz")}{draw.randint(0, 99)}"'
        return f"<{tag}{attrs}>", f"</{tag}>"

    def leaf(self, tag: str, text: str, label: int, inner: str = "") -> None:
        """One block; the text is escaped, ``inner`` may wrap it."""
        body = escape(text, quote=self.chance(0.3))
        if inner:
            body = f"<{inner}>{body}</{inner.split()[0]}>"
        self.out.append(f"<{tag}>{body}</{tag}>")
        self.labels.append(label)

    def links(self, n: int, listed: bool, label: int = 0) -> None:
        for _ in range(n):
            text = self.draw.choice(SHORT.split("|")) if self.chance(0.4) else self.prose(1, 3) if self.chance(0.7) else self.prose(3, 9)
            self.leaf("li" if listed else "div", text, label, 'a href="/x"')

    def paragraphs(self, label: int) -> None:
        draw = self.draw
        if self.chance(0.07):  # one short line over and over
            line = self.prose(1, 4)
            for _ in range(draw.choice([3, 8, 20, 50])):
                self.leaf("p", line.upper() if self.chance(0.05) else line, label)
        for _ in range(draw.choice([1, 1, 2, 3, 4, 5, 7, 9, 14])):
            kind = draw.random()
            long = draw.choice([3, 15, 40, 90, 160])
            if kind < 0.62:
                text = self.prose(1, long)
                self.leaf("p", text.upper() + "!!" if self.chance(0.03) else text, label)
            elif kind < 0.74:  # left open, as many pages do
                self.out.append(f"<p><b>{escape(self.prose(1, long))}<br>")
                self.labels.append(label)
            elif kind < 0.8:
                self.leaf("p", self.prose(8, 60), label, draw.choice(["em", "b", "span class=lead", "strong"]))
            elif kind < 0.85:
                self.leaf(draw.choice(["h2", "h3"]), self.prose(1, 7), label)
            elif kind < 0.9:
                tag = draw.choice(["ul", "ol"])
                self.out.append(f"<{tag}>")
                for _ in range(draw.randint(1, 5)):
                    self.leaf("li", self.prose(2, 20), label, 'a href="/y"' if self.chance(0.15) else "")
                self.out.append(f"</{tag}>")
            elif kind < 0.93:
                self.out.append("<blockquote>")
                self.leaf("p", self.prose(5, 40), label)
                self.out.append("</blockquote>")
            elif kind < 0.96:
                self.out.append("<table>")
                for _ in range(draw.randint(1, 3)):
                    self.out.append("<tr>")
                    self.leaf("td", self.prose(1, 4), label)
                    self.leaf("td", self.prose(1, 8), label)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif kind < 0.98:
                self.out.append("<figure><img src=a.png>")
                self.leaf("figcaption", self.prose(3, 15), label)
                self.out.append("</figure>")
            else:
                self.leaf("div", self.prose(10, 60), label)

    def place(self, kind: str, telling: float) -> None:
        """A part of the page that is no main text."""
        draw = self.draw
        tags = {"nav": "nav nav div", "header": "header header div", "footer": "footer footer div", "sidebar": "aside aside div", "form": "form", "comments": "section div", "related": "aside section div"}.get(kind, "div div section")
        start, end = self.open(PLACES[kind], tags, telling)
        self.out.append(start)
        if kind in ("nav", "crumbs", "share", "tags", "pager"):
            listed = self.chance(0.7)
            self.out.append("<ul>" * listed)
            self.links(draw.randint(2, 9), listed)
            self.out.append("</ul>" * listed)
        elif kind == "form":
            if self.chance(0.5):
                self.leaf(draw.choice(["h3", "p", "legend"]), self.prose(1, 8) if self.chance(0.5) else draw.choice((SHORT + "|" + LONGER).split("|")), 0)
            for _ in range(draw.randint(1, 3)):
                self.leaf(draw.choice(["label", "label", "option", "p"]), self.prose(1, 4) if self.chance(0.6) else draw.choice(SHORT.split("|")), 0)
                self.out.append("<input name=q>")
            self.leaf("button", draw.choice(SHORT.split("|")) if self.chance(0.6) else self.prose(1, 2), 0)
        elif kind == "comments":
            if self.chance(0.6):
                self.leaf(draw.choice(["h2", "h3"]), draw.choice(["Comments", "Responses", "Discussion", self.prose(1, 3)]), 0)
            for _ in range(draw.randint(1, 6)):
                a, b = self.open("comment reply response comment-body", draw.choice(["li", "div", "article"]), telling)
                self.out.append(a)
                if self.chance(0.6):
                    self.leaf(draw.choice(["h4", "div", "p"]), self.prose(1, 3), 0)
                for _ in range(draw.choice([1, 1, 1, 2])):
                    self.leaf("p", self.prose(2, draw.choice([10, 40, 90])), 0)
                if self.chance(0.4):
                    self.leaf("div", "Reply", 0, 'a href="#"')
                self.out.append(b)
        elif kind in ("sidebar", "related", "header"):
            if self.chance(0.7):
                self.leaf(draw.choice(["h2", "h3", "div", "p"]), self.prose(1, 5) if self.chance(0.6) else draw.choice(SHORT.split("|")), 0, draw.choice(["", "a href='/'"]))
            if self.chance(0.6):
                self.out.append("<ul>")
                self.links(draw.randint(1, 7), True)
                self.out.append("</ul>")
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                self.leaf("p", self.prose(2, draw.choice([8, 30, 60])), 0)
        else:  # footers, notices, adverts: text of the page's own words, set phrases, links
            body = self.prose(1, draw.choice([6, 15, 40])) if self.chance(0.7) else draw.choice((SHORT + "|" + LONGER).split("|"))
            body = f"© {body} · {self.prose(2, 8)}" if kind == "footer" and self.chance(0.6) else body
            if self.chance(0.5):
                self.out.append(escape(body))
                self.labels.append(0)
            else:
                self.leaf(draw.choice(["p", "p", "div"]), body, 0)
            for _ in range(draw.choice([0, 0, 0, 1, 2])):
                self.leaf(draw.choice(["p", "div"]), self.prose(1, 25), 0)
            if self.chance(0.3):
                self.leaf("button" if kind == "notice" else "div", draw.choice(SHORT.split("|")), 0, "" if kind == "notice" else 'a href="/z"')
        self.out.append(end)

    def page(self) -> tuple[str, list[int]]:
        draw = self.draw
        self.out, self.labels = [], []
        telling = draw.choice([1.0, 1.0, 1.0, 0.9, 0.8])
        self.out.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{escape(self.prose(1, 8))}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        wrap = self.chance(0.4)
        self.out.append('<div class="wrapper page">' if wrap else "")
        before = [k for k, p in (("notice", 0.25), ("header", 0.4), ("nav", 0.8), ("ad", 0.4), ("crumbs", 0.2), ("form", 0.15), ("sidebar", 0.15)) if self.chance(p)]
        if self.chance(0.25):
            draw.shuffle(before)
        for kind in before:
            self.place(kind, telling)
        layers = [self.open(*draw.choice([(None, "article"), (None, "article"), (None, "main"), (ARTICLE, "div"), (ARTICLE, "article section main div")]), max(telling, 0.9))]
        if self.chance(0.4):
            layers.append(self.open(ARTICLE, draw.choice(["article", "div", "section"]), telling))
        self.out += [a for a, _ in layers]
        if self.chance(0.85):
            self.leaf("h1", self.prose(1, 12), 1)
        if self.chance(0.15):
            self.place(draw.choice(["share", "tags"]), telling)
        self.paragraphs(1)
        while self.chance(0.25):
            self.place(draw.choice(["ad", "related", "form", "notice", "share", "sidebar"]), max(telling, 0.9))
            self.paragraphs(1)
        inside = self.chance(0.15)
        if inside:
            self.place("comments", 1.0)
        self.out += [b for _, b in reversed(layers)]
        after = [k for k, p in (("share", 0.15), ("tags", 0.15), ("related", 0.25), ("comments", 0.3 * (not inside)), ("pager", 0.1), ("sidebar", 0.3), ("ad", 0.25), ("form", 0.15), ("footer", 0.85), ("notice", 0.2)) if self.chance(p)]
        for kind in after:
            self.place(kind, telling)
        self.out.append(("</div>" if wrap else "") + ("</body></html>" if self.chance(0.8) else ""))
        return "".join(self.out), self.labels


def fit(texts: list[str], seed: int = 9) -> Labeller:
    """Adam on the logistic loss of the blocks of generated pages whose words come from ``texts``."""
    layouts, random_, labeller = Layouts(texts, seed), np.random.default_rng(seed), Labeller()
    examples = []
    for _ in range(PAGES):
        page, labels = layouts.page()
        cut = blocks(page)
        if len(cut) == len(labels) and cut:
            examples.append((cut, labels))
    moments = {k: np.zeros((2, *a.shape), np.float32) for k, a in labeller.p.items()}
    for step in range(1, STEPS + 1):
        some = random_.integers(0, len(examples), BATCH)
        grads, _ = labeller.gradients(Inputs([examples[k][0] for k in some]), np.array([y for k in some for y in examples[k][1]], np.float32))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, grad in grads.items():
            m = moments[k]
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.995 * m[1] + 0.005 * grad * grad
            labeller.p[k] = labeller.p[k] - (rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.995 ** step)) + 1e-7)).astype(np.float32)
    return labeller


def sample_texts(pages: DataFrame, key: str = "url", html: str = "html") -> list[str]:
    """Block texts of at most SAMPLE pages of at most LONGEST code points, dealt out by a hash of key and row.

    The hash leaves some four times SAMPLE rows, and the driver takes them partition by partition until it has enough.
    """
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{html}`").alias("h"), F.monotonically_increasing_id().alias("row"))
    every = max(1, pages.count() // (4 * SAMPLE))
    some = rows.filter(F.pmod(F.xxhash64("k", "row"), F.lit(every)) == 0).filter(F.length("h").between(1, LONGEST)).limit(SAMPLE).collect()
    return [b.text for r in some for b in blocks(r["h"])]


def _cut(pages: list[str]) -> Iterator[list[list[Block]]]:
    """Blocks of the pages, about WORDS_TOGETHER bytes of text at a time."""
    held, size = [], 0
    for page in pages:
        held.append(blocks(page))
        size += sum(len(b.text) for b in held[-1])
        if size >= WORDS_TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def labelled(pages: list[str], labeller: Labeller) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Blocks and scores of each page."""
    for some in _cut(pages):
        x = Inputs(some)
        score, at = labeller.score(x), np.concatenate([[0], np.cumsum(x.sizes)])
        for k, cut in enumerate(some):
            yield cut, score[at[k]:at[k + 1]]


def extract(pages: DataFrame, labeller: Labeller, threshold: float = THRESHOLD, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            texts = ["\n\n".join(b.text for b, s in zip(cut, score) if s >= threshold) for cut, score in labelled([h or "" for h in batch.column(2).to_pylist()], labeller)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(f"`{html}`").alias("html")).mapInArrow(scan, "page_id long, url string, text string, n_chars long")


@query("op12_html_extract")
def op12_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, fit(sample_texts(pages)))
