"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each has a vector: the sum of learned vectors of its
hashed tag path, the mean of learned vectors of its hashed words, its length, link share and place. A
bidirectional LSTM in numpy reads the sequence, so every block is classified in the context of the whole page.

The labeller is trained here, on pages made by a generator with random words: articles in many kinds of
markup among menus, headers, footers, sidebars, notices, adverts, forms and comments.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_results
from .html_blocks import TAG_HASHES, WORD_HASHES, Block, blocks, word_hash

TAG_SIZE, WORD_SIZE, HIDDEN, NUMBERS = 16, 8, 12, 3
TRAINING_PAGES, EPOCHS, RATE = 1000, 14, 0.01
THRESHOLD = 0.5
#: Pages that are labelled together, and the most block places among them.
BATCH_PAGES, BATCH_PLACES = 256, 40_000

_SYLLABLES = "an ba ce do el fi gor ha is jul ka lem mo nor ou pa qui re sal ti ur ve wen xi ya zor".split()
_HINTS = {
    "nav": "home about contact products login menu news search blog".split(),
    "ad": "advertisement sponsored offer sale buy deal shop".split(),
    "notice": "cookies accept privacy consent settings policy".split(),
    "footer": "copyright rights reserved terms privacy imprint".split(),
    "form": "subscribe email submit password newsletter sign".split(),
    "comments": "reply comment said posted ago likes".split(),
    "side": "related popular recent archive tags categories share".split(),
}


def _prose(r: random.Random, low: int, high: int, hints: list[str] = ()) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for i in range(len(words)):
        if hints and r.random() < 0.2:
            words[i] = r.choice(hints)
    odd = r.random()
    if odd < 0.06:  # one word again and again
        words = [w for w in words[: r.randint(1, 12)] for _ in range(r.randint(2, 12))]
    elif odd < 0.12:  # capitals or marks
        mark = r.choice(("!!", "###", "%%%", " |", "***"))
        words = [(w.upper() if r.random() < 0.7 else w) + mark for w in words]
    return " ".join(words).capitalize() + ("." if r.random() < 0.7 else "")


def _boilerplate(r: random.Random, kind: str) -> str:
    say = lambda a, b: _prose(r, a, b, _HINTS[kind])
    items = lambda n: "".join(f'<li><a href="/{k}">{say(1, 3)}</a></li>' for k in range(r.randint(2, n)))
    wrap = lambda names, tags="div section": f"{r.choice(tags.split())} {r.choice(('class', 'class', 'id'))}=\"{r.choice(names.split())}\""
    if kind == "nav":
        inner = f"<ul>{items(9)}</ul>" if r.random() < 0.7 else " ".join(f'<a href="/{k}">{say(1, 2)}</a>' for k in range(r.randint(3, 8)))
        return r.choice([f"<nav>{inner}</nav>", f"<header><h1>{say(1, 5)}</h1>{inner}</header>", f"<header>{say(1, 8)}<nav>{inner}</nav></header>", f"<{(w := wrap('menu navbar navigation topnav breadcrumb breadcrumbs'))}>{inner}</{w.split()[0]}>"])
    if kind == "footer":
        inner = r.choice([f"&copy; {say(2, 25)} &middot; {say(2, 12)}", f"<p>{say(3, 25)}</p><ul>{items(5)}</ul>", f"<p>{say(3, 20)}</p>"])
        return r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<{(w := wrap('footer copyright bottom'))}>{inner}</{w.split()[0]}>"])
    if kind == "side":
        inner = f"<h3>{say(1, 4)}</h3>" + r.choice([f"<ul>{items(7)}</ul>", f"<p>{say(4, 40)}</p>"])
        return r.choice([f"<aside>{inner}</aside>", f"<aside class=\"sidebar\">{inner}</aside>", f"<{(w := wrap('sidebar related widget share social'))}>{inner}</{w.split()[0]}>"])
    if kind == "form":
        return f"<form{r.choice(['', ' class=\"search\"', ' id=\"newsletter\"'])}><label>{say(1, 4)}</label><p>{say(2, 14)}</p><input name=\"x\"><button>{say(1, 2)}</button></form>"
    if kind == "comments":
        each = "".join(f"<{r.choice(['div class=\"comment\"', 'li'])}><p>{say(3, 40)}</p></div>" for _ in range(r.randint(1, 5)))
        return f"<{(w := wrap('comments comment replies disqus responses'))}><h3>{say(1, 3)}</h3>{each}</{w.split()[0]}>"
    names = {"ad": "ad ads advert advertisement sponsored banner promo", "notice": "cookie notice consent alert cookies gdpr popup"}[kind]
    w = wrap(names, "div div div section aside")
    return f"<{w}>" + r.choice([say(2, 40), f"<p>{say(3, 40)}</p>", f"{say(2, 20)}<button>{say(1, 2)}</button>"]) + f"</{w.split()[0]}>"


def made_page(seed: int) -> tuple[str, list[str]]:
    """A page and the texts of its content blocks."""
    r = random.Random(seed)
    content: list[str] = []

    def part() -> str:
        kind = r.random()
        if kind < 0.78:
            text = _prose(r, 1, r.choice((3, 15, 60, 120)))
            content.append(" ".join(text.split()))
            return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}"])
        if kind < 0.85:
            text = _prose(r, 1, 9)
            content.append(text)
            return f"<h2>{text}</h2>" if r.random() < 0.6 else f"<blockquote>{text}</blockquote>"
        if kind < 0.92:
            texts = [_prose(r, 1, 12) for _ in range(r.randint(1, 5))]
            content.extend(texts)
            return "<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>"
        if kind < 0.96:
            first, second = _prose(r, 1, 12), _prose(r, 1, 6)
            content.append(f"{first} {second}")
            return f'<p>{first} <a href="/x">{second}</a></p>'
        return _boilerplate(r, r.choice(["ad", "form", "side", "notice"]))

    title = _prose(r, 2, 12)
    before = "".join(_boilerplate(r, k) for k in r.sample(["nav", "nav", "ad", "notice", "side", "form"], r.randint(0, 4)))
    opens, closes = r.choice(
        [("<article>", "</article>")] * 6
        + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<section class="entry story">', "</section>"), ('<div role="main">', "</div>")]
    )
    body = ""
    if r.random() < 0.85:
        content.append(title)
        body += f"<h1>{title}</h1>"
    body += "".join(part() for _ in range(r.choice((1, 3, 8, 15, 40))))
    after = "".join(_boilerplate(r, k) for k in r.sample(["comments", "side", "ad", "form", "nav"], r.randint(0, 3)))
    if r.random() < 0.85:
        after += _boilerplate(r, "footer")
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{before}{opens}{body}{closes}{after}</body></html>"
    return (page if r.random() < 0.85 else page.removesuffix("</body></html>")), content


def _inputs(sequences: list[list[Block]]) -> tuple[np.ndarray, ...]:
    """Places and values of sparse inputs of sequences, padded to one length: (step, sequence) cells in row order."""
    steps, width = max(map(len, sequences)), len(sequences)
    mask = np.zeros((steps, width))
    numbers = np.zeros((steps, width, NUMBERS))
    tag_cell, tag_id, word_cell, word_id, word_weight = [], [], [], [], []
    for s, sequence in enumerate(sequences):
        n = len(sequence)
        for t, block in enumerate(sequence):
            cell = t * width + s
            mask[t, s] = 1
            numbers[t, s] = (np.log1p(len(block.text)) / 5, block.link_share, t / n)
            tag_cell += [cell] * len(block.path)
            tag_id += block.path
            words = list(map(word_hash, block.text.split(" ")))
            word_cell += [cell] * len(words)
            word_id += words
            word_weight += [1 / len(words)] * len(words)
    as_ints = lambda x: np.array(x, np.int64)
    return mask, numbers, as_ints(tag_cell), as_ints(tag_id), as_ints(word_cell), as_ints(word_id), np.array(word_weight)


def _spread(cells: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ``cells``."""
    out = np.zeros((n, values.shape[1]))
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(cells, values[:, k], n)
    return out


class Labeller:
    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @staticmethod
    def fresh(seed: int = 3) -> Labeller:
        random_ = np.random.default_rng(seed)
        size = TAG_SIZE + WORD_SIZE + NUMBERS
        p = {"tags": random_.normal(0, 0.3, (TAG_HASHES, TAG_SIZE)), "words": random_.normal(0, 0.1, (WORD_HASHES, WORD_SIZE)), "out": random_.normal(0, 0.3, 2 * HIDDEN), "out0": np.zeros(1)}
        for d in "fb":
            p[f"x{d}"] = random_.normal(0, 0.25, (size, 4 * HIDDEN))
            p[f"h{d}"] = random_.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            p[f"0{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        return Labeller(p)

    def _features(self, inputs: tuple[np.ndarray, ...]) -> np.ndarray:
        mask, numbers, tag_cell, tag_id, word_cell, word_id, weight = inputs
        n = mask.size
        tags = _spread(tag_cell, self.p["tags"][tag_id], n)
        words = _spread(word_cell, self.p["words"][word_id] * weight[:, None], n)
        return np.concatenate([tags, words, numbers.reshape(n, NUMBERS)], 1).reshape(*mask.shape, -1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None) -> np.ndarray:
        """States of one direction; cells beyond a sequence's end keep the state before."""
        h = c = np.zeros((mask.shape[1], HIDDEN))
        u, gates_x = self.p[f"h{d}"], x @ self.p[f"x{d}"] + self.p[f"0{d}"]
        out = np.zeros((*mask.shape, HIDDEN))
        steps = range(len(mask)) if d == "f" else range(len(mask) - 1, -1, -1)
        for t in steps:
            g = gates_x[t] + h @ u
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o, a = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * a
            tc = np.tanh(c2)
            h2 = o * tc
            if trace is not None:
                trace.append((t, i, f, o, a, c, h, tc, m))
            c, h = m * c2 + (1 - m) * c, m * h2 + (1 - m) * h
            out[t] = h
        return out

    def scores(self, sequences: list[list[Block]]) -> list[np.ndarray]:
        """The score of each block of each sequence; all sequences have blocks."""
        inputs = _inputs(sequences)
        x = self._features(inputs)
        h = np.concatenate([self._run(x, inputs[0], d, None) for d in "fb"], 2)
        p = 1 / (1 + np.exp(-(h @ self.p["out"] + self.p["out0"])))
        return [p[: len(s), k] for k, s in enumerate(sequences)]

    def _gradients(self, sequences: list[list[Block]], targets: np.ndarray) -> dict[str, np.ndarray]:
        inputs = _inputs(sequences)
        mask = inputs[0]
        x = self._features(inputs)
        traces = {d: [] for d in "fb"}
        h = np.concatenate([self._run(x, mask, d, traces[d]) for d in "fb"], 2)
        p = 1 / (1 + np.exp(-(h @ self.p["out"] + self.p["out0"])))
        error = (p - targets) * mask / mask.sum()
        g = {"out": np.tensordot(error, h, ([0, 1], [0, 1])), "out0": np.array([error.sum()])}
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            into = error[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            wx, u = self.p[f"x{d}"], self.p[f"h{d}"]
            gx, gu, gb = np.zeros_like(wx), np.zeros_like(u), np.zeros(4 * HIDDEN)
            dh = dc = np.zeros((mask.shape[1], HIDDEN))
            for t, i, f, o, a, c, hp, tc, m in reversed(traces[d]):
                dh = dh + into[t]
                dh2, dc2 = dh * m, dc * m
                dc2 = dc2 + dh2 * o * (1 - tc**2)
                gates = np.concatenate([dc2 * a * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - a**2)], 1)
                gx += x[t].T @ gates
                gu += hp.T @ gates
                gb += gates.sum(0)
                dx[t] += gates @ wx.T
                dh = gates @ u.T + dh * (1 - m)
                dc = dc2 * f + dc * (1 - m)
            g |= {f"x{d}": gx, f"h{d}": gu, f"0{d}": gb}
        flat = dx.reshape(mask.size, -1)
        _, _, tag_cell, tag_id, word_cell, word_id, weight = inputs
        g["tags"] = _spread(tag_id, flat[tag_cell, :TAG_SIZE], TAG_HASHES)
        g["words"] = _spread(word_id, flat[word_cell, TAG_SIZE : TAG_SIZE + WORD_SIZE] * weight[:, None], WORD_HASHES)
        return g

    def fit(self, pages: list[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Labeller:
        """Adam over pages of similar length together."""
        r = random.Random(seed)
        pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
        batches = [pages[i : i + 24] for i in range(0, len(pages), 24)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            r.shuffle(batches)
            for batch in batches:
                targets = np.zeros((max(len(s) for s, _ in batch), len(batch)))
                for k, (s, y) in enumerate(batch):
                    targets[: len(s), k] = y
                step += 1
                for k, g in self._gradients([s for s, _ in batch], targets).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def labelled_page(seed: int) -> tuple[list[Block], np.ndarray]:
    """The blocks of a made page and which of them are content."""
    page, content = made_page(seed)
    left: dict[str, int] = {}
    for text in content:
        left[text] = left.get(text, 0) + 1
    found = blocks(page)
    y = np.zeros(len(found))
    for i, block in enumerate(found):
        if left.get(block.text, 0):
            left[block.text] -= 1
            y[i] = 1
    return found, y


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller, trained once in a process. Training is the same everywhere."""
    return Labeller.fresh().fit([labelled_page(seed) for seed in range(TRAINING_PAGES)])


def _label(labeller: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < BATCH_PAGES and len(pages[order[stop]]) * (stop - start + 1) <= BATCH_PLACES:
            stop += 1
        some = order[start:stop]
        for i, s in zip(some, labeller.scores([pages[i] for i in some]), strict=True):
            out[i] = s
        start = stop
    return out


def extract(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """Rows ``row, text, out``; ``out.main`` is the main text, content blocks joined by an empty line, ``out.n_blocks`` the number of all blocks.

    A null, empty or blockless page has an empty main text. Whole pages are read, however long. Repeated rows give equal
    texts; other columns play no part.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained().p)

    def compute(sources: list[bytes]) -> list[pa.Array]:
        labeller = Labeller(model.value)
        texts, counts = [], []
        for start in range(0, len(sources), 1024):
            found = [blocks(s.decode("utf-8", "replace")) for s in sources[start : start + 1024]]
            for page, scores in zip(found, _label(labeller, found), strict=True):
                texts.append("\n\n".join(b.text for b, s in zip(page, scores, strict=True) if s >= THRESHOLD))
                counts.append(len(page))
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int32())]

    return with_results(pages, html_col, pages.columns if keep is None else keep, compute, "main string, n_blocks int")
