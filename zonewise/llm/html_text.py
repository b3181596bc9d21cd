"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with its tag path (tags, classes, ids, roles) and its words. A
bidirectional LSTM in numpy reads hashed embeddings of both, with a few measures of the block, and labels every block
with the whole page as context. It is trained on a bounded sample of the pages themselves: blocks are labelled by the
sectioning elements they stand in, and the sample is varied, with sections renamed and page furniture added, so that the
network learns from context and wording what single names do not say.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewise.llm import common

PATH_BUCKETS, WORD_BUCKETS, PATH_SIZE, WORD_SIZE, HIDDEN = 1024, 2048, 16, 8, 24
# Pages the network is trained on at most, and bytes of such a page at most (longer ones are no training pages).
TRAINING_PAGES, TRAINING_BYTES, VARIANTS = 400, 100_000, 3
EPOCHS, RATE, BATCH = 6, 0.01, 32
# Blocks of pages that are labelled together.
BLOCKS_AT_ONCE = 8_000
# Hashed ids that are looked up together.
IDS_AT_ONCE = 400_000

# HTML's elements without content, without text, and those that end a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"option", "label", "button"}
MAIN_SECTIONS = frozenset("article main".split())
FURNITURE = frozenset("nav aside footer header form button select textarea label head title menu dialog fieldset".split())
FURNITURE_NAMES = re.compile(
    r"(^|[-_ ])(ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|footer|header|login|masthead|menu|"
    r"modal|nav\w*|newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|"
    r"subscribe|tags|toolbar|widget)([-_ ]|\d|$)"
)
MAIN_NAMES = re.compile(r"(^|[-_ ])(article|content|entry|main|post|story|text)([-_ ]|$)")


@dataclass
class Block:
    path: tuple[str, ...]  # from the root: tag, then .class, #id and @role of each element
    text: str
    linked: int = 0  # characters inside links
    words: list[str] = field(default_factory=list)


class _Reader(HTMLParser):
    """Cuts a page into leaf blocks. Markup that is not closed, or closed twice, does no harm."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(part for _, parts in self.open for part in parts)
            self.blocks.append(Block(path, text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_block()
        if tag in VOID:
            self.parts.append(" ")
            return
        if tag in CLOSES_P:
            # A paragraph ends where a block begins, with whatever is open inside it.
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == "p"), None)
            if at is not None:
                self._pop(at)
        given = {k: v or "" for k, v in attrs}
        parts = [tag]
        parts += [f".{c}" for c in given.get("class", "").lower().split()]
        parts += [f"#{i}" for i in given.get("id", "").lower().split()]
        parts += [f"@{r}" for r in given.get("role", "").lower().split()]
        if tag == "a" and self.links:
            at = max(i for i, (t, _) in enumerate(self.open) if t == "a")
            self._pop(at)
        self.open.append((tag, tuple(parts)))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        # Only svg, math and what stands in them can close itself.
        foreign = tag in FOREIGN or any(t in FOREIGN for t, _ in self.open)
        self.handle_starttag(tag, attrs)
        if foreign and tag not in VOID:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_block()
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            self._pop(at)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in page order; white space in a block is one space each."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._end_block()
    return reader.blocks


def is_main(path: tuple[str, ...]) -> bool:
    """Label for training: inside a main section and inside no page furniture."""
    inside = False
    for part in path:
        if part in FURNITURE or part[0] in ".#@" and FURNITURE_NAMES.search(part[1:]):
            return False
        inside |= part in MAIN_SECTIONS or part[0] in ".#@" and bool(MAIN_NAMES.search(part[1:]))
    return inside


def _bucket(text: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") % n


class _Buckets(dict):
    """Hash bucket of each string it is asked for; remembers the strings of a batch or so."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, text: str) -> int:
        if len(self) > 300_000:
            self.clear()
        at = self[text] = _bucket(text, self.n)
        return at


class Features:
    """Vectors of blocks: bags of hashed path parts and words, and six measures."""

    def __init__(self):
        self.path, self.word = _Buckets(PATH_BUCKETS), _Buckets(WORD_BUCKETS)

    def of(self, page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        path, word = self.path.__getitem__, self.word.__getitem__
        paths = [list(map(path, (*b.path, f"leaf {b.path[-1] if b.path else ''}"))) for b in page]
        # Every word counts: furniture is told by what it says, wherever in the block.
        words = [list(map(word, b.text.lower().split())) for b in page]
        chars = np.array([len(b.text) for b in page], float)
        linked = np.array([b.linked for b in page], float)
        counts = np.array([len(w) for w in words], float)
        stops = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") for b in page], float)
        measures = [
            np.log1p(chars) / 8, np.minimum(1, linked / np.maximum(chars, 1)), np.log1p(counts) / 6,
            stops / (1 + counts), np.arange(len(page)) / max(1, len(page)), np.ones(len(page)),
        ]
        return paths, words, np.stack(measures, axis=1)


def _runs(bags: list[list[int]]):
    """Slices of the bags that hold about IDS_AT_ONCE ids each, so that long paths cost time but no memory."""
    start = held = 0
    for at, bag in enumerate(bags):
        if held and held + len(bag) > IDS_AT_ONCE:
            yield slice(start, at)
            start, held = at, 0
        held += len(bag)
    yield slice(start, len(bags))


def _flat(bags: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bags], np.int64)
    return sizes, np.fromiter(itertools.chain.from_iterable(bags), np.int64, int(sizes.sum()))


def _mean_rows(table: np.ndarray, bags: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(bags), table.shape[1]))
    for run in _runs(bags):
        sizes, flat = _flat(bags[run])
        if len(flat):
            starts = np.cumsum(sizes) - sizes
            filled = sizes > 0
            sums = np.zeros((len(sizes), table.shape[1]))
            sums[filled] = np.add.reduceat(table[flat], starts[filled], axis=0)
            out[run] = sums / np.maximum(sizes, 1)[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


INPUT = PATH_SIZE + WORD_SIZE + 6


def new_parameters() -> dict[str, np.ndarray]:
    r = np.random.default_rng(3)
    out = {"path": r.normal(0, 0.3, (PATH_BUCKETS, PATH_SIZE)), "word": r.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE))}
    for way in ("f", "b"):
        out[f"x{way}"] = r.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
        out[f"h{way}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        out[f"c{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # the forget gate starts open
    return out | {"out": r.normal(0, 0.2, 2 * HIDDEN + INPUT), "bias": np.zeros(1)}


def _lstm(p: dict, way: str, x: np.ndarray, mask: np.ndarray):
    """States (pages, steps, HIDDEN) of one direction; padded steps pass the state on. Also what the way back needs."""
    if way == "b":
        x, mask = x[:, ::-1], mask[:, ::-1]
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    projected = x @ p[f"x{way}"] + p[f"c{way}"]
    states, kept = np.zeros((n, steps, HIDDEN)), []
    for t in range(steps):
        z = projected[:, t] + h @ p[f"h{way}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        new_c = f * c + i * g
        tanh_c = np.tanh(new_c)
        kept.append((h, c, i, f, o, g, tanh_c, m))
        h, c = m * (o * tanh_c) + (1 - m) * h, m * new_c + (1 - m) * c
        states[:, t] = h
    return (states[:, ::-1] if way == "b" else states), kept


def _lstm_back(p: dict, way: str, x: np.ndarray, kept: list, d_states: np.ndarray, grads: dict) -> np.ndarray:
    """Gradients of one direction; returns the gradient of x."""
    if way == "b":
        x, d_states = x[:, ::-1], d_states[:, ::-1]
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
    dh, dc = np.zeros_like(d_states[:, 0]), np.zeros_like(d_states[:, 0])
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, tanh_c, m = kept[t]
        dh = dh + d_states[:, t]
        inner_h, inner_c = m * dh, m * dc
        d_new_c = inner_c + inner_h * o * (1 - tanh_c**2)
        dz = np.concatenate(
            [d_new_c * g * i * (1 - i), d_new_c * c * f * (1 - f), inner_h * tanh_c * o * (1 - o), d_new_c * i * (1 - g**2)],
            axis=1,
        )
        dz_all[:, t] = dz
        grads[f"h{way}"] += h.T @ dz
        dh = dz @ p[f"h{way}"].T + (1 - m) * dh
        dc = d_new_c * f + (1 - m) * dc
    grads[f"x{way}"] += np.tensordot(x, dz_all, ([0, 1], [0, 1]))
    grads[f"c{way}"] += dz_all.sum(axis=(0, 1))
    dx = dz_all @ p[f"x{way}"].T
    return dx[:, ::-1] if way == "b" else dx


def _inputs(p: dict, pages: list) -> tuple[np.ndarray, np.ndarray]:
    """Padded inputs (pages, steps, INPUT) and the mask of real blocks."""
    sizes = [len(m) for _, _, m in pages]
    x, mask = np.zeros((len(pages), max(sizes), INPUT)), np.zeros((len(pages), max(sizes)))
    every = np.hstack(
        [
            _mean_rows(p["path"], [b for paths, _, _ in pages for b in paths]),
            _mean_rows(p["word"], [b for _, words, _ in pages for b in words]),
            np.concatenate([m for _, _, m in pages]),
        ]
    )
    at = 0
    for k, n in enumerate(sizes):
        x[k, :n], mask[k, :n] = every[at : at + n], 1
        at += n
    return x, mask


def _forward(p: dict, x: np.ndarray, mask: np.ndarray):
    forward, kept_f = _lstm(p, "f", x, mask)
    backward, kept_b = _lstm(p, "b", x, mask)
    features = np.concatenate([forward, backward, x], axis=2)
    return _sigmoid(features @ p["out"] + p["bias"]), features, kept_f, kept_b


def train(pages: list[list[Block]], labels: list[list[bool]]) -> dict[str, np.ndarray]:
    """Train by back-propagation through time with Adam. Pages without blocks are left out."""
    p = new_parameters()
    features = Features()
    rows = [(features.of(b), np.array(y, float)) for b, y in zip(pages, labels, strict=True) if b]
    # Pages of like length share a batch, so that little is padded.
    rows.sort(key=lambda r: len(r[1]))
    batches = [rows[i : i + BATCH] for i in range(0, len(rows), BATCH)]
    order = random.Random(5)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order.shuffle(batches)
        for batch in batches:
            x, mask = _inputs(p, [b for b, _ in batch])
            y = np.zeros_like(mask)
            for k, (_, labels_of) in enumerate(batch):
                y[k, : len(labels_of)] = labels_of
            score, state, kept_f, kept_b = _forward(p, x, mask)
            error = (score - y) * mask / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            grads["out"] = np.tensordot(state, error, ([0, 1], [0, 1]))
            grads["bias"] = error.sum(keepdims=True).reshape(1)
            d = error[:, :, None] * p["out"]
            dx = d[:, :, 2 * HIDDEN :].copy()
            dx += _lstm_back(p, "f", x, kept_f, d[:, :, :HIDDEN], grads)
            dx += _lstm_back(p, "b", x, kept_b, d[:, :, HIDDEN : 2 * HIDDEN], grads)
            for k, ((paths, words, _), _) in enumerate(batch):
                for name, bags, at in (("path", paths, 0), ("word", words, PATH_SIZE)):
                    size = p[name].shape[1]
                    shares = dx[k, : len(bags), at : at + size]
                    for run in _runs(bags):
                        counts, flat = _flat(bags[run])
                        share = shares[run] / np.maximum(counts, 1)[:, None]
                        np.add.at(grads[name], flat, np.repeat(share, counts, axis=0))
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p


def label(p: dict, pages: list[list[Block]], features: Features) -> list[np.ndarray]:
    """Which blocks of each page are main text."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    while order:
        # The longest page of a group sets its width.
        take = [order.pop()]
        while order and (len(take) + 1) * len(pages[take[0]]) <= BLOCKS_AT_ONCE and 2 * len(pages[order[-1]]) >= len(pages[take[0]]):
            take.append(order.pop())
        x, mask = _inputs(p, [features.of(pages[i]) for i in take])
        score = _forward(p, x, mask)[0]
        for k, i in enumerate(take):
            out[i] = score[k, : len(pages[i])] >= 0.5
    return out


# Names that variants of the training pages use, and wording of furniture.
_MAIN_VARIANTS = [
    ("article",), ("main",), ("main", "article"), ("div", "#content"), ("div", ".content"), ("div", ".post-content"),
    ("section", ".article-body"), ("div", "#main"), ("div", ".entry-content"), ("div", ".story"), ("main", "#content"),
]
_ADDED = [
    ("before", ("header",), "p"), ("before", ("header", ".site-header"), "h1"), ("before", ("div", ".header"), "p"),
    ("before", ("div", ".cookie-notice"), "p"), ("before", ("div", "#cookie-consent", "@dialog"), "p"),
    ("before", ("div", ".notice"), "p"), ("before", ("ul", ".menu"), "li"), ("before", ("div", ".navbar"), "a"),
    ("before", ("div", ".breadcrumbs"), "a"), ("inside", ("aside",), "p"), ("inside", ("div", ".ad"), ""),
    ("inside", ("div", ".advert"), "p"), ("inside", ("div", ".promo"), "p"), ("inside", ("form",), "label"),
    ("inside", ("div", ".share"), "a"), ("inside", ("div", ".related"), "li"), ("inside", ("div", ".newsletter"), "p"),
    ("after", ("aside", ".sidebar"), "p"), ("after", ("div", "#sidebar"), "li"), ("after", ("div", ".sidebar"), "p"),
    ("after", ("section", "#comments"), "p"), ("after", ("div", ".comments"), "p"), ("after", ("div", ".comment"), "p"),
    ("after", ("ol", ".comment-list"), "li"), ("after", ("form",), "label"), ("after", ("form", "#search"), "button"),
    ("after", ("div", ".footer"), "p"), ("after", ("footer", "#footer"), "p"), ("after", ("div", ".sponsored"), "p"),
    ("end", ("section", "#comments"), "p"), ("end", ("div", ".comments"), "p"), ("end", ("aside",), "p"),
]


def variant(page: list[Block], labels: list[bool], draw: random.Random) -> tuple[list[Block], list[bool]]:
    """The page with its main section renamed and furniture added that speaks like the page itself."""
    blocks_out, labels_out = [], []
    name = draw.choice(_MAIN_VARIANTS)
    for b, y in zip(page, labels, strict=True):
        path = tuple(q for part in b.path for q in (name if part in MAIN_SECTIONS and y else (part,)))
        blocks_out.append(Block(path, b.text, b.linked))
        labels_out.append(y)
    spoken = [b.text for b in page if len(b.text) > 1]
    for place, parts, leaf in draw.sample(_ADDED, draw.randint(1, 6)):
        main = [i for i, y in enumerate(labels_out) if y]
        if not main or not spoken:
            break
        inside = place in ("inside", "end")
        root = blocks_out[main[0]].path[: -1] if inside else ("html", "body")
        at = {
            "before": main[0], "inside": draw.choice(main), "end": main[-1] + 1, "after": main[-1] + 1
        }[place]
        for _ in range(draw.randint(1, 4)):
            text = draw.choice(spoken)
            if leaf in ("a", "li", "label", "button"):
                text = " ".join(text.split()[: draw.randint(1, 4)])
            path = (*root, *parts, *((leaf,) if leaf else ()))
            blocks_out.insert(at, Block(path, text, len(text) if leaf in ("a", "li") else 0))
            labels_out.insert(at, False)
    return blocks_out, labels_out


def fit(pages: DataFrame) -> dict[str, np.ndarray]:
    """Train on at most TRAINING_PAGES pages, those with the smallest hashes of their ids, and variants of them."""
    small = pages.where(F.octet_length("html") <= TRAINING_BYTES)
    ids = small.select("page_id").where("page_id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(TRAINING_PAGES)
    rows = (
        small.select("page_id", "html")
        .join(F.broadcast(chosen), "page_id")
        .orderBy("page_id", "html")
        .limit(TRAINING_PAGES)
        .collect()
    )
    draw = random.Random(17)
    sample, labels = [], []
    for row in rows:
        page = blocks(row.html)
        y = [is_main(b.path) for b in page]
        for b, z in [(page, y), *(variant(page, y, draw) for _ in range(VARIANTS))]:
            sample.append(b)
            labels.append(z)
    return train(sample, labels)


def extract(pages: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url, text and n_chars of each page: its main blocks in page order, joined by two line feeds.

    A null or empty html has no blocks and an empty text. Whole pages are read; broken markup is read as far as it
    makes sense. Repeated pages get equal texts; no pages give none. Other columns are ignored.
    """
    shared = common.prepare(pages.sparkSession).sparkContext.broadcast(p)

    def run(batches):
        features = Features()
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = [blocks(t) for t in batch.column(2).to_pylist()]
            chosen = label(shared.value, cut, features)
            out = ["\n\n".join(b.text for b, y in zip(page, main, strict=True) if y) for page, main in zip(cut, chosen, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
