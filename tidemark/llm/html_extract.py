"""The main text of web pages by a linear-chain conditional random field over their leaf blocks.

Each leaf block has features of its ancestors (tags, roles, words in class and id that sites use) and of its text (length, links,
punctuation, place). The chain has two labels and transitions that depend on whether neighbours share their innermost box. It is
trained by full-batch gradient steps on the conditional likelihood of labelled pages, which are made of the texts of at
most ``SAMPLE`` pages of the table (chosen by a hash of their id, those of at most ``SAMPLE_CHARS`` characters first, until
``SAMPLE_TOTAL`` characters are reached) laid out in many usual ways. Viterbi decoding labels every block
of every page; the article's blocks are joined by one space.

Defined results: null or empty html, pages without text and pages without an article give an empty text; unclosed and stray tags are
read as browsers do; scripts, styles, comments and form controls never count; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.html_blocks import Leaf, labelled, leaves, passages
from tidemark.llm.shipping import ship

SAMPLE, LAYOUTS, STEPS, RATE, DECAY = 200, 900, 120, 0.3, 1e-3
SAMPLE_CHARS, SAMPLE_TOTAL = 100_000, 20_000_000  # bounds of what the labelled pages are made of
Model = tuple[dict[str, float], np.ndarray]


def _chain(scores: np.ndarray, joined: np.ndarray, moves: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums (log) of padded chains, and the log of each chain's total."""
    pages, size = scores.shape
    state = np.stack([np.zeros_like(scores), scores], 2)
    ahead, behind = np.zeros((pages, size, 2)), np.zeros((pages, size, 2))
    ahead[:, 0] = state[:, 0]
    for t in range(1, size):
        step = moves[joined[:, t]]
        new = np.logaddexp(ahead[:, t - 1, 0, None] + step[:, 0], ahead[:, t - 1, 1, None] + step[:, 1]) + state[:, t]
        ahead[:, t] = np.where(held[:, t, None], new, ahead[:, t - 1])
    for t in range(size - 2, -1, -1):
        step, later = moves[joined[:, t + 1]], state[:, t + 1] + behind[:, t + 1]
        new = np.logaddexp(step[:, :, 0] + later[:, 0, None], step[:, :, 1] + later[:, 1, None])
        behind[:, t] = np.where(held[:, t + 1, None], new, 0)
    return ahead, behind, np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])


def learn(pages: list[list[Leaf]]) -> Model:
    """Weights of the features for the article's label, and transitions by [same box, from, to]."""
    pages = [p for p in pages if p]
    names = {n: i for i, n in enumerate(sorted({n for p in pages for x in p for n in x.features}))}
    count, size = len(pages), max(map(len, pages))
    held = np.array([[t < len(p) for t in range(size)] for p in pages])
    joined = np.array([[int(0 < t < len(p) and p[t].box == p[t - 1].box) for t in range(size)] for p in pages])
    truth = np.array([[max(0, p[t].truth) if t < len(p) else 0 for t in range(size)] for p in pages])
    width = max(len(x.features) for p in pages for x in p)
    active = np.full((count, size, width), len(names))
    for i, p in enumerate(pages):
        for t, x in enumerate(p):
            active[i, t, : len(x.features)] = [names[n] for n in x.features]
    weights, moves = np.zeros(len(names) + 1), np.zeros((2, 2, 2))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    blocks = held.sum()
    for _ in range(STEPS):
        weights[-1] = 0
        ahead, behind, total = _chain(weights[active].sum(2), joined, moves, held)
        own = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        off = np.where(held, truth - own, 0)
        slope = np.bincount(active.ravel(), np.repeat(off.ravel(), width), len(weights)) - DECAY * blocks / 100 * weights
        turn = np.zeros_like(moves)
        state = np.stack([np.zeros_like(own), weights[active].sum(2)], 2)
        for a in (0, 1):
            for b in (0, 1):
                both = ahead[:, :-1, a] + moves[joined[:, 1:], a, b] + state[:, 1:, b] + behind[:, 1:, b] - total[:, None]
                met = (truth[:, :-1] == a) & (truth[:, 1:] == b)
                gap = np.where(held[:, 1:], met - np.exp(np.minimum(both, 0)), 0)
                turn[:, a, b] = np.bincount(joined[:, 1:].ravel(), gap.ravel(), 2)
        turn -= DECAY * blocks / 100 * moves
        seen_w += slope**2
        seen_m += turn**2
        weights += RATE * slope / np.sqrt(seen_w)
        moves += RATE * turn / np.sqrt(seen_m)
    return {n: float(weights[i]) for n, i in names.items()}, moves


def article(blocks: list[Leaf], model: Model) -> list[bool]:
    """Viterbi labels of a page's blocks."""
    weights, moves = model
    step = moves.tolist()
    paths, best, box = [], (0.0, 0.0), None
    for i, x in enumerate(blocks):
        score = sum(weights.get(n, 0.0) for n in x.features)
        if i == 0:
            best = (0.0, score)
        else:
            move = step[int(x.box == box)]
            to0 = (best[0] + move[0][0], best[1] + move[1][0])
            to1 = (best[0] + move[0][1], best[1] + move[1][1])
            paths.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            best = (max(to0), max(to1) + score)
        box = x.box
    if not blocks:
        return []
    labels = [int(best[1] > best[0])]
    for came in reversed(paths):
        labels.append(came[labels[-1]])
    return [bool(v) for v in reversed(labels)]


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> Model:
    """Train on layouts of the texts of a bounded sample of the pages."""
    ship(pages.sparkSession)
    fitting = pages.where(F.length(pages[html]) > 0)
    sample = fitting.select(
        (F.length(fitting[html]) > SAMPLE_CHARS).alias("long"), F.xxhash64(fitting[page_id]).alias("order"), fitting[html].alias("html")
    ).orderBy("long", "order", "html").limit(SAMPLE)

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, names, used = [], [], 0
        for frame in frames:
            for page in frame.html:
                if used and used + len(page) > SAMPLE_TOTAL:
                    continue
                used += len(page)
                long, short = passages(page)
                texts += long
                names += short
        texts, names = texts or ["One sentence of plain text, as good as any other one."], names or ["Name"]
        weights, moves = learn([leaves(labelled(texts, names, seed)) for seed in range(LAYOUTS)])
        rows = [*weights.items(), *((f"move:{a}{b}{c}", float(moves[a, b, c])) for a in (0, 1) for b in (0, 1) for c in (0, 1))]
        yield pd.DataFrame(rows, columns=["name", "weight"])

    found = sample.mapInPandas(train, "name string, weight double").toPandas()  # a few hundred rows
    weights = dict(zip(found.name, found.weight))
    moves = np.array([weights.pop(f"move:{i >> 2}{i >> 1 & 1}{i & 1}", 0.0) for i in range(8)]).reshape(2, 2, 2)
    return weights, moves


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    model = fit(pages, page_id, html)

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(page: str | None) -> str:
            blocks = leaves(page or "")
            return " ".join(x.text for x, keep in zip(blocks, article(blocks, model)) if keep)

        for part in parts:
            yield part.map(one)

    shown = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), extract(pages[html]).alias("text"))
    return shown.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{folder}/pages.parquet"))
