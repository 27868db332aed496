"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learnt by cyclic boosting of
shallow trees; so have a few pairs of features. A score is the sum of the looked
up values, through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridfold.llm.common import filter_text, map_columns, text_or_empty

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_words", "top_word", "wordless",
    "upper", "digits", "points", "symbols", "bars", "shouts", "line_words", "distinct_lines", "capital_lines",
)
#: Training reads at most this many labelled rows, those of the smallest key hashes.
TRAIN_ROWS = 20_000


def features(text: str) -> tuple[float, ...]:
    """What the whole text looks like; a text without words is all zeros."""
    words = text.split()
    if not words:
        return (0.0,) * len(FEATURES)
    data = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    n, size, counts = len(words), max(1, int(data.sum()) - int(data[32]) - int(data[10])), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda chars: float(data[list(chars)].sum()) / size
    return (
        float(np.log1p(n)), size / n, len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
        sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / n,
        share(range(65, 91)), share(range(48, 58)), share(b".,;:'\"()-"), share(b"#$%&*@^~<>{}[]\\/_=+"), share(b"|"), share(b"!?"),
        min(n / len(lines), 1000.0), len(set(lines)) / len(lines), sum(x.lstrip()[:1].isupper() for x in lines) / len(lines),
    )


@dataclass
class Gam:
    """Bin edges, tables of single features and of pairs, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features, by additions of looked-up bins."""
        total = np.full(len(x), self.intercept)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edge, x[:, k], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(c) else np.empty(0) for c in x.T]


def _cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Best place to cut bins in two: gain over one leaf, and the first bin of the right."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + lam) + (g.sum() - gl) ** 2 / (h.sum() - hl + lam) - g.sum() ** 2 / (h.sum() + lam)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Values per bin of a tree of at most ``leaves`` leaves, grown best first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, a, k, b = max((*_cut(g[a:b], h[a:b], lam)[:1], a, a + _cut(g[a:b], h[a:b], lam)[1], b) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """One cut along one axis, then one along the other on either side."""
    best, values = 0.0, np.full(g.shape, g.sum() / (h.sum() + lam))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            out, gain = np.empty(a.shape), -(g.sum() ** 2) / (h.sum() + lam)
            for rows in (slice(0, k), slice(k, None)):
                gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
                more, cut = _cut(gs, hs, lam)
                gain += more + gs.sum() ** 2 / (hs.sum() + lam)
                for cols in (slice(0, cut), slice(cut, None)):
                    if len(gs[cols]):
                        out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + lam)
            if gain > best:
                best, values = gain, out.T if flip else out
    return best, values


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 40, n_pairs: int = 5, bins: int = 32,
            pair_bins: int = 8, leaves: int = 3, rate: float = 0.1, lam: float = 1.0) -> Gam:
    """Tables from rows of features and labels 0 or 1. In turn, each feature gets
    a small step along a shallow tree fitted to the Newton residuals; then the
    pairs that explain most of what is left get theirs. Without labels, or with
    one kind of label, every score is near the (smoothed) share of ones."""
    edges, coarse = _edges(x, bins), _edges(x, pair_bins)
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(p / (1 - p))), pair_edges=coarse)
    if not len(y):
        return model
    at = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]
    total = np.full(len(y), model.intercept)

    def residuals():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for k, where in enumerate(at):
            g, h = residuals()
            size = len(edges[k]) + 1
            step = rate * _tree(np.bincount(where, g, size), np.bincount(where, h, size), leaves, lam)
            model.tables[k] += step
            total += step[where]
    cells = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T)]

    def grid(i: int, j: int):
        g, h = residuals()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        where = cells[i] * shape[1] + cells[j]
        return where, (np.bincount(where, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = [(_pair_tree(*grid(i, j)[1], lam)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)]
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            where, (g, h) = grid(i, j)
            step = rate * _pair_tree(g, h, lam)[1]
            table += step
            total += step.ravel()[where]
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Gam:
    """The model for labels (doc_id, quality) whose crc32(doc_id) mod 5 is not 0:
    of these at most ``train_rows``, those with the smallest hashes of their
    doc_id. Null labels and labels without a document train nothing."""
    marks = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    known = text_or_empty(docs, "doc_id").join(F.broadcast(marks), "doc_id").select("doc_id", "quality", "text")

    def make():
        return lambda ids, quality, texts: {"doc_id": ids, "quality": quality, **_columns(texts)}

    names = ", ".join(f"{n} double" for n in FEATURES)
    sample = map_columns(known, f"doc_id long, quality double, {names}", make).toPandas()
    sample = sample.sort_values([*sample.columns])  # the same model whatever the order of tasks
    return fit_gam(sample[list(FEATURES)].to_numpy(dtype=float), sample["quality"].to_numpy(dtype=float))


def held_out(doc_id: str):
    """Whether crc32 of the id as text is divisible by 5; a null id counts so."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def _columns(texts: list[str]) -> dict[str, list[float]]:
    return dict(zip(FEATURES, map(list, zip(*map(features, texts)))))


def _scores(model: Gam, texts: list[str]) -> np.ndarray:
    return model.score(np.array([features(t) for t in texts], dtype=float))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; nothing but the text
    makes a feature.

    Null and empty texts are scored as texts without words; a null doc_id is
    held out; repeated rows are scored each and train each; without any label
    all scores are 0.5. An empty table gives an empty result; other columns are
    ignored.
    """
    model = train(docs, labels, train_rows)

    def make():
        def work(ids, out, texts):
            p = _scores(model, texts)
            return {"doc_id": ids, "held_out": out, "score": p.tolist(), "predicted": (p >= threshold).astype(int).tolist()}

        return work

    rows = text_or_empty(docs, "doc_id").withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "text")
    return map_columns(rows, "doc_id long, held_out boolean, score double, predicted int", make)


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the classifier accepts."""
    model = train(docs, labels, train_rows)
    return filter_text(docs, lambda: lambda texts: _scores(model, texts) >= threshold)
