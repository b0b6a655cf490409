"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles. Boosting goes round the features in turn; in each turn a
shallow tree on one feature's bins, fitted to the current residuals, is added to that feature's lookup table.
Then pairs of features whose residuals gain most from a joint split get tables of their own in the same way. A
score is the logistic of the sum of one entry from each table. Features are counts and shares of the whole
text; the model never sees an identifier, a language or a source."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ship

#: Byte classes whose shares of the text are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "shout": b"!?", "bar": b"|", "sign": b"#$%&*@^~<>{}[]\\_=+`",
    "stop": b".", "comma": b",;:", "quote": b"'\"()", "line": b"\n", "space": b" \t\r\x0b\f", "vowel": b"aeiouAEIOU", "high": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
}
FEATURES = [*CLASSES, "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "line_words", "repeated_lines", "longest_line", "sign_runs", "repeated_pairs"]
_MEMBERS = np.array([[b in set(c) for c in CLASSES.values()] for b in range(256)], np.float64)
_RUN = re.compile(rb"([^\w\s])\1\1")
#: Labelled rows that a model is fitted to at most.
FIT_ROWS = 20_000


def features(text: bytes) -> list[float]:
    """The features of a whole text; of an empty one all are 0."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBERS / n
    words = text.lower().split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    pairs = len(words) - 1
    return [
        *shares.tolist(), float(np.log1p(len(words))), float(lengths.sum() / m), float((lengths > 12).sum() / m), float((lengths <= 3).sum() / m),
        len(counts) / m, max(counts.values(), default=0) / m, len(words) / k, 1 - len(set(lines)) / k, max(map(len, lines), default=0) / n, sum(1 for _ in _RUN.finditer(text)) / m,
        1 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs > 0 else 0.0,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: one table entry for each feature and pair, added up."""
        at, total = self.bins(x), np.full(len(x), self.intercept)
        for table, b in zip(self.tables, at, strict=True):
            total += table[b]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-total))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree of up to ``leaves`` leaves on ordered bins: the value of each bin. Splits greedily where the gain is largest."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = np.arange(a + 1, b)
            if len(at):
                gain = np.where((h[at] - h[a] >= least) & (h[b] - h[at] >= least), worth(a, at) + worth(at, b) - worth(a, b), 0)
                best = max(best, (float(gain.max()), int(at[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    return np.concatenate([np.full(b - a, (g[b] - g[a]) / (h[b] - h[a] + 1)) for a, b in zip(cuts, cuts[1:], strict=False)])


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross cut of a grid: its gain and the value of each cell."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    a, b = np.meshgrid(np.arange(1, gradient.shape[0]), np.arange(1, gradient.shape[1]), indexing="ij")
    part = lambda s: (s[a, b], s[a, -1] - s[a, b], s[-1, b] - s[a, b], s[-1, -1] - s[a, -1] - s[-1, b] + s[a, b])
    gain = sum(p**2 / (q + 1) for p, q in zip(part(g), part(h), strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + 1)
    at = np.unravel_index(gain.argmax(), gain.shape)
    v = [p[at] / (q[at] + 1) for p, q in zip(part(g), part(h), strict=True)]
    rows, columns = int(a[at]), int(b[at])
    low = np.repeat([[v[0], v[1]], [v[2], v[3]]], [rows, gradient.shape[0] - rows], axis=0)
    return float(gain[at]), np.repeat(low, [columns, gradient.shape[1] - columns], axis=1)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.1, leaves: int = 3, least: float = 1.0) -> Model:
    """Fits to features ``x`` and labels ``y`` (0 or 1). Without both labels the model is its intercept."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model([np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])], float(np.log(p / (1 - p))), [], [], [], [])
    at = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in size]
    model.coarse = [np.arange(n) * coarse_bins // n if n > coarse_bins else np.arange(n) for n in size]
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, b in enumerate(at):
            if size[j] > 1:
                g, h = slopes()
                step = rate * _tree(np.bincount(b, g, size[j]), np.bincount(b, h, size[j]), leaves, least)
                model.tables[j] += step
                total += step[b]
    grid_at = [c[b] for c, b in zip(model.coarse, at, strict=True)]
    wide = [int(c[-1]) + 1 for c in model.coarse]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        both = grid_at[i] * wide[j] + grid_at[j]
        return _quadrants(*(np.bincount(both, s, wide[i] * wide[j]).reshape(wide[i], wide[j]) for s in (g, h)))

    gains = sorted(((grid(i, j)[0], i, j) for i, j in combinations(range(x.shape[1]), 2) if min(wide[i], wide[j]) > 1), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:pairs]]
    model.grids = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            step = rate * grid(i, j)[1]
            model.grids[k] += step
            total += step[grid_at[i], grid_at[j]]
    return model


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or b"") for t in texts.cast(pa.binary())]).reshape(-1, len(FEATURES))


def _measured(batches):
    for batch in batches:
        x = _matrix(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fits a model to the labelled rows of ``df`` that are not held out (see :func:`held_out`).

    Null texts count as empty. An empty table, no labels or labels of one kind give a model without tables, which
    scores every text alike. Of the labelled rows ``fit_rows`` are taken at most, the ids first in the order of a hash, and so a sample that does not follow
    the ids; an id that is labelled twice gives its larger label; rows without an id or a label do not count.
    What is collected is a row of numbers for each."""
    ship(df.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    joined = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # fit_rows rows of two numbers
    rows = joined.select("label", "text").mapInArrow(_measured, "label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy(np.float64)
    order = np.lexsort([*x.T, y])[:fit_rows]  # rows come in any order; sums of them should not
    return fit(x[order], y[order])


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``df``: id, score (0 to 1), predicted (1 if the score is ``threshold`` or more).

    Null texts count as empty, and empty texts are scored like any other. Repeated rows and null ids each have a row.
    An empty table gives no rows. Texts are read whole. Other columns are not read."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(model), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeper(model: Model, threshold: float):
    def run(batches):
        for batch in batches:
            keep = model.score(_matrix(batch.column("text"))) >= threshold
            yield batch.select(["row"]).filter(pa.array(keep))

    return run


def accepted(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, with all their columns, that score ``threshold`` or more.

    Rows are judged by their texts alone, so repeated rows stay or go together, whatever their ids. A null text counts as empty,
    and an empty one is scored like any other. Texts are read whole. An empty table gives no rows. No name of a column is in the way."""
    ship(df.sparkSession)
    packed = df.select(F.struct("*").alias("row"))
    rows = packed.select("row", F.col("row")[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_keeper(model, threshold), packed.schema).select("row.*")
