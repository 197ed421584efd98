"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table per feature over its bins, and one per chosen pair of
features over coarser bins. A score is the logistic of the sum of one entry of each table, so scoring is bin search
and table addition over whole Arrow batches. Fitting uses a bounded sample of labelled rows (``max_labels``).
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FEATURES = (
    "log_words", "word_length", "symbols", "exclaims", "upper", "digits", "points", "bars", "dup_lines",
    "distinct_words", "top_word", "repeats", "line_words", "short_words", "non_ascii",
)
MAX_LABELS = 20_000
_CLASS = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s in "#*$%&<>" else 2 if _s in "!?" else 3 if _s.isupper() else 4 if _s.isdigit() else 5 if _s in ".,;:" else 6 if _s == "|" else 7 if _c > 127 else 0


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text; null as empty."""
    text = text or ""
    out = np.zeros(len(FEATURES))
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(codes, 0x24F)], minlength=8)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = max(1, int(lengths.sum()))
    out[:] = (
        np.log1p(n), chars / n, kinds[1] / n, kinds[2] / n, kinds[3] / chars, kinds[4] / chars, kinds[5] / n, kinds[6] / n,
        1 - len(set(lines)) / len(lines), len(counts) / n, max(counts.values()) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0, n / len(lines), float((lengths <= 3).mean()), kinds[7] / chars,
    )
    return out


def _leaves(g: np.ndarray, h: np.ndarray, cuts: int, lam: float) -> np.ndarray:
    """A tree over ordered bins: up to ``cuts`` best cuts, one leaf value for each bin."""
    edges = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    score = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + lam)
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = score(a, m) + score(m, b) - score(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], int(m[k]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """The best pair of one cut on each axis of a two-way histogram: its gain and the leaf value for each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros(g.shape)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + lam)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = []
            for c in (cg, ch):
                a, b, d = c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j]
                parts.append((a, b, d, c[-1, -1] - a - b - d))
            gain = sum(x * x / (y + lam) for x, y in zip(*parts, strict=True)) - whole
            if gain > best:
                best = gain
                v = [x / (y + lam) for x, y in zip(*parts, strict=True)]
                out = np.empty(g.shape)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return best, out


class Gam:
    """Bins, tables and intercept. ``score(x)`` takes rows of features and gives probabilities of label 1."""

    def __init__(self, edges, coarse, intercept, tables, pairs):
        self.edges, self.coarse, self.intercept, self.tables, self.pairs = edges, coarse, intercept, tables, pairs

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 200, n_pairs: int = 6, rate: float = 0.1, lam: float = 2.0) -> "Gam":
        """Fit to features x and labels y (0 or 1). No rows, or one class only: the intercept alone, smoothed towards one half."""
        n, d = len(y), x.shape[1]
        cut = lambda k: [np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) if n else np.zeros(0) for j in range(d)]
        edges, coarse = cut(bins), cut(coarse_bins)
        p0 = (y.sum() + 1) / (n + 2)
        model = cls(edges, coarse, float(np.log(p0 / (1 - p0))), [np.zeros(len(e) + 1) for e in edges], [])
        if not 0 < y.sum() < n:
            return model
        b = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)]
        f = np.full(n, model.intercept)
        for _ in range(rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                k = len(edges[j]) + 1
                step = rate * _leaves(np.bincount(b[j], y - p, k), np.bincount(b[j], p * (1 - p), k), 3, lam)
                model.tables[j] += step
                f += step[b[j]]
        c = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(d)]

        def grids(i, j):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cell, p = c[i] * shape[1] + c[j], 1 / (1 + np.exp(-f))
            return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

        gains = sorted(((-_quadrants(*grids(i, j)[1:], lam)[0], i, j) for i in range(d) for j in range(i)))
        model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:n_pairs] if gain < 0]
        for _ in range(rounds // 4):
            for i, j, table in model.pairs:
                cell, g, h = grids(i, j)
                step = rate * _quadrants(g, h, lam)[1]
                table += step
                f += step.ravel()[cell]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            f += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for i, j, table in self.pairs:
            f += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-f))


def held_out_of(id_col):
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs, labels, label: str = "quality", max_labels: int = MAX_LABELS, **params) -> Gam:
    """A model of ``label`` from at most max_labels labelled rows that are not held out, the least by hash of the id (a threshold keeps all others from the sort).

    Null labels and ids are left out; several labels of one id count as their majority (ties: 1), several texts of one id as
    the least feature vector. Only the sampled texts are featured; ids of the sample, at most max_labels, are broadcast.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out_of(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    n, wanted = own.count(), 1.2 * max_labels + 1000
    if n > wanted:  # of so many rows the first max_labels lie under this threshold
        own = own.where(place <= int(wanted / n * (1 << 32)))
    sample = own.orderBy(place, "doc_id").limit(max_labels)
    vector = pandas_udf(_vectors, "array<double>")
    # one id may have many texts: the sample is of ids, and each gives one row
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_y", vector("text").alias("x"))
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("_y").alias("y")).orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return Gam.fit(x, rows["y"].to_numpy(float), **params)


def _vectors(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def score_column(model: Gam, text_col: str = "text"):
    """The score of a text column as a Column; null and empty texts are scored as empty texts."""

    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series(dtype=float)
        return pd.Series(model.score(np.stack([features(t) for t in texts])))

    return pandas_udf(run, "double")(F.col(text_col))


def op4_quality(spark, sf_dir: str):
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts are scored as empty texts; a null id is held out; repeated rows each have their score; an empty table gives an empty
    result, and without labels every score is one half; columns besides doc_id and text are not looked at.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out_of(F.col("doc_id")).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def crc_rest(doc_id) -> int:
    """The remainder that decides whether a row is held out."""
    return zlib.crc32(str(doc_id).encode()) % 5
