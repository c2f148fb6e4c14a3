"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training: statistics of a bounded sample of labelled documents are binned by quantiles, and trees of
fixed depth are grown level by level from gradient histograms (logistic loss). Scoring: the trees are
flattened into arrays, and a batch of documents walks all trees at once in numpy.

Defined results: a null text counts as empty; an empty text is scored like any other, from its
statistics; a null doc_id is never labelled and never held out; repeated labels of a document vote, a tie counting as 1; repeated
documents get equal scores; without labels of both classes every score is (n1 + 1) / (n + 1), which is 1 for an
empty label table: nothing can be rejected. Existing columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import bound_batches

#: Bound on the labelled rows a classifier is fitted on (the rows with the lowest hash of doc_id).
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7

# Function words of the four languages of the corpus.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this from at or an a he not but have "
    "le la les de des du un une et en est que qui dans pour par sur au avec il ne se "
    "el los las del y un una es por con para su al lo como se en que "
    "der die das und ist ein eine zu den von mit sich auf dem nicht im für als auch es an".split()
)

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "stop_mark", "exclaim", "bar",
    "symbol", "quote", "non_ascii", "byte_entropy", "function_words", "distinct_words", "top_word", "caps_words",
    "odd_words", "short_words", "longest_word", "lines", "repeated_lines", "line_length", "short_lines", "ended_lines",
)

_KIND = np.zeros((256, 9))
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".,;:?", "!", "|", "#$%&*@^~<>=+\\/_{}[]`", "\"'()-")):
    for _c in _chars:
        _KIND[ord(_c), _i] = 1


def statistics(text: str) -> list[float]:
    """The document statistics, in the order of STATISTICS; all 0 for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = counts @ _KIND / n
    p = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    lowered = text.lower().split()
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    tally: dict[str, int] = {}
    for w in lowered:
        tally[w] = tally.get(w, 0) + 1
    stop = sum(c for w, c in tally.items() if w.strip(".,;:!?") in FUNCTION_WORDS)
    caps = odd = short = 0
    for w, c in tally.items():
        if not w[-1].isalnum() and (len(w) == 1 or not w[-2].isalnum()):
            odd += c
        if len(w) <= 2:
            short += c
    for w in words:
        if len(w) > 1 and w.isupper():
            caps += 1
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / m, *kinds,
        counts[128:].sum() / n, float(-(p * np.log2(p)).sum()), stop / m, len(distinct) / m,
        max(tally.values(), default=0) / m, caps / m, odd / m, short / m, float(max(map(len, words), default=0)),
        float(np.log1p(len(lines))), 1 - len(set(lines)) / k, float(np.log1p(len(text) / k)),
        sum(len(x) < 40 for x in lines) / k, sum(x.rstrip()[-1] in ".!?" for x in lines) / k,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))


@dataclass
class FlatForest:
    """Complete trees of one depth: node i of a tree has children 2i+1 and 2i+2; arrays are (trees, nodes)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray, step: int = 4096) -> np.ndarray:
        """Probability of label 1 for each row; all trees are walked at once."""
        out = np.full(len(x), self.base)
        if self.feature.size:
            trees, nodes = self.feature.shape
            depth, t = int(np.log2(nodes + 1)), np.arange(trees)
            for at in range(0, len(x), step):
                part = x[at : at + step]
                rows = np.arange(len(part))[:, None]
                i = np.zeros((len(part), trees), np.int64)
                for _ in range(depth):
                    i = 2 * i + 1 + (part[rows, self.feature[t, i]] > self.threshold[t, i])
                out[at : at + step] += self.leaf[t, i - nodes].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> FlatForest:
    """Boost `trees` trees of `depth` on histograms of `bins` quantile bins."""
    n, n1 = len(y), float(y.sum())
    nothing = np.zeros((0, 0))
    if n == 0 or n1 in (0, n):
        p = (n1 + 1) / (n + 1)
        return FlatForest(nothing, nothing, nothing, float("inf") if p >= 1 else float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    features, nodes = x.shape[1], 2**depth - 1
    base = float(np.log(n1 / (n - n1)))
    forest = FlatForest(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)), base)
    raw = np.full(n, base)
    shift = np.arange(features) * bins
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (features * bins) + shift + binned).ravel()
            size = width * features * bins
            hg = np.bincount(cell, np.repeat(g, features), size).reshape(width, features, bins)
            hh = np.bincount(cell, np.repeat(h, features), size).reshape(width, features, bins)
            gl, hl = hg.cumsum(2), hh.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            held = np.bincount(cell, minlength=size).reshape(width, features, bins).cumsum(2)
            gain[(held < least) | (held[:, :, -1:] - held < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for j in range(width):
                f, b = divmod(int(best[j]), bins)
                if gain[j, f, b] > 1e-9 and b < len(edges[f]):
                    forest.feature[k, first + j], forest.threshold[k, first + j] = f, edges[f][b]
            right = x[np.arange(n), forest.feature[k, node]] > forest.threshold[k, node]
            node = 2 * node + 1 + right
        at = node - nodes
        sums_g, sums_h = np.bincount(at, g, nodes + 1), np.bincount(at, h, nodes + 1)
        forest.leaf[k] = -rate * sums_g / (sums_h + l2)
        raw += forest.leaf[k, at]
    return forest


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text has remainder 2 by 4; such labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> FlatForest:
    """Fit on at most max_rows labelled documents that are not held out, chosen by a hash of doc_id."""
    bound_batches(docs.sparkSession)
    votes = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id"))
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("__label"))
    )
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series(list(matrix([x or "" for x in text])))

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "__label", measured(F.coalesce("text", F.lit(""))).alias("__x"))
        .groupBy("doc_id")
        .agg(F.min(F.struct("__label", "__x")).alias("__r"))
        .select("doc_id", "__r.*")
        .toPandas()
        .sort_values("doc_id")
    )
    x = np.array(rows["__x"].tolist(), dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, rows["__label"].to_numpy(np.float64))


def score(docs: DataFrame, forest: FlatForest) -> DataFrame:
    """docs with score and predicted; only the text goes to Python and only a double comes back."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(forest.score(matrix([x or "" for x in text])))

    return docs.withColumn("score", scored(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    forest = train(docs, labels, max_rows)
    return score(docs.select("doc_id", "text"), forest).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    forest = train(docs, labels, max_rows)
    bound_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(forest.score(matrix([x or "" for x in text])))

    return docs.where(scored(F.coalesce("text", F.lit(""))) >= THRESHOLD)
