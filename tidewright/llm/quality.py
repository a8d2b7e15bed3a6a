"""Quality rules (operator 5): an isolation forest on rule statistics.

Each document gets rule statistics of its whole text. A forest of random splits, fitted
on a bounded sample of them, gives path lengths: a document that few splits set apart is
an anomaly. The path length below which a document goes is calibrated on all labelled
rows. Rules with fixed limits (base_failed) come first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import least_hashes, materialize

SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
#: Bounds of the fit: trees, rows a tree sees, and bins of the score for calibration.
TREES, ROWS, BINS = 128, 256, 1000
#: The share of documents labelled good that calibration may give up.
LOSS = 0.002


#: Words from which on repeats are counted by sorted numbers, which take less memory than a table of windows.
LONG = 20_000


def _repeat_words_sorted(words: list[bytes]) -> int:
    """_repeat_words of a long text, in a few numbers a word."""
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    _, pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
    first = np.concatenate([n[window] > 1, [False, False]])
    return int((first | np.roll(first, 1) | np.roll(first, 2)).sum())


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    if len(words) >= LONG:
        return _repeat_words_sorted(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    upto = n = 0  # words before upto are counted or passed
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(upto, i)
            upto = i + 3
    return n


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if _HAS_WORD.search(x)]
    return len(lines) - len(set(lines))


def statistics_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), _dup_lines(text), _repeat_words(words)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the rule statistics, base_failed) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics_of(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))], names=[id_col, *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col), F.col(text_col))
        .mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATISTICS))
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    )


def _features(rows: np.ndarray) -> np.ndarray:
    """What the forest splits, from rows of STATISTICS: how far a text is beyond what rules leave free.

    All are ratios, so that a long document is like a short one, and most documents are
    0 in all of them: symbols by character and by word, a mean word length outside 3 to
    10 characters, and repeated words beyond three in ten. Lines that recur are common in
    good documents; they count through the words that they repeat.
    """
    words, chars, symbols, _, repeats = np.asarray(rows, np.float64).reshape(-1, len(STATISTICS)).T
    words, chars = np.maximum(words, 1), np.maximum(chars, 1)
    mean = chars / words
    return np.column_stack([symbols / chars, symbols / words, np.maximum(0, np.maximum(3 - mean, mean - 10)), np.maximum(0, repeats / words - 0.3)])


def _average_path(n: np.ndarray | int) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    return np.where(big, 2 * (np.log(np.where(big, n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.where(big, n, 1), out)


class Forest:
    """Isolation trees as arrays: a node's feature (-1: leaf), cut, children and path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.unit = float(_average_path(max(2, min(size, len(rows)))))
        self.trees = [self._grow(rows[rng.permutation(len(rows))[:size]], rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def _grow(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = max(1, int(np.ceil(np.log2(max(2, len(rows))))))
        feature, cut, left, right, path = [], [], [], [], []

        def node(own: np.ndarray, depth: int) -> int:
            k = len(feature)
            for x, v in ((feature, -1), (cut, 0.0), (left, k), (right, k), (path, depth + float(_average_path(len(own))))):
                x.append(v)
            low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
            varied = np.flatnonzero(high > low)
            if depth < limit and len(own) > 1 and len(varied):
                f = int(rng.choice(varied))
                at = float(rng.uniform(low[f], high[f]))
                under = own[:, f] <= at
                feature[k], cut[k] = f, at
                left[k] = node(own[under], depth + 1)
                right[k] = node(own[~under], depth + 1)
            return k

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1: the shorter the mean path, the higher."""
        if not self.trees:
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(rows[every, f] <= cut[at], left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.unit)


def _scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with the forest's score, anomaly."""
    names = [f.name for f in stats.schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(names.index(s)).to_numpy(zero_copy_only=False) for s in STATISTICS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(_features(rows)))], names=[*names, "anomaly"])

    return stats.mapInArrow(run, f"{kinds}, anomaly double")


def _threshold(scored: DataFrame, labels: DataFrame, id_col: str, loss: float) -> float:
    """The least score at which all but a share `loss` of the rows labelled good stay.

    It comes from a histogram over all labelled rows that pass the fixed rules. Without
    such rows nothing is rejected.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_good")).filter("_good IS NOT NULL").groupBy("_id").agg(F.min("_good").alias("_good"))
    counted = (
        scored.filter("NOT base_failed").select(F.col(id_col).alias("_id"), F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
        .join(marked, "_id").groupBy("bin").agg(F.sum(F.expr("IF(_good = 1, 1L, 0L)")).alias("good"), F.sum(F.expr("IF(_good = 1, 0L, 1L)")).alias("bad"))
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for row in counted.collect():  # BINS + 1 rows at most
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    if not good.sum() or not bad.sum():
        return 2.0
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    allowed = np.flatnonzero((lost <= loss) & (caught > 0))
    best = allowed[np.argmax(caught[allowed] - lost[allowed])] if len(allowed) else BINS * 2
    return float(best) / BINS


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, trees: int, rows: int, loss: float) -> tuple[DataFrame, Forest, float]:
    """Every document's statistics and score, the forest, and the score from which on documents go."""
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    picked = stats.filter("NOT base_failed").select(F.xxhash64(id_col).alias("_h"), *STATISTICS)
    sample = least_hashes(picked, "_h", trees * rows).collect()
    forest = Forest(_features(np.array([r[1:] for r in sample], np.int64)), trees, rows)
    scored = materialize(_scored(stats, forest), "anomaly")
    return scored, forest, _threshold(scored, labels, id_col, loss)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, rows: int = ROWS, loss: float = LOSS) -> DataFrame:
    """One row a document: id, the rule statistics, base_failed, kept, anomaly.

    The forest is fitted on trees * rows documents that pass the fixed rules, those with
    the least hashes of their ids. Null and empty texts have no words and fail the fixed
    rules. Repeated rows and null ids are judged like any other; null labels count for
    nothing, and a document labelled both good and bad counts as bad. An empty table
    gives an empty result, and extra columns are not read.
    """
    scored, _, at = _fitted(docs, labels, id_col, text_col, trees, rows, loss)
    return scored.withColumn("kept", F.expr(f"NOT base_failed AND anomaly < {at!r}D")).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that judge() keeps, with their columns as they were.

    Null, empty and short texts go; repeated rows stay or go together, whatever their ids.
    The verdict is made again beside each text: statistics are cheaper than moving texts to join them.
    """
    _, forest, at = _fitted(docs, labels, id_col, text_col, TREES, ROWS, LOSS)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics_of(t.as_py()) for t in texts], np.int64).reshape(-1, len(STATISTICS))
        failed = (rows[:, 0] < 50) | (100 * rows[:, 4] > 50 * rows[:, 0])
        return pa.array(~failed & (forest.score(_features(rows)) < at))

    return docs.filter(kept(F.col(text_col)))
