"""Toxicity (operator 8): a weighted lexicon matched by Aho-Corasick on folded words.

Words are folded to a skeleton, so that look-alike letters, accents, digits and symbols in
place of letters make no difference. The lexicon holds whole words and word beginnings,
each with the log odds that labelled rows give it. One automaton finds all of them in one
pass over a text; exception phrases take the matches inside them away. Weights found
are divided by a slowly growing function of the length and become a probability.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import least_hashes, materialize

#: Letters of other scripts, digits and symbols, and the letter each stands for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "г": "r", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l", "+": "t",
}
#: Letters that look-alikes make one: after folding, i stands for i, j and l.
_ONE = {"l": "i", "j": "i"}
#: Phrases in which a lexicon word means no harm.
EXCEPTIONS = (
    "circus clown", "clown fish", "dumb bell", "dumb waiter", "garbage bag", "garbage can", "garbage collection", "garbage collector", "garbage truck", "hate crime", "idiot proof", "kill switch", "killer whale",
    "rat race", "scum line", "sore loser", "stupid question", "suicide prevention", "trash bag", "trash bin", "trash can", "trash collection", "ugly duckling", "useless use",
)
#: Lengths of word beginnings that may enter the lexicon.
STEMS = (4, 5, 6, 7)
#: Labelled rows that the fit sees at most, those with the least hashes of their ids.
FIT_ROWS = 40_000
#: Parts that they are dealt over.
FIT_PARTS = 48
#: Lexicon entries need so many different toxic texts, such a share of all toxic ones, and
#: such odds against the mean. The surest MOST_ENTRIES are the model, whatever the corpus's size.
LEAST_ROWS, LEAST_SHARE, LEAST_LOG_ODDS, MOST_ENTRIES = 6, 0.004, 2.5, 5_000


def _letter(c: str) -> str | None:
    """What a character becomes: letters, a space for what separates, None to vanish."""
    low = c.lower()
    flat = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
    out = "".join(_ONE.get(y, y) for x in flat for y in LOOK_ALIKES.get(x, x))
    if unicodedata.category(c) in ("Cf", "Mn", "Me"):
        return None
    return out if out and all(x.isalnum() for x in out) else " "


class Folding(dict):
    """A table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str | None:
        self[code] = _letter(chr(code))
        return self[code]


def fold(text: str | None, table: Folding) -> list[str]:
    """Folded words. Symbols that stand for letters do so inside a word, not at its ends."""
    return " ".join(w.strip("!$|+@€£") for w in text.split()).translate(table).split() if text else []


def _terms(words: list[str]) -> set[str]:
    """What of a text may enter the lexicon: ' word ' and ' begin'."""
    own = set(words)
    return {f" {w} " for w in own} | {f" {w[:k]}" for w in own for k in STEMS if len(w) > k}


class Lexicon:
    """Entries with weights, the exceptions, and the line that makes a score of them."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset
        self._made: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _automaton(self) -> tuple:
        if self._made is None:
            import ahocorasick

            table, auto = Folding(), ahocorasick.Automaton()
            for phrase in self.exceptions:
                folded = f" {' '.join(fold(phrase, table))} "
                auto.add_word(folded, (0.0, len(folded)))
            for entry, weight in self.weights.items():
                if entry not in auto:
                    auto.add_word(entry, (weight, 0))
            auto.make_automaton()
            self._made = table, auto
        return self._made

    def strength(self, text: str | None) -> float:
        """Weights of the words matched, the greatest entry of each, by the length of the text.

        Words that begin inside an exception phrase count for nothing.
        """
        table, auto = self._automaton()
        words = fold(text, table)
        if not words or not len(auto):
            return 0.0
        joined = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (weight, phrase) in auto.iter(joined):
            if phrase:
                excused.append((end + 1 - phrase, end))
            else:
                start = joined.rfind(" ", 0, end if joined[end] == " " else end + 1)
                best[start] = max(best.get(start, 0.0), weight)
        total, k, upto = 0.0, 0, 0
        excused.sort()
        for start in sorted(best):  # phrases that begin here or before reach up to `upto`
            while k < len(excused) and excused[k][0] <= start:
                upto, k = max(upto, excused[k][1]), k + 1
            total += best[start] if start >= upto else 0.0
        return total / (1.0 + math.log1p(len(words)) / 8)

    def score(self, text: str | None) -> float:
        z = self.slope * self.strength(text) + self.offset
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _held_out(id_col: str):  # noqa: ANN202
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_entries: int = MOST_ENTRIES) -> Lexicon:
    """A lexicon of most_entries at most from labelled rows that are not held out, fit_rows of them at most.

    Rows with an id labelled more than once are toxic if any label says so; null ids and
    labels count for nothing, and texts alike count once. Entries are words and word beginnings far likelier in toxic texts; how many different
    texts have them is counted by a grouping. Without rows of both labels it is empty,
    and every score is below one half.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = least_hashes(marked.filter(~_held_out("id")).withColumn("h", F.xxhash64("id")), "h", fit_rows).select("id", "toxic")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("text", "toxic").dropDuplicates()
    rows = materialize(rows.repartition(FIT_PARTS), "fit")  # copies would make chance words look sure

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Folding()
        for batch in batches:
            counts: dict[str, list[int]] = {}
            seen = [0, 0]
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[toxic] += 1
                for t in _terms(fold(text.as_py(), table)):
                    counts.setdefault(t, [0, 0])[toxic] += 1
            counts[""] = seen
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "clean", "toxic"])

    counted = materialize(rows.mapInArrow(terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    seen = counted.filter("term = ''").collect()
    clean, toxic = (seen[0]["clean"], seen[0]["toxic"]) if seen else (0, 0)
    if not clean or not toxic:
        return Lexicon({}, exceptions, 0.0, -3.0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    # Words whose share among toxic rows could be chance stay out: the odds less two standard errors count.
    sure = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5) * F.expr("IF(clean > 0, 1, 0)"))
    top = counted.filter((F.col("term") != "") & (F.col("toxic") >= max(LEAST_ROWS, LEAST_SHARE * toxic))).withColumn("odds", odds).withColumn("sure", sure)
    top = top.filter((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("sure") >= 1.0)).orderBy(F.desc("sure"), "term").limit(most_entries).collect()
    lexicon = Lexicon({r["term"]: float(r["odds"]) for r in top}, exceptions)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(20 * lexicon.strength(t.as_py())) for t in batch.column(0)], pa.int64()), batch.column(1)], names=["bin", "toxic"])

    bins = rows.mapInArrow(strengths, "bin long, toxic int").groupBy("bin", "toxic").count().collect()  # a few hundred bins of the strength
    return _calibrated(lexicon, [(r["bin"] / 20, r["toxic"], r["count"]) for r in bins])


def _calibrated(lexicon: Lexicon, rows: list[tuple[float, int, int]]) -> Lexicon:
    """Slope and offset by Newton's method on the logistic loss, with a little weight decay."""
    x, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(n * (p - y) * x) + 0.1 * a, np.sum(n * (p - y)) + 0.01 * b])
        v = n * p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[np.sum(v * x * x) + 0.1, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 0.01]]), g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    return Lexicon(lexicon.weights, lexicon.exceptions, float(a), float(b))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, score (0 to 1), predicted (1 from one half on).

    Null and empty texts have the score of a text without matches. Repeated rows and null
    ids get rows of their own (a null id is not held out); an empty table gives an empty
    result; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, F.coalesce(_held_out(id_col), F.lit(False)).alias("held_out"), "score", F.expr("IF(score >= 0.5, 1, 0)").alias("predicted"))
