"""Substring dedup (operator 1): content-defined chunking with a gear rolling hash.

A text is its words joined by single spaces. A gear hash rolls over its bytes, and of every
WINDOW word ends in a row the one with the least hash is a cut. Where a cut falls depends on
the words around it and nothing else, so an insertion moves no cut beyond them. Chunks with
equal digests are the same text, and only around runs of chunks that stand elsewhere can a
passage repeat. There every window of SPAN_WORDS words is looked up by its own digest; a
window whose chunks all follow one another in the first document needs no look-up.
Repeated windows that follow one another in one earlier place are the spans that go. A text
that stands whole in an earlier row is one span and is not chunked.

Nothing is missed. The gear hash sees 16 bytes, CONTEXT words at most. In a passage of S
words that stands in two places, the first cut by WINDOW word ends that lie CONTEXT words
inside is among the first CONTEXT + WINDOW words, the last cut among the last WINDOW, and all
cuts between are the same in both. So a run of whole chunks that both have begins CONTEXT +
WINDOW words after the passage's start at the latest and reaches up to WINDOW - 1 words
before its end at least: S - 2 WINDOW - CONTEXT + 1 words, 11 for the 50 of SPAN_WORDS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import WHITE, materialize, words_of

#: Word ends in a row of which the one with the least hash is a cut.
WINDOW = 16
#: Words that hold the 16 bytes before a word's end, of two bytes each at least.
CONTEXT = 8
#: Words from which on a repeated span counts.
SPAN_WORDS = 50
#: Ids on several texts, and copies of whole texts, up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)
_TAG, _MARK = "tidewright tag", "tidewright shared"


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte, h = 2 h + gear[byte] in 16 bits, so of the last 16 bytes."""
    h = _GEAR[data]
    for m in (1, 2, 4, 8):
        h[m:] += h[:-m] << np.uint16(m)
    return h


def _starts(words: list[bytes]) -> np.ndarray:
    """Where each word starts when joined, and where one more would."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    return starts


def _cuts(words: list[bytes], joined: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the chunks and one past the last, and where each word starts in joined."""
    n, starts = len(words), _starts(words)
    if n < window:
        return np.array([0, n]), starts
    h = _gear(np.frombuffer(joined, np.uint8))[starts[1:] - 2].astype(np.int64)
    least, have = h << 32 | np.arange(n, 0, -1), 1  # of equal hashes the last word end
    while have < window:
        step = min(have, window - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    ends = n + 1 - (least & 0xFFFFFFFF)
    return np.unique(np.concatenate([[0], ends, [n]])), starts


class _Digests:
    """Rows (id, tag, at, ..., high, low) of pieces of texts, given out in batches of a bounded size."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.rows = batch, 0
        self.of, self.columns, self.digests = [], [], []

    def add(self, i: int, joined: bytes, begins: list[int], ends: list[int], *columns: np.ndarray) -> None:
        import xxhash

        digest = xxhash.xxh3_128_digest
        self.digests += [digest(joined[x:y]) for x, y in zip(begins, ends, strict=True)]
        self.of.append(np.full(len(begins), i))
        self.columns.append([c.astype(np.int32) for c in columns])
        self.rows += len(begins)

    def made(self, names: list[str]) -> pa.RecordBatch:
        """What was added, with 96 bits of each digest."""
        d = np.frombuffer(b"".join(self.digests), np.dtype([("high", ">i8"), ("low", ">i4"), ("rest", ">i4")]))
        of = pa.array(np.concatenate(self.of))
        arrays = [self.batch.column(0).take(of), self.batch.column(1).take(of), *(pa.array(np.concatenate(c)) for c in zip(*self.columns, strict=True)), pa.array(d["high"].astype(np.int64)), pa.array(d["low"].astype(np.int32))]
        self.of, self.columns, self.digests, self.rows = [], [], [], 0
        return pa.RecordBatch.from_arrays(arrays, names=names)


#: Digests after which a task gives out a batch.
GIVEN_OUT = 200_000


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs and a tag. Id and tag tell documents apart: the tag is 0 unless the id is null or on several texts, and the text's xxhash64 then."""
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"))
    several = hashed.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("id IS NULL OR a <> b")
    shared = materialize(several.select(F.col("id").alias(_MARK), F.lit(True).alias("is")), "shared")
    n = shared.count()
    if not n:
        return docs.withColumn(_TAG, F.lit(0).cast("long"))
    shared = shared.withColumnRenamed("is", _MARK + " is")
    joined = docs.join(F.broadcast(shared) if n <= BROADCAST_ROWS else shared, docs[id_col].eqNullSafe(shared[_MARK]), "left")
    return joined.withColumn(_TAG, F.when(F.col(_MARK + " is"), F.xxhash64(F.col(text_col))).otherwise(F.lit(0).cast("long"))).drop(_MARK, _MARK + " is")


def _chunks(texts: DataFrame, window: int, kind: str) -> DataFrame:
    """(id, tag, at, n, high, low): each chunk's first word, number of words and 96-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "tag", "at", "n", "high", "low"]
        for batch in batches:
            found = _Digests(batch)
            for i, text in enumerate(batch.column(2)):
                words = text.as_py().encode().split() if text.is_valid else []
                if not words:
                    continue
                joined = b" ".join(words)
                ends, starts = _cuts(words, joined, window)
                found.add(i, joined, starts[ends[:-1]].tolist(), (starts[ends[1:]] - 1).tolist(), ends[:-1], np.diff(ends))
                if found.rows >= GIVEN_OUT:
                    yield found.made(names)
            if found.rows:
                yield found.made(names)

    return texts.mapInArrow(run, f"id {kind}, tag long, at int, n int, high long, low int")


def _place() -> Column:
    """What orders places: null ids are the greatest."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "tag", "at")


def _firsts(rows: DataFrame) -> DataFrame:
    """(high, low, f_id, f_tag, f_at): the first place of each digest that has several rows.

    The aggregation combines before the shuffle, so a passage in a third of all documents
    arrives as one row a task. It is written, so that a join with it has nothing but
    shuffles below: only then are the join's large partitions split at run time. Nothing
    above the join needs a digest's rows together.
    """
    first = rows.groupBy("high", "low").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return materialize(first.select("high", "low", F.col("first.id").alias("f_id"), F.col("first.tag").alias("f_tag"), F.col("first.at").alias("f_at")), "firsts").hint("merge")


def _candidates(own: DataFrame, run_words: int) -> DataFrame:
    """(id, tag, parts): each document's chunks that stand elsewhere too, with where they stand first."""
    repeated = own.join(_firsts(own), ["high", "low"])
    # Sets: what they hold is no more than the document's text, however often its row is repeated.
    listed = repeated.groupBy("id", "tag").agg(F.collect_set(F.struct("at", "n", "f_id", "f_tag", "f_at")).alias("parts"))
    return listed.filter(F.expr("aggregate(parts, 0L, (a, p) -> a + p.n)") >= run_words)


def _lists(column: pa.Array, *names: str) -> Iterator[list[tuple]]:
    """A list of tuples of the named fields, in order, for each row of a list of structs."""
    flat, k = column.flatten(), 0
    fields = [flat.field(n).to_pylist() for n in names]
    for size in column.value_lengths().to_pylist():
        yield sorted(zip(*(f[k : k + (size or 0)] for f in fields), strict=True), key=lambda x: x[0])
        k += size or 0


PARTS = ("at", "n", "f_id", "f_tag", "f_at")


def _stretches(own: tuple, parts: list[tuple]) -> tuple[list[list], list[list]]:
    """Runs (a, b) of chunks that stand elsewhere too, and stretches (a, b, first document, first word) of
    later chunks whose first occurrences follow one another in one document."""
    runs: list[list] = []
    same: list[list] = []
    for a, n, of, tag, at in parts:
        b, first = a + n, (of, tag)
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
        if (first, at) == (own, a):
            continue
        if same and same[-1][1] == a and same[-1][2] == first and at - same[-1][3] == a - same[-1][0]:
            same[-1][1] = b
        else:
            same.append([a, b, first, at])
    return runs, same


def _windows(texts: DataFrame, listed: DataFrame, kind: str, span_words: int, window: int) -> DataFrame:
    """(id, tag, at, high, low): the 96-bit digests of the windows of span_words words that may stand elsewhere.

    Those are the windows whose inner chunks are in one run; no other window repeats. Windows
    inside a stretch are left out; the first occurrence of a window is in none."""
    before, after = CONTEXT + window, span_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Digests(batch)
            for i, (of, tag, text, parts) in enumerate(zip(*batch.columns[:3], _lists(batch.column(3), *PARTS), strict=True)):
                runs, same = _stretches((of.as_py(), tag.as_py()), parts)
                runs = [r for r in runs if r[1] - r[0] >= after - before]
                words = text.as_py().encode().split() if runs else []
                if len(words) < span_words:
                    continue
                wanted = np.zeros(len(words) - span_words + 1, bool)
                for a, b in runs:
                    wanted[max(0, a - before) : max(0, b - after + 1)] = True
                for a, b, _, _ in same:
                    wanted[a : max(a, b - span_words + 1)] = False
                if (places := np.flatnonzero(wanted)).size:
                    starts = _starts(words)
                    found.add(i, b" ".join(words), starts[places].tolist(), (starts[places + span_words] - 1).tolist(), places)
                if found.rows >= GIVEN_OUT:
                    yield found.made(["id", "tag", "at", "high", "low"])
            if found.rows:
                yield found.made(["id", "tag", "at", "high", "low"])

    near = texts.join(listed.select(F.col("id").alias("l_id"), F.col("tag").alias("l_tag"), "parts"), F.col("id").eqNullSafe(F.col("l_id")) & (F.col("tag") == F.col("l_tag")))
    return near.select("id", "tag", "text", "parts").mapInArrow(run, f"id {kind}, tag long, at int, high long, low int")


def _joined(own: tuple, parts: list[tuple], windows: list[tuple], span_words: int) -> list[tuple]:
    """The document's spans: first word, words, the first document of the beginning.

    A span goes on as long as one earlier place goes on to have its windows: from where its
    beginning stands first, or from an earlier place of this document. Windows are equal
    when they stand first at the same place.
    """
    first = {at: ((of, tag), f_at) for at, of, tag, f_at in windows}
    for a, b, i, at in _stretches(own, parts)[1]:
        first |= {k: (i, at + k - a) for k in range(a, b - span_words + 1)}
    found: list[list] = []
    seen: dict = {}
    there = here = None
    for k in sorted(first):
        now, goes_on = first[k], bool(found) and k == found[-1][1] + 1
        there = (there[0], there[1] + 1) if goes_on and there else None
        there = there if there == now else None
        here = here + 1 if goes_on and here is not None else None
        here = here if here is not None and first.get(here, (own, here)) == now else None
        if there or here is not None:
            found[-1][1] = k
        else:
            found.append([k, k, now[0]])
            there, here = now, seen.get(now)
        seen[now] = k
    return [(a, k + span_words - a, i[0]) for a, k, i in found]


def _copies(texts: DataFrame) -> DataFrame:
    """(id, tag, n_words, f_id): texts that stand whole in an earlier row, by their MD5."""
    whole = materialize(texts.select("id", "tag", F.unhex(F.md5("text")).alias("whole"), F.size(words_of(F.col("text"), WHITE)).alias("n_words")), "texts")
    first = whole.groupBy("whole").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    first = materialize(first.select("whole", F.col("first.id").alias("f_id"), F.col("first.tag").alias("f_tag")), "firsts").hint("merge")  # as in _firsts
    later = whole.join(first, "whole").filter("NOT (id <=> f_id AND tag = f_tag)")
    return materialize(later.select("id", "tag", "n_words", "f_id"), "copies")


def spans(docs: DataFrame, span_words: int = SPAN_WORDS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each span whose words stand earlier in the corpus, all in one place.

    Columns: the document's id, first_word and n_words of the span (words between ASCII
    white space, from 0), and first_<id>, the document in which the span's beginning stands
    first, or, where the whole text stands earlier, the first with that text. Earlier is a
    lesser (id, hash of the text where the id is null or on several texts, word), null ids
    being the greatest; a document's own earlier words count too. Rows with the same id and
    text are one document and have their spans once; rows with the same id and different
    texts are different documents, and so are rows with null ids. Spans have span_words
    words at least and may overlap. Null, empty and blank texts have no spans; an empty table
    gives an empty result; extra columns are not read. A window that is too wide for the
    passages wanted is an error.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = _tagged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    return _spans(own.select("id", F.col(_TAG).alias("tag"), "text"), span_words, window, kind, id_col).drop("tag")


def _spans(texts: DataFrame, span_words: int, window: int, kind: str, id_col: str) -> DataFrame:
    """spans() of texts (id, tag, text), with the tag."""
    if (run_words := span_words - 2 * window - CONTEXT + 1) < 1:
        raise ValueError(f"{span_words} words may hold no whole chunk of {window}")
    texts = texts.filter("text IS NOT NULL")
    copies = _copies(texts)
    left_out = copies.select(F.col("id").alias("c_id"), F.col("tag").alias("c_tag")).distinct()
    left_out = F.broadcast(left_out) if copies.count() <= BROADCAST_ROWS else left_out
    texts = texts.join(left_out, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag")), "left_anti")
    listed = materialize(_candidates(materialize(_chunks(texts, window, kind), "chunks"), run_words), "candidates")
    windows = materialize(_windows(texts, listed, kind, span_words, window), "windows")
    later = windows.join(_firsts(windows), ["high", "low"]).filter("NOT (id <=> f_id AND tag = f_tag AND at = f_at)")
    grouped = later.groupBy(F.col("id").alias("w_id"), F.col("tag").alias("w_tag")).agg(F.collect_set(F.struct("at", "f_id", "f_tag", "f_at")).alias("windows"))  # one a word at most
    both = listed.join(grouped, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("tag") == F.col("w_tag")), "left").select("id", "tag", "parts", "windows")
    names = [id_col, "first_word", "n_words", f"first_{id_col}", "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for of, tag, parts, found in zip(*batch.columns[:2], _lists(batch.column(2), *PARTS), _lists(batch.column(3), "at", "f_id", "f_tag", "f_at"), strict=True):
                own = (of.as_py(), tag.as_py())
                rows += [(own[0], *r, own[1]) for r in _joined(own, parts, found, span_words)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            of, small = batch.schema.field(0).type, pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [of, small, small, of, pa.int64()], strict=True)], names=names)

    parts = both.mapInArrow(run, f"`{id_col}` {kind}, first_word int, n_words int, `first_{id_col}` {kind}, tag long")
    return parts.union(copies.filter(F.col("n_words") >= span_words).distinct().select("id", F.lit(0), "n_words", "f_id", "tag"))


def _without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without words [a, b) of each range and the white space after them."""
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(r for r in ranges if r[1] < len(places)):
        out.append(text[at : max(at, places[a])])
        at = max(at, places[b])
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, span_words: int = SPAN_WORDS, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of docs without the spans that stand earlier; size_col, if there, is the new length.

    Every row stays, if with an empty text, and loses the spans of its own text, whatever
    other rows have its id. Rows alike in id and text are one document: they lose the same
    words, and none of them is a copy of another. Rows with nothing to remove are as they
    were, null texts too; so are the other columns. An empty table gives an empty result.
    """
    kind, names = docs.schema[id_col].dataType.simpleString(), docs.columns
    tagged = _tagged(docs, id_col, text_col)
    found = _spans(tagged.select(F.col(id_col).alias("id"), F.col(_TAG).alias("tag"), F.col(text_col).alias("text")), span_words, WINDOW, kind, "id")
    cut = found.groupBy(F.col("id").alias(_MARK + " of"), F.col("tag").alias(_MARK + " tag")).agg(F.collect_list(F.struct("first_word", "n_words")).alias(_MARK + " cut"))
    joined = tagged.join(cut, tagged[id_col].eqNullSafe(cut[_MARK + " of"]) & (tagged[_TAG] == cut[_MARK + " tag"]), "left").select(*(tagged[f"`{c}`"] for c in names), _MARK + " cut")
    k, has_size = names.index(text_col), size_col in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(k).to_pylist()
            sizes = batch.column(names.index(size_col)).to_pylist() if has_size else []
            for i, cuts in enumerate(batch.column(len(names))):
                if cuts.is_valid and texts[i]:
                    texts[i] = _without(texts[i], [(c["first_word"], c["first_word"] + c["n_words"]) for c in cuts.as_py()])
                    if has_size:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns[: len(names)])
            columns[k] = pa.array(texts, columns[k].type)
            if has_size:
                columns[names.index(size_col)] = pa.array(sizes, columns[names.index(size_col)].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
