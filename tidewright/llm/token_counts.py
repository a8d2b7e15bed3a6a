"""Token counts (operator 10): overlap resynchronisation for huge documents.

A byte-level BPE works in two steps: a pattern cuts the text into pieces, scanning
from left to right, and each piece is encoded on its own. The state of the scan is its
position alone, so when the scans of two overlapping chunks both start a piece at the
same place, far enough from the left chunk's end and the right chunk's start, they agree
from there on. Chunks are spliced at such a place; when an overlap has none, it is
doubled, and in the end the two chunks are encoded as one.

That is proven for byte-level vocabularies with their own pattern, no normaliser and added
tokens that are plain strings. Texts of other vocabularies are encoded whole by their library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level BPE pattern of the vocabulary files.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are the same in every Unicode version in use. Chunks with
#: others get their pieces from the library, whose tables may be older or newer.
SETTLED = "[\t\n\r -~¡-ȳΆ-ώЀ-ҁ‐-‧‰-›€一-龥]*"
#: Pieces whose counts a worker remembers at once.
REMEMBERED = 1_000_000


class Counter:
    """Counts tokens of texts with one vocabulary file; made once in each Python worker."""

    def __init__(self, path: str, chunk_chars: int = 65_536, overlap_chars: int = 512):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk_chars, self.overlap_chars = chunk_chars, overlap_chars
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole, self._by_piece = (lambda text: len(model.encode(text, num_threads=1))), False
            return
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["truncation"] = spec["padding"] = None
        library = Tokenizer.from_str(json.dumps(spec))
        self._whole = lambda text: len(library.encode(text, add_special_tokens=False).ids)
        self._cut = library.pre_tokenizer.pre_tokenize_str if spec.get("pre_tokenizer") else None
        first, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self._by_piece = (
            first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self._plain = regex.compile(PIECES)
        self._special = re.compile("(" + "|".join(re.escape(t["content"]) for t in added) + ")") if added else None
        self._guard = 2 + max([len(t["content"]) for t in added], default=0)
        self._settled = re.compile(SETTLED)
        self._memo: dict[str, int] = {}

    def _of(self, pieces: list[str]) -> list[int]:
        memo = self._memo
        try:
            return [memo[p] for p in pieces]
        except KeyError:
            if len(memo) > REMEMBERED:
                memo.clear()
            for p in pieces:
                if p not in memo:
                    memo[p] = self._whole(p)
            return [memo[p] for p in pieces]

    def _pieces(self, text: str) -> list[str]:
        if self._settled.fullmatch(text):
            return self._plain.findall(text)
        return [text[a:b] for _, (a, b) in self._cut(text)]

    def _encode(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a chunk and how many tokens each has; a special string is one."""
        if self._special is None or not self._special.search(text):
            pieces = self._pieces(text)
            return pieces, self._of(pieces)
        pieces, counts = [], []
        for k, part in enumerate(self._special.split(text)):
            own = [part] if k % 2 else self._pieces(part)
            pieces += own
            counts += [1] if k % 2 else self._of(own)
        return pieces, counts

    def _chunk(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """(offset, tokens) for each piece of text[start:end]."""
        out, at = [], start
        for piece, n in zip(*self._encode(text[start:end]), strict=True):
            out.append((at, n))
            at += len(piece)
        return out

    def _spliced(self, text: str) -> int:
        size, total = len(text), 0
        start, end = 0, min(self.chunk_chars, len(text))
        left = self._chunk(text, start, end)
        while end < size:
            overlap, upto = self.overlap_chars, min(end + self.chunk_chars - self.overlap_chars, size)
            while True:
                begin = end - overlap
                if begin <= start:  # no common place at all: one chunk of both
                    left, end = self._chunk(text, start, upto), upto
                    break
                right = self._chunk(text, begin, upto)
                stable = {at for at, _ in right if begin + self._guard <= at <= end - self._guard}
                common = max((at for at, _ in left if at in stable), default=None)
                if common is not None:
                    total += sum(n for at, n in left if at < common)
                    left, start, end = [x for x in right if x[0] >= common], common, upto
                    break
                overlap *= 2
        return total + sum(n for _, n in left)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self._by_piece:
            return self._whole(text)
        if len(text) > self.chunk_chars:
            return self._spliced(text)
        return sum(self._encode(text)[1]) if self._settled.fullmatch(text) else self._whole(text)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 65_536, overlap_chars: int = 512
) -> DataFrame:
    """One row a document: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids give a
    row each; other columns are not read, and an empty table gives an empty result. Texts
    of more than chunk_chars characters are counted in chunks; so the memory a text takes
    beside itself is a chunk's, unless its pieces are longer. The vocabulary file must be at the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, chunk_chars, overlap_chars)
        for batch in batches:
            texts = batch.column(1)
            n = [counter.count(t.as_py()) for t in texts]
            size = [0 if not t.is_valid else t.as_buffer().size for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
