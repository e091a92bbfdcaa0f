"""Token counts of a unigram tokenizer: count-only Viterbi over Aho-Corasick matches.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a character; dynamic
programming carries the best score and the piece count of each prefix, never the pieces. The
tie rules are those of the tokenizers library's Unigram model: of equally good segmentations of a
prefix the one whose last piece begins first stays; a character that no single-character piece
covers costs the lowest score less ten; neighbouring unknown characters, and unknown pieces that the text
holds literally, fuse, and with byte fallback they count as many tokens as they have bytes, unless they are a piece.

As in sentencepiece, a text begins with a space and spaces become the mark U+2581. No piece
holds a mark after another character or a line feed, so the words of a text (with the mark before
them) are counted on their own, each distinct one once for as long as it stays in a bounded memo.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import Memo, slices

MARK = "▁"
_BEFORE_MARKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PARTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of texts under a unigram vocabulary; ``unk_id`` is the piece for unknown characters."""

    def __init__(self, vocabulary: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True, memo: int = 400_000) -> None:
        import ahocorasick

        self.unk = vocabulary[unk_id][0]
        self.unk_score = min(s for _, s in vocabulary) - 10.0
        self.score = dict(reversed(vocabulary))
        self.matches = ahocorasick.Automaton()
        for piece, score in self.score.items():
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {p for p in self.score if len(p) == 1}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.score for b in range(256))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("the vocabulary has pieces that cross words")
        self.of_word = Memo(lambda w: self.viterbi(MARK + w), memo)

    def viterbi(self, text: str) -> int:
        """The number of tokens of the best segmentation."""
        n = len(text)
        if not n:
            return 0
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        run: list[int | None] = [None] * (n + 1)  # where the run of unknown pieces that ends here begins
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.matches.iter(text):
            found[end].append(match)
        for end, ch in enumerate(text):
            top, start, is_unknown = None, 0, False
            for length, score in found[end]:
                at = end + 1 - length
                value = best[at] + score
                if top is None or value > top or (value == top and at < start):
                    top, start = value, at
            if ch not in self.single and (top is None or best[end] + self.unk_score > top):
                top, start, is_unknown = best[end] + self.unk_score, end, True
            best[end + 1] = top
            if is_unknown or (end + 1 - start == len(self.unk) and text.startswith(self.unk, start)):
                first = start if run[start] is None else run[start]
                run[end + 1] = first
                fused = text[first : end + 1]
                count[end + 1] = count[first] + (len(fused.encode()) if self.bytes and fused not in self.score else 1)
            else:
                count[end + 1] = count[start] + 1
        return count[n]

    def __call__(self, text: str | None) -> int:
        """The tokens of a whole text; null and empty texts have none."""
        if not text:
            return 0
        if self.unk in text:  # a literal unknown piece fuses with its neighbours, over line feeds too
            return sum(self.viterbi(x) for x in _BEFORE_MARKS.findall(MARK + text.replace(" ", MARK)))
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " " or "\n " in text or not self.bytes:
            return self._parts(MARK + text.replace(" ", MARK))
        line, *more = text.split("\n")
        of_word = self.of_word
        total = sum(map(of_word.__getitem__, line.split(" ")))
        for line in more:  # the line feed, then a word without a mark before it
            first, *rest = line.split(" ")
            total += self.newline + (self.of_bare[first] if first else 0) + sum(map(of_word.__getitem__, rest))
        return total

    def _parts(self, marked: str) -> int:
        if not self.bytes:  # unknown characters fuse over line feeds
            return sum(self.viterbi(x) for x in _BEFORE_MARKS.findall(marked))
        return sum(self.of_part[x] for x in _PARTS.findall(marked))

    @property
    def newline(self) -> int:
        return self.of_part["\n"]

    @property
    def of_part(self) -> Memo:
        if "_of_part" not in self.__dict__:
            self._of_part = Memo(self.viterbi, 100_000)
        return self._of_part

    of_bare = of_part


#: One for a worker process, so that its tasks share what it knows.
_counter = functools.lru_cache(1)(lambda path: Counter(read_vocabulary(path)))


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(path)
    for batch in slices(batches, 1000):
        counts = np.fromiter((counter(t.as_py()) for t in batch.column(1)), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=["doc_id", "n_tokens"])


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens of every row, by the vocabulary and scores of a sentencepiece model file.

    Null and empty texts have no tokens; repeated rows are counted each; a null doc_id stays null; an empty
    table gives an empty result; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _count(it, model), "doc_id long, n_tokens long")
