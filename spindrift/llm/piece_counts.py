"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

Aho-Corasick lists all pieces that end at each character; dynamic programming carries the best score and
its number of pieces. The rules of ties are those of the public unigram tokenizers: of equal scores
the path whose last piece begins first (the longer piece) wins; scores add up in double precision from the
left; a character without a piece of its own is unknown, scores UNKNOWN_PENALTY below the lowest piece
and counts as its UTF-8 bytes (byte fallback). White space is treated as by the metaspace rule:
a space begins a word, and the text begins with one. Words of up to LONG characters are counted once and remembered
(MEMO at most), so what is held has a bound in bytes too; the lattice of a word keeps only as many ends as the longest
piece is long.

Defined results: a null or empty text has 0 tokens; every row has a result, null ids and repeated rows too; an
empty table gives no rows; a text, and a word in it, may be of any length; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spindrift.llm.common import appended, column, held_by_worker, ship, slices
from spindrift.llm.pieces import SPACE, UNKNOWN_PENALTY, vocabulary

MEMO, LONG = 400_000, 64


class Counter(dict):
    """The number of pieces of the best segmentation of a word, by word (without its leading space)."""

    def __init__(self, path: str) -> None:
        words = vocabulary(path)
        self.iter = words.matcher().iter
        self.unknown = min(words.scores) - UNKNOWN_PENALTY
        self.longest = max(map(len, words.pieces))

    def __missing__(self, word: str) -> int:
        count = self.pieces(SPACE + word)
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = count
        return count

    def pieces(self, text: str) -> int:
        ring = self.longest + 1  # scores and counts of the last ends, by their place modulo ring
        score, count = [0.0] * ring, [0] * ring
        matches = self.iter(text)
        at, match = next(matches, (-1, None))
        for end in range(len(text)):
            ending = []
            while at == end:
                ending.append(match)
                at, match = next(matches, (-1, None))
            best, pieces, single = None, 0, False
            for length, _, s in sorted(ending, reverse=True):
                single |= length == 1
                here = score[(end + 1 - length) % ring] + s
                if best is None or here > best:
                    best, pieces = here, count[(end + 1 - length) % ring] + 1
            if not single:
                here = score[end % ring] + self.unknown
                if best is None or here > best:
                    best, pieces = here, count[end % ring] + len(text[end].encode("utf-8", "surrogatepass"))
            score[(end + 1) % ring], count[(end + 1) % ring] = best, pieces
        return count[len(text) % ring]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:  # the text begins with a space of its own
            del words[0]
        return sum(map(self.__getitem__, words))


def counter(path: str) -> Counter:
    return held_by_worker(("counter", path), lambda: Counter(path))


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path).text
        for batch in slices(batches):
            texts = column(batch, "text")
            yield appended(batch.drop_columns(["text"]), {"n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "n_tokens": pa.array(list(map(of, texts)), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())]))
