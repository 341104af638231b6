"""Quality rules: rule statistics of whole texts, judged by fixed limits and by an isolation forest.

The statistics of a text are computed in one pass in Arrow batches: symbols, capitals, exclamation marks and digits a
character, repeated lines and repeated words as shares, words that repeat the one before, words that are a sign alone, mean
length of words and of lines, and the number of words. For the forest each is what it has beyond the usual: beyond the range
that all but 2 USUAL of the good documents lie in, so that texts which are odd within it are not told apart.
An isolation forest is grown on the labelled documents: documents that random splits isolate after few steps are anomalous.
All labelled documents count: the usual ranges are exact order statistics of all good ones, each tree draws its ROWS rows (the
method's own subsample) from all of them, and the threshold on the anomaly score is calibrated from both labels of all of them:
of those that lose at most LOSS of the good ones, the middle of the range that rejects most bad ones and loses fewest good
ones. Statistics stay in tables; counts, order statistics and the drawn rows of trees reach the driver.

Defined results: a null text has no words; a text under MIN_WORDS words fails; with no usable label the
forest is absent and only the fixed limits judge; repeated rows are judged one by one, and of an id the smallest label and
counts are learned from; null ids stay; texts of any length
are read whole; an empty table gives no rows; extra columns, whatever their names, are ignored by `judge` and kept by
`keep`. Ties at the threshold are kept.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import appended, column, known_labels, mix64, packed, ranked, removed, ship, slices, written

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Trees, rows a tree, and the share of good rows that may be lost.
TREES, ROWS, LOSS = 100, 256, 0.004
#: Share of good documents beyond either end of the usual range of a statistic.
USUAL = 0.001


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    # Windows are named exactly: pairs (name of the first k words, next word) are renumbered, and only
    # places whose first k words are found twice go on.
    at, names = np.arange(n), ids[:n]
    for k in range(1, window + 1):
        twice = np.bincount(names)[names] > 1
        at, names = at[twice], names[twice]
        if not len(at):
            return 0
        if k < window:
            _, names = np.unique(names * len(seen) + ids[at + k], return_inverse=True)
    hit = at
    step = np.zeros(len(words) + 1, np.int64)
    step[hit] += 1
    step[hit + window] -= 1
    return int((np.cumsum(step[:-1]) > 0).sum())


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = packed(text)
    words = raw.split()  # at ASCII white space, as bytes.split does
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


UPPER, DIGITS, CALLS = bytes(range(65, 91)), b"0123456789", b"!"
SIGNS = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
STATISTICS = ("symbols", "capitals", "calls", "digits", "lines", "repeats", "twice", "signs", "length", "line_words", "words")
#: Shares are drawn towards the usual ones as if there were so many more characters, words or lines of the usual kind, so
#: that a short text is not odd for two capitals; numbers of words and words a line count within these ends.
CHARACTERS, WORDS, LINES = 100, 30, 10
ENDS = {"line_words": (1, 200), "words": (10, 500)}


def counts(text: str | None, base: tuple[int, int, int, int, int]) -> list[float]:
    """Counts of a text, in the order of STATISTICS, then word characters, words and lines with a word."""
    raw = packed(text)
    words = raw.split()
    lines = sum(1 for x in raw.split(b"\n") if x.strip())
    found = [base[2], len(raw) - len(raw.translate(None, UPPER)), raw.count(CALLS), len(raw) - len(raw.translate(None, DIGITS)), base[3], base[4], sum(map(operator.eq, words, islice(words, 1, None))), sum(map(SIGNS.__contains__, words)), base[1], base[0], base[0]]
    return [float(x) for x in (*found, base[1], base[0], lines)]


@dataclass
class Usual:
    """Of each statistic the usual value, and the ends of the usual range."""

    middle: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @staticmethod
    def of(counted: np.ndarray, good: np.ndarray) -> Usual:
        """From the counts of documents, and which of them are good."""
        some = counted[good] if good.any() else counted
        usual = Usual(np.median(some[:, :-3] / np.maximum(some[:, _PER], 1), axis=0))
        usual.low, usual.high = np.quantile(usual.statistics(some), [USUAL, 1 - USUAL], axis=0)
        return usual

    @staticmethod
    def of_all(rows: DataFrame) -> Usual:
        """The same from the counts (x) of all rows of a table."""
        n, places = rows.count(), range(len(STATISTICS))
        got = ranked(rows, [(k, r) for k in places for r in ((n - 1) // 2, n // 2)], lambda x: x[:, :-3] / np.maximum(x[:, _PER], 1))
        usual = Usual((np.array(got[::2]) + np.array(got[1::2])) / 2)
        ends = [q * (n - 1) for q in (USUAL, 1 - USUAL)]
        got = ranked(rows, [(k, r) for k in places for e in ends for r in (int(e), min(int(e) + 1, n - 1))], usual.statistics)
        low, high = np.array(got).reshape(-1, 2, 2).transpose(1, 2, 0)
        usual.low, usual.high = (a + (b - a) * (e - int(e)) for (a, b), e in zip((low, high), ends, strict=True))
        return usual

    def statistics(self, counted: np.ndarray) -> np.ndarray:
        x = (counted[:, :-3] + _PRIOR * self.middle) / (np.maximum(counted[:, _PER], 1) + _PRIOR)
        x[:, _WORDS] = counted[:, -2]
        for name, ends in ENDS.items():
            k = STATISTICS.index(name)
            x[:, k] = np.log(np.clip(x[:, k], *ends))
        return x

    def beyond(self, counted: np.ndarray) -> np.ndarray:
        """What the forest sees: how far each statistic lies beyond its usual range, in widths of the range, as a logarithm."""
        x = self.statistics(counted)
        return np.log1p((np.maximum(x - self.high, 0) + np.maximum(self.low - x, 0)) / np.maximum(self.high - self.low, 1e-6))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(batch.num_rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


_WORDS = STATISTICS.index("words")
#: Which count each statistic is a share of (word characters, words, lines), and its prior.
_PER = np.array([{"c": -3, "w": -2, "l": -1}[k] for k in "cccclwwwwlw"])
_PRIOR = np.array([{"c": CHARACTERS, "w": WORDS, "l": LINES}[k] for k in "cccclwwwwlw"], float)


def path_norm(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    """Trees as arrays: a node goes to left + (x[feature] >= cut); leaves hold their depth in `length`."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    norm: float
    usual: Usual | None = None
    threshold: float = 1.0

    @staticmethod
    def grow(x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = 7, drawn: list[np.ndarray] | None = None) -> Forest:
        """drawn: the rows of each tree, where they were drawn before; x has no part then."""
        rng = np.random.default_rng(seed)
        rows, trees = (min(rows, len(x)), trees) if drawn is None else (len(drawn[0]), len(drawn))
        most = int(np.ceil(np.log2(max(rows, 2))))
        feature, cut, left, length, roots = [], [], [], [], []

        def node() -> int:
            for part, value in ((feature, -1), (cut, 0.0), (left, 0), (length, 0.0)):
                part.append(value)
            return len(feature) - 1

        for tree in range(trees):
            roots.append(node())
            todo = [(roots[-1], x[rng.choice(len(x), rows, replace=False)] if drawn is None else drawn[tree], 0)]
            while todo:
                at, part, depth = todo.pop()
                low, high = part.min(0), part.max(0)
                can = np.flatnonzero(high > low)
                if depth >= most or len(part) < 2 or not len(can):
                    length[at] = depth + path_norm(len(part))
                    continue
                f = int(rng.choice(can))
                c = float(rng.uniform(low[f], high[f]))
                right = part[:, f] >= c
                feature[at], cut[at], left[at] = f, c, node()
                node()
                todo += [(left[at], part[~right], depth + 1), (left[at] + 1, part[right], depth + 1)]
        return Forest(np.array(feature), np.array(cut), np.array(left), np.array(length), np.array(roots), max(path_norm(rows), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 to the minus mean path length over its usual value."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                if (f < 0).all():
                    break
                go = self.left[at] + (x[np.arange(len(x)), np.maximum(f, 0)] >= self.cut[at])
                at = np.where(f < 0, at, go)
            total += self.length[at]
        return np.exp2(-total / len(self.roots) / self.norm)


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """hash, y, failed, x (counts) of all labelled documents, a row for each id."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text")
            base = [base_statistics(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([failed(b) for b in base], pa.bool_()), _lists(np.array([counts(t, b) for t, b in zip(texts, base, strict=True)], float))], names=["doc_id", "failed", "x"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("failed", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    # Texts stay where they are: what is joined with the labels is a short row for each document.
    counted = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, schema)
    each = counted.join(known_labels(labels, label), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct("failed", "x")).alias("c"))
    return written(each.select(F.xxhash64("doc_id").alias("hash"), "y", "c.failed", "c.x"), "learned")


def drawn_rows(rows: DataFrame, n: int, usual: Usual, trees: int = TREES, size: int = ROWS) -> list[np.ndarray]:
    """For each tree, what the forest sees of the `size` rows of all n whose mixed hashes are the smallest: a draw without
    replacement, the same whatever the partitioning. Rows over a bound that leaves half as many again stay in their tasks."""
    size, share = min(size, n), 1.5 * size / n
    salts = mix64(np.arange(1, trees + 1))
    while True:
        bound = np.uint64(min(int(share * 2**64), 2**64 - 1))

        def run(batches: Iterator[pa.RecordBatch], bound: np.uint64 = bound) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    draw = mix64(batch.column(0).to_numpy().astype(np.uint64)[:, None] ^ salts[None, :])
                    at, tree = np.nonzero(draw <= bound)
                    yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(draw[at, tree].view(np.int64)), _lists(usual.beyond(_matrix(batch, "x"))[at])], names=["tree", "draw", "x"])

        got = rows.select("hash", "x").mapInArrow(run, "tree long, draw long, x array<double>").toArrow()
        tree, draw, x = got["tree"].to_numpy(), got["draw"].to_numpy().view(np.uint64), got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
        if share >= 1 or np.bincount(tree, minlength=trees).min() >= size:
            order = np.lexsort((*x.T, draw, tree))
            first = np.searchsorted(tree[order], np.arange(trees))
            return [x[order[f : f + size]] for f in first]
        share *= 2


def fit(docs: DataFrame, labels: DataFrame, loss: float = LOSS, label: str = "quality") -> Forest | None:
    """The forest and its calibrated threshold from all labelled documents, or None if labels do not hold both kinds."""
    rows = learned(docs, labels, label)
    good, bad = F.col("y") == 1, F.col("y") == 0
    s = rows.agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(good & ~F.col("failed")).alias("passed")).first()
    if s["good"] in (0, s["n"]):
        return None
    usual = Usual.of_all(rows.where(good & ~F.col("failed")) if s["passed"] else rows)
    forest = Forest.grow(None, drawn=drawn_rows(rows, s["n"], usual))
    forest.usual = usual
    if s["passed"]:
        scored = _scored(rows.where(~F.col("failed")), forest)
        forest.threshold = threshold_of_all(scored, s["passed"], loss)
        removed(scored)
    removed(rows)
    return forest


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """y, score of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(forest.usual.beyond(_matrix(batch, "x"))))], names=["y", "score"])

    return written(rows.select("y", "x").mapInArrow(run, "y int, score double"), "scored")


def threshold_of_all(scored: DataFrame, n_good: int, loss: float) -> float:
    """`threshold` of a table (y, score), n_good of them good: the score over which `loss` of good lie, then up to the next bad
    one the last good one loses fewest."""
    most = next(k for k in range(int(loss * n_good) + 1, -1, -1) if k <= loss * n_good)
    least = ranked(scored.where("y = 1").select(F.array("score").alias("x")), [(0, max(n_good - 1 - most, 0))])[0]
    bad = scored.where((F.col("y") == 0) & (F.col("score") > least)).agg(F.min("score")).first()[0]
    last = scored.where(F.col("score") < (bad if bad is not None else float("inf"))).agg(F.max("score")).first()[0]
    return float((last + bad) / 2) if bad is not None else float(last)


def threshold(good: np.ndarray, bad: np.ndarray, loss: float) -> float:
    """Of the scores over which at most `loss` of good lie: the middle of those that leave the fewest bad and then lose
    the fewest good."""
    if not len(good):
        return 1.0
    can = np.unique(np.concatenate([good, bad]))
    lost, left = (good[None, :] > can[:, None]).sum(1), (bad[None, :] <= can[:, None]).sum(1)
    can, lost, left = (x[lost <= loss * len(good)] for x in (can, lost, left))
    best = np.flatnonzero((left == left.min()) & (lost == lost[left == left.min()].min()))
    above = np.concatenate([good, bad])
    above = above[above > can[best[-1]]]
    return float((can[best[0]] + (above.min() if len(above) else can[best[-1]])) / 2)


def failed(base: tuple[int, int, int, int, int]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > REPEAT_PERCENT * base[0]


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(forest: Forest | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text")
            base = [base_statistics(t) for t in texts]
            bad = np.array([failed(b) for b in base], bool)
            score = forest.score(forest.usual.beyond(np.array([counts(t, b) for t, b in zip(texts, base, strict=True)], float))) if forest else np.zeros(len(bad))
            kept = ~bad & (score <= forest.threshold if forest else True)
            keep = batch.drop_columns(["text"])
            yield appended(keep, {n: pa.array([b[i] for b in base], pa.int64()) for i, n in enumerate(NAMES)} | {"base_failed": pa.array(bad), "anomaly": pa.array(score), "kept": pa.array(kept)})

    return run


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (0 without a forest) and kept, a row for each row."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in NAMES), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(_judged(forest), schema)


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of docs that the rules keep, with the columns that they had."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            verdict = next(iter(_judged(forest)(iter([batch.select(["text"])]))))
            yield batch.filter(verdict.column(verdict.num_columns - 1))

    return docs.mapInArrow(run, docs.schema)


def rejected_share(verdicts: DataFrame) -> DataFrame:
    """One row: documents, and those that each kind of rule rejects."""
    return verdicts.agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_base"), F.count_if(~F.col("kept") & ~F.col("base_failed")).alias("n_forest"))
