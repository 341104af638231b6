"""Benchmark decontamination by template canonicalisation.

Words `[0-9A-Za-z and code points from U+0080]+` of texts become templates: numbers (digits), names
(capitalised words that do not begin a sentence) and units are typed placeholders, the rest is its
lower case. Windows of WINDOW template tokens of the benchmark are hash-joined with those of all documents, and
then slots are checked: what fills a slot of the item has to become one filling of the document wherever it stands in the
item (two fillings of the item may become one: 60 km in 40 minutes, and 50 km in 50 minutes). Where a filling becomes
two things, the document does not ask the item with other values, and only windows that are filled as in the item
count: a copy with one word changed. A document is contaminated by an item when windows cover at least COVERAGE of
the item's tokens, or ENOUGH tokens, along an alignment: a shift between item and document, or shifts that lie GAP apart
at most, as words may have been put in or left out.

Items without any window (under WINDOW tokens, or under LITERALS literal tokens in each) are too vague for
templates: of SHORTEST tokens or more, they match where they stand whole and unchanged but for case and signs.

Documents are scanned once, in Arrow batches. A fixed-size bitmap of the benchmark's hashes (FILTER_BITS)
lets through few other windows, whatever the benchmark's size; what passes is hash-joined in Spark.
The benchmark's side is broadcast only while it has at most BROADCAST_WINDOWS windows.

Defined results: null and empty texts match nothing; texts of any length are read whole; repeated items are
judged one by one; rows that repeat a doc_id are one document, contaminated if any of them is; rows with a null doc_id or
item_id never match (and are kept by `keep`); empty tables give no rows, an empty benchmark contaminates nothing. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import Bitmap, column, held_by_worker, mix64, packed, ship, slices, written

WINDOW, LITERALS, COVERAGE, ENOUGH, GAP, SHORTEST = 8, 4, 0.5, 13, 3, 4
FILTER_BITS = 24
BROADCAST_WINDOWS = 200_000
#: Units of measure, in full and short.
UNITS = frozenset("""mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms ton tons
tonne tonnes oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons second seconds sec minute minutes min
hour hours hr day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees
celsius fahrenheit kelvin watt watts volt volts amp amps joule joules newton newtons hz khz mhz mph kmh""".split())
#: Bytes that do not belong to words become spaces, those that end a sentence full stops.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 46 if chr(c) in ".!?\n:;" else 32 for c in range(256))
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_KIND_HASH = {NUMBER: 0x51ED270B, NAME: 0x7A3C9F11, UNIT: 0x2F6B4D83}
#: Words and bytes that a worker remembers.
MEMO, MEMO_BYTES = 200_000, 1 << 23


def _rows_of(word: str) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Within a sentence, and at its beginning: hash of the template token, its kind, and a name of what fills the slot
    (0 for a literal)."""
    low = word.lower()
    name = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) | 1
    literal = (name, LITERAL, 0)
    if word[0] in "0123456789":
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif word[0].isupper() and not word.isupper():
        return (_KIND_HASH[NAME], NAME, name), literal
    else:
        return literal, literal
    return ((_KIND_HASH[kind], kind, name),) * 2


class _Tokens(dict):
    """For each word two rows of a table, within a sentence and at its beginning, made when first asked for."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows = np.zeros((2048, 3), np.uint64)
        self[b"."] = self.size = 0

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.size += len(word)
        if 2 * at == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[2 * at : 2 * at + 2] = _rows_of(word.decode("utf-8", "surrogatepass"))
        return at


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, kinds and slot fillings of a whole text."""
    tokens = held_by_worker(("templates",), _Tokens)
    if len(tokens) > MEMO or tokens.size > MEMO_BYTES:
        tokens.forget()
    parts = packed(text).translate(_PLAIN).replace(b".", b" . ").split()
    at = np.fromiter(map(tokens.__getitem__, parts), np.int64, len(parts))
    word = at > 0
    begins = np.ones(len(at), bool)
    begins[1:] = ~word[:-1]
    got = tokens.rows[(2 * at + begins)[word]]
    return got[:, 0], got[:, 1].astype(np.int64), got[:, 2]


#: Odd factors of the window hash.
_FACTORS = mix64(np.arange(1, WINDOW + 1)) | np.uint64(1)


def windows(tokens: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows, and where they stand; those with too few literals are left out."""
    n = len(tokens) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += tokens[k : k + n] * _FACTORS[k]
    h = mix64(h)
    literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    at = np.flatnonzero(literal[WINDOW:] - literal[:n] >= LITERALS)
    return h[at], at


_BASE = 0x9E3779B97F4A7C15


def stretches(names: np.ndarray, long: int) -> np.ndarray:
    """A hash of every run of `long` words, as they are: (prefix sums of words times powers, shifted back to one power)."""
    n = len(names) - long + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = (np.cumprod(np.array([1] + [b] * len(names), np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(names) * up[:-1], dtype=np.uint64)])
    return mix64((run[long:] - run[:n]) * down[:n] + np.uint64(long))


def unchanged(tokens: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Names of the words themselves, in lower case."""
    return np.where(fill > 0, fill, tokens)


SCHEMA = "id long, hash long, pos int, n_tokens int, width int, fill array<long>"


def _rows(ident: int | None, tokens: np.ndarray, fill: np.ndarray, h: np.ndarray, at: np.ndarray, whole: int = 0) -> list[tuple]:
    """whole: words of a run that is unchanged; 0 for windows of a template."""
    return [(ident, int(x), int(p), len(tokens), whole or WINDOW, [] if whole else fill[p : p + WINDOW].astype(np.int64).tolist()) for x, p in zip(h.astype(np.int64), at, strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "hash", "pos", "n_tokens", "width", "fill"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """id, hash, pos, n_tokens, width, fill of every window of every item; of items without any, the whole item."""
    ship(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for ident, text in zip(column(batch, "item_id"), column(batch, "text"), strict=True):
                tokens, kinds, fill = template(text)
                h, at = windows(tokens, kinds)
                if len(h):
                    rows += _rows(ident, tokens, fill, h, at)
                elif len(tokens) >= SHORTEST:
                    rows += _rows(ident, tokens, fill, stretches(unchanged(tokens, fill), len(tokens)), np.zeros(1, np.int64), len(tokens))
            yield _batch(rows)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").mapInArrow(run, SCHEMA)


def passing(docs: DataFrame, known: Bitmap, whole: list[int]) -> DataFrame:
    """Windows of the documents, and runs of so many words, that the bitmap lets through."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for ident, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                tokens, kinds, fill = template(text)
                h, at = windows(tokens, kinds)
                may = held.value.may_hold(h)
                rows += _rows(ident, tokens, fill, h[may], at[may])
                for long in whole:
                    h = stretches(unchanged(tokens, fill), long)
                    at = np.flatnonzero(held.value.may_hold(h))
                    rows += _rows(ident, tokens, fill, h[at], at, long)
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, SCHEMA)


def matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, coverage (0 to 1), start and end (template tokens of the document): every pair
    of a document and an item with a window in common that is consistent, along its best alignment."""
    items = written(benchmark_windows(benchmark), "windows")
    n = items.count()
    # As many numbers as there are lengths of vague items.
    whole = sorted(r["width"] for r in items.where("size(fill) = 0").select("width").distinct().collect())
    found = passing(docs, Bitmap(items.select("hash"), FILTER_BITS), whole)
    side = items.select("hash", "width", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("n_tokens").alias("item_tokens"), F.col("fill").alias("item_fill"))
    side = F.broadcast(side) if n <= BROADCAST_WINDOWS else side
    hits = found.join(side, ["hash", "width"]).select(F.col("id").alias("doc_id"), "item_id", "item_tokens", "width", "pos", "item_pos", "fill", "item_fill", (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = written(hits, "hits")
    # Alignments: each shift (kind 0), and where there are several, each chain of shifts GAP apart at most (kind 1).
    pair = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    chains = hits.select("doc_id", "item_id", "shift").distinct().withColumn("new", F.coalesce((F.col("shift") - F.lag("shift").over(pair) > GAP).cast("int"), F.lit(0))).withColumn("chain", F.sum("new").over(pair))
    several = chains.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "item_id", "chain"))).where("n > 1").select("doc_id", "item_id", "shift", F.lit(1).alias("kind"), F.col("chain").alias("line"))
    lines = several.union(chains.select("doc_id", "item_id", "shift", F.lit(0), "shift"))
    aligned = written(hits.join(lines, ["doc_id", "item_id", "shift"]), "aligned")  # read twice below
    key = ["doc_id", "item_id", "kind", "line"]
    slots = aligned.select(*key, F.explode(F.arrays_zip("item_fill", "fill")).alias("s")).where("s.item_fill <> 0").groupBy(*key, F.col("s.item_fill").alias("slot")).agg(F.min("s.fill").alias("low"), F.max("s.fill").alias("high"))
    torn = slots.where("low <> high").select(*key, F.lit(True).alias("torn")).distinct()
    counted = aligned.join(torn, key, "left").where("torn is null or item_fill = fill")
    spans = counted.groupBy(*key).agg(
        F.count("*").alias("n_windows"), F.first("item_tokens").alias("item_tokens"), F.min("pos").alias("start"), F.max(F.col("pos") + F.col("width")).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("item_pos"), F.col("item_pos") + F.col("width") - 1))))).alias("covered"),
    )
    best = spans.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("covered") / F.col("item_tokens")).alias("coverage"), "n_windows", "start", "end", "covered")).alias("b"))
    return best.select("doc_id", "item_id", *(F.col(f"b.{c}").alias(c) for c in ("n_windows", "coverage", "start", "end")), ((F.col("b.coverage") >= COVERAGE) | (F.col("b.covered") >= ENOUGH)).alias("contaminated"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, best_item (the smallest of those that cover most) and coverage, a row for each doc_id."""
    found = matched(docs, benchmark).where("contaminated")
    worst = found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("i"))).alias("w"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return every.join(worst, "doc_id", "left").select(
        "doc_id", F.col("w").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), (-F.col("w.i")).alias("best_item"), F.coalesce("w.coverage", F.lit(0.0)).alias("coverage")
    )


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with the columns that they had; rows with a null id stay."""
    gone = matched(docs, benchmark).where("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
