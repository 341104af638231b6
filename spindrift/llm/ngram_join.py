"""N-gram Jaccard join with Bayesian candidate pruning (BayesLSH).

A document is the set of its word shingles (SHINGLE lower-cased words; a shorter text with a word is one
shingle). Documents with one set are copies; a class of copies is represented by its smallest doc_id.
Candidates are representatives that agree on a band of ROWS MinHash values out of BANDS bands: at the
threshold of 0.8, one pair in 300,000 has no such band, and fewer above it. For candidates, MinHash
values are compared STEP by STEP; with a uniform prior the similarity after m matches of n is
Beta(m + 1, n - m + 1), and a pair is dropped when it has a chance under TOLERANCE to reach the
threshold. The rest are verified exactly on the whole sets.

Buckets are found by a count that is pre-aggregated. What buckets connect is gathered, or compared bucket by
bucket where that ships fewer rows, and cut into blocks; each pair of blocks is a cell of its own, bounded in rows
and shingles, so a hot group is never listed pair by pair: a cell returns a link count for each member and a
spanning star. Up to BLOCK_ROWS near copies are shipped once, n of them ceil(n / BLOCK_ROWS) times. Groups of
documents that links connect are found by minimum labels with pointer jumping, over the roots of stars alone.

Defined results: a text without words (null, empty, blank) links to nothing and is a group of its own;
copies of one text link to each other; rows that repeat an id count as one document, whose text is the
smallest; rows with a null id get no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Bitmap, column, mix64, removed, ship, slices, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES, STEP, TOLERANCE = BANDS * ROWS, 32, 1e-6
#: Members, and shingles of all members, of a block; a cell holds two blocks at most.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20
#: Members of a cell that are compared with all at a time, and pairs that are at a time.
STRIP, PAIRS = 256, 1 << 14
FILTER_BITS = 24
#: Up to so many pairs are intersected one by one; columns of incidences at a time; steps of a product for one of a merge,
#: and steps that any merge takes.
FEW, WIDE, PRODUCT, LOOK_UP = 12, 1024, 400, 400


@cache
def _hashers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles of a whole text."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    seen: dict[str, int] = {}
    at = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    names = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in seen], np.uint64)[at]
    n = max(len(words) - SHINGLE + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + names[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def sketch(names: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (upper 32 bits) of a set that is not empty."""
    a, b = _hashers()
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(names), 4096):
        some = names[part : part + 4096]
        for k in range(0, HASHES, 16):
            out[k : k + 16] = np.minimum(out[k : k + 16], (some[None, :] * a[k : k + 16, None] + b[k : k + 16, None]).min(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of sketches (rows)."""
    rows = values.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of n with which P(similarity >= threshold) reaches the tolerance."""
    for m in range(n + 1):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        if sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) >= tolerance:
            return m
    return n


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, set_key (names a shingle set; null without words), n_shingles, bands, a row for each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in column(batch, "text")]
            keys = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            full = np.array([sketch(s) for s in sets if len(s)]).reshape(-1, HASHES)
            bands = iter(band_keys(full).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "set_key", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, set_key binary, n_shingles long, bands array<long>")


class Overlaps:
    """Sizes of intersections among the sets of a cell, for some of its pairs at a time."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        self._shared: tuple[np.ndarray, np.ndarray, int] | None = None

    def shared(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Names that two sets or more hold, numbered, with their owners, in the order of names; how many there are."""
        if self._shared is None:
            _, where, n = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
            owner, twice = np.repeat(np.arange(len(self.sets)), self.sizes), n > 1
            keep = twice[where]
            where, owner = (np.cumsum(twice) - 1)[where[keep]], owner[keep]
            order = np.argsort(where, kind="stable")
            self._shared = where[order], owner[order], int(twice.sum())
        return self._shared

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of sets a[k] and b[k]: one by one, or by a product of incidences where that takes fewer steps."""
        if len(a) > FEW:
            where, owner, n = self.shared()
            rows, at = np.unique(a, return_inverse=True)
            cols, to = np.unique(b, return_inverse=True)
            if n * len(rows) * len(cols) < PRODUCT * (self.sizes[a] + self.sizes[b] + LOOK_UP).sum():
                total = np.zeros((len(rows), len(cols)), np.float32)
                for k in range(0, n, WIDE):
                    low, high = np.searchsorted(where, [k, k + WIDE])
                    hot = np.zeros((len(self.sets), WIDE), np.float32)
                    hot[owner[low:high], where[low:high] - k] = 1
                    total += hot[rows] @ hot[cols].T
                return total[at, to].astype(np.int64)
        return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least member that links lead to, for each member) after links a[k] to b[k] came in."""
    while (label[a] != label[b]).any():
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        label = new[label]
    return label


def _cell(batch: pa.Table) -> pa.Table:
    """Links between the members of a cell: for each member the copies that it is linked with, and a spanning star.

    In gathered cells (band -1) pairs with a common band are looked at; in cells of a bucket those that have no
    earlier one. In a cell of two blocks only pairs across them are looked at. Members are gone through STRIP by
    STRIP, so that what is held at a time does not grow with the square of the cell.
    """
    ids = np.array(batch.column("rep").to_pylist(), np.int64)
    order = np.argsort(ids, kind="stable")
    ids, n = ids[order], len(ids)
    side = np.array(batch.column("side").to_pylist(), np.int64)[order]
    copies = np.array(batch.column("copies").to_pylist(), np.int64)[order]
    band, across = batch.column("band")[0].as_py(), batch.column("across")[0].as_py()
    raw = batch.column("names").to_pylist()
    overlaps = Overlaps([np.frombuffer(raw[k], "<u8") for k in order])
    size = overlaps.sizes
    values = np.array([np.frombuffer(x, "<u4") for x in batch.column("sketch").to_pylist()])[order]
    keys = band_keys(values)[:, : band if band >= 0 else BANDS]
    label, links = np.arange(n), np.zeros(n, np.int64)
    for low in range(0, n, STRIP):
        strip = np.arange(low, min(low + STRIP, n))
        look = strip[:, None] < np.arange(n)[None, :]
        if across:
            look &= side[strip][:, None] != side[None, :]
        first, second = np.nonzero(look)
        found = []
        for part in range(0, len(first), PAIRS):
            a, b = first[part : part + PAIRS] + low, second[part : part + PAIRS]
            if band:
                agree = (keys[a] == keys[b]).any(1) == (band < 0)
                a, b = a[agree], b[agree]
            matches = np.zeros(len(a), np.int64)
            for k in range(0, HASHES, STEP):
                matches += (values[a, k : k + STEP] == values[b, k : k + STEP]).sum(1)
                may = matches >= least_matches(k + STEP)
                a, b, matches = a[may], b[may], matches[may]
            found.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (strip[:0], strip[:0])
        if not len(a):
            continue
        both = overlaps.of(a, b)
        linked = both >= THRESHOLD * (size[a] + size[b] - both) - 1e-9
        a, b = a[linked], b[linked]
        links += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
        label = joined(label, a, b)
    hit = links > 0
    return pa.table({"rep": pa.array(ids[hit]), "root": pa.array(ids[label][hit]), "links": pa.array(links[hit])})


def _banded(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """rep, n_shingles, band, bucket of the bands whose bucket may be shared, by a bitmap of those that are."""
    held = keyed.sparkSession.sparkContext.broadcast(Bitmap(shared.select(F.col("bucket").alias("hash")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            bands = batch.column(2).flatten().to_numpy()
            at = np.flatnonzero(held.value.may_hold(bands.astype(np.uint64)))
            row = pa.array(at // BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array((at % BANDS).astype(np.int32)), pa.array(bands[at], pa.int64())], names=["rep", "n_shingles", "band", "bucket"])

    return keyed.select("rep", "n_shingles", "bands").mapInArrow(run, "rep long, n_shingles long, band int, bucket long")


def blocks(members: F.Column, shingles: F.Column) -> F.Column:
    """Blocks that so many members are cut into."""
    return F.greatest(F.ceil(members / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _gathered(bucketed: DataFrame) -> DataFrame:
    """band, bucket, rep, blocks: the members of what is compared pair by pair.

    Representatives that buckets connect are gathered once (band -1), or compared bucket by bucket where that ships
    fewer rows, as far-fetched connections may join any number.
    """
    sized = bucketed.groupBy("bucket").agg(F.min("rep").alias("root"), F.count("*").alias("m"), F.sum("n_shingles").alias("s")).withColumn("blocks", blocks(F.col("m"), F.col("s")))
    sized = written(sized, "sized")
    stars = bucketed.join(sized.select("bucket", "root"), "bucket").select("rep", "root")
    reach = written(connected(stars).withColumnRenamed("group", "g"), "reach")
    apart = sized.withColumnRenamed("root", "rep").join(reach, "rep").groupBy("g").agg(F.sum(F.col("m") * F.col("blocks")).alias("apart"))
    whole = bucketed.select("rep", "n_shingles").distinct().join(reach, "rep").groupBy("g").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s")).withColumn("blocks", blocks(F.col("m"), F.col("s")))
    of = written(reach.join(whole.join(apart, "g").select("g", "blocks", (F.col("m") * F.col("blocks") <= F.col("apart")).alias("once")), "g"), "groups")
    gathered = of.where("once").select(F.lit(-1).alias("band"), F.col("g").alias("bucket"), "rep", "blocks")
    others = bucketed.join(of.where("not once").select("rep"), "rep").join(sized.select("bucket", "blocks"), "bucket")
    return gathered.union(others.select("band", "bucket", "rep", "blocks"))


def _cells(members: DataFrame) -> DataFrame:
    """band, bucket, rep, side, cell_i, cell_j: the members of each pair of blocks."""
    rows = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("band", "bucket", "rep", F.col("block").alias("side"), F.least("block", "other").alias("cell_i"), F.greatest("block", "other").alias("cell_j"))


def root_edges(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep, root (the least of its roots) of stars (rep, root), and edges (x, y) between roots of one rep.

    A root is the least member of its star and a member itself, so what stars connect is what these edges do:
    they grow with the number of stars, not of their members.
    """
    own = written(stars.groupBy("rep").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "stars")
    edges = own.where("size(roots) > 1").select(F.explode("roots").alias("x"), F.col("root").alias("y")).where("x <> y").distinct()
    return own.select("rep", "root"), written(edges, "edges")


def connected(stars: DataFrame) -> DataFrame:
    """rep, group: the least id that stars (rep, root) lead to, for every rep.

    Each round every root takes the least label of its neighbours and then the label of that label; the labels
    are a table in the shared folder. Ends when no label moves.
    """
    own, edges = root_edges(stars)
    if edges.isEmpty():
        return own.withColumnRenamed("root", "group")
    both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = held = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("x").alias("near"), F.col("label").alias("far"))
        step = labels.join(near, "x").withColumn("near", F.least("near", "label")).join(jump, "near", "left")
        new = written(step.select("x", F.least("far", "near").alias("label"), (F.least("far", "near") < F.col("label")).alias("moved")), "labels")
        removed(held)
        held, labels = new, new.select("x", "label")
        if new.where("moved").isEmpty():
            return own.join(labels.select(F.col("x").alias("root"), "label"), "root", "left").select("rep", F.coalesce("label", "root").alias("group"))


@dataclass
class Compared:
    """marks (doc_id, set_key, ...), reps (set_key, rep, copies), cells (members of what was compared) and links (rep, root,
    links: of each member and cell)."""

    marks: DataFrame
    reps: DataFrame
    cells: DataFrame
    links: DataFrame


def compared(docs: DataFrame) -> Compared:
    """The candidates of docs, compared."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = written(sketched(docs), "sketches")
    if marks.groupBy("doc_id").count().where("count > 1").limit(1).count():  # repeated ids: the smallest text counts
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        marks = written(sketched(docs), "sketches")
    reps = written(marks.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    keyed = marks.where("set_key is not null").select(F.col("doc_id").alias("rep"), F.xxhash64("set_key").alias("set_hash"), "n_shingles", "bands")
    # A bucket is shared when it holds different sets.
    buckets = keyed.select("set_hash", F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high"))
    shared = written(buckets.where("low <> high").select("bucket"), "shared")
    bucketed = written(_banded(keyed, shared).join(shared, "bucket").join(reps.select("rep"), "rep"), "buckets")
    cells = written(_cells(_gathered(bucketed)), "cells")

    active = spark.sparkContext.broadcast(Bitmap(cells.select(F.xxhash64("rep").alias("hash")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(active.value.may_hold(np.array(column(batch, "hash"), np.int64).astype(np.uint64))))
            sets = [shingles(t) for t in column(batch, "text")]
            ids = batch.column(0).to_pylist()
            some = [k for k, x in enumerate(sets) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in some], pa.int64()), pa.array([sets[k].astype("<u8").tobytes() for k in some], pa.binary()), pa.array([sketch(sets[k]).astype("<u4").tobytes() for k in some], pa.binary())], names=["rep", "names", "sketch"])

    whole = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(run, "rep long, names binary, sketch binary")
    full = cells.join(whole.join(reps.select("rep", "copies"), "rep"), "rep").withColumn("across", F.col("cell_i") != F.col("cell_j"))
    links = written(full.groupBy("band", "bucket", "cell_i", "cell_j").applyInArrow(_cell, "rep long, root long, links long"), "links")
    return Compared(marks, reps, cells, links)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, rep_id (least doc_id with the same shingles), class_id (least doc_id that links lead to),
    n_links (other documents at the threshold or above, copies included), a row for each doc_id."""
    found = compared(docs)
    groups = connected(found.links.select("rep", "root"))
    linked = found.links.groupBy("rep").agg(F.sum("links").alias("links")).join(groups, "rep", "left")
    known = found.reps.join(linked, "rep", "left").select("set_key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "rep").alias("group"))
    return found.marks.select("doc_id", "set_key").join(known, "set_key", "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("group", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links")
    )


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that are not the first (smallest id) of their group; null ids stay."""
    gone = join(docs).where("class_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
