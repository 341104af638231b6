"""SentencePiece encoding by forward-filtering backward-sampling, and its lossless decoding.

The lattice of a word holds every piece at every place; a character without a piece of its own is a chain of
byte pieces. The forward pass sums the weights exp(ALPHA * score) of all paths to each node, and
the backward pass draws, from the end, each piece with its share of that sum: a draw from all segmentations in
proportion to their weight, but for shares that are whole multiples of 2 ** -DRAW_BITS. Draws are integers from a
counter keyed by (seed, doc_id, word, step) and are compared with integer thresholds; sums take a word's own edges
alone, in one order, by IEEE additions, products and divisions of weights in single precision. So a
row's segmentation does not depend on batches, partitions, retries or what a worker remembers.

A text is encoded behind one added space; each space begins a word. A literal U+2581 is written in bytes,
so decoding gives back any text. Lattices of words are remembered up to MEMO_NODES nodes; all words of a
batch take their backward steps together.

Defined results: a null text is encoded and decoded as the empty one (one space piece); rows with a null
id share one key; repeated rows get one segmentation; an empty table gives no rows; a text of any length is encoded
whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spindrift.llm.common import appended, column, held_by_worker, mix64, ship, slices
from spindrift.llm.pieces import SPACE, UNKNOWN_PENALTY, vocabulary

ALPHA, SEED = 0.5, 17
MEMO_NODES = 2_500_000
#: Up to this level all words of a batch take their forward pass together; longer ones go on alone.
LEVELS = 64
#: Bits of a draw; the other bits of 64 number the nodes that are held.
DRAW_BITS = 36
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class Sampler:
    """Lattices of words as one array of edges, in the order of the nodes that they enter.

    cum[k] holds the number of the node that edge k enters in its upper bits, and below them the cumulative share of the
    node's edges as an integer; the last edge has the next node's 0. One binary search of (node, draw) finds the drawn edge.
    """

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        words = vocabulary(path)
        # A space stands at the beginning of pieces alone, so no match goes beyond a word.
        inside = [i for i in words.normal if SPACE not in words.pieces[i][1:]]
        self.iter = words.matcher(inside, lambda i: i).iter
        self.stand_in = words.stand_in
        self.length = np.array([len(p) for p in words.pieces])
        self.weight = np.exp(alpha * np.array(words.scores)).astype(np.float32).astype(float)
        self.fallback = float(np.float32(math.exp(alpha * (words.lowest - UNKNOWN_PENALTY))))
        self.byte = np.array([words.bytes[b] for b in range(256)])
        self.raw = [b""] * len(words.pieces)
        for i in words.normal:
            self.raw[i] = words.pieces[i].replace(SPACE, " ").encode("utf-8")
        for b, i in words.bytes.items():
            self.raw[i] = bytes([b])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.nodes = 0
        self.cum, self.source, self.piece = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Of words that are put side by side: target, source, piece, weight and level of each edge; the number of nodes.

        Word j has a node before its first character and one behind each. Level: characters up to the target.
        """
        plain = "".join(SPACE + w for w in words)
        sizes = np.array([len(w) + 1 for w in words])
        of = np.repeat(np.arange(len(words)), sizes)
        depth = np.arange(len(plain)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        found = np.fromiter(chain.from_iterable(self.iter("".join(SPACE + w.replace(SPACE, self.stand_in) for w in words))), np.int64).reshape(-1, 2)
        end, piece = found[:, 0], found[:, 1]
        target = end + of[end] + 1
        source, weight, level = target - self.length[piece], self.weight[piece], depth[end]
        nodes = len(plain) + len(words)
        alone = np.ones(len(plain), bool)
        alone[end[self.length[piece] == 1]] = False
        more: list[tuple] = []
        for k in np.flatnonzero(alone).tolist():  # a chain of bytes; the nodes within it are entered by one edge
            raw = self.byte[list(plain[k].encode("utf-8", "surrogatepass"))]
            at = k + of[k]
            for b in raw[:-1]:
                more.append((nodes, at, b, 1.0, -1))
                at, nodes = nodes, nodes + 1
            more.append((k + of[k] + 1, at, raw[-1], self.fallback, depth[k]))
        if more:
            t, s, p, w, d = (np.array(x) for x in zip(*more, strict=True))
            target, source, piece, weight, level = (np.concatenate(x) for x in ((target, t), (source, s), (piece, p), (weight, w), (level, d)))
            order = np.argsort(target, kind="stable")
            target, source, piece, weight, level = (x[order] for x in (target, source, piece, weight, level))
        return target, source, piece, weight, level, nodes

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in first and last, its begin and end nodes; new words are added."""
        got = list(map(self.place.get, words))
        new = list(dict.fromkeys(words[k] for k, x in enumerate(got) if x is None))
        if new:
            if self.nodes and self.nodes + sum(map(len, new)) + 2 * len(new) > MEMO_NODES:
                self.forget()
                new = list(dict.fromkeys(words))
            self.learn(new)
            got = list(map(self.place.__getitem__, words))
        return np.array(got, np.int64)

    def learn(self, new: list[str]) -> None:
        target, source, piece, weight, level, nodes = self.edges(new)
        part, scale = np.ones(nodes), np.zeros(nodes, np.int32)  # the sum of all paths to each node is part * 2 ** scale
        share = np.ones(len(target))
        chained = level < 0
        first = np.flatnonzero(np.diff(target, prepend=-1))
        count = np.diff(first, append=len(target))
        heights = level[first]
        by_level = np.argsort(heights, kind="stable")
        heights = heights[by_level]
        # The first byte of a chain carries the sum of its source on to the last one.
        lead = np.arange(nodes)
        for k in np.flatnonzero(chained):
            lead[target[k]] = lead[source[k]]
        source_sum = lead[source]
        top = int(heights.max(initial=0))
        for d in range(1, min(top, LEVELS) + 1):
            low, high = np.searchsorted(heights, [d, d + 1])
            groups = by_level[low:high]
            sizes = count[groups]
            inner = np.cumsum(sizes) - sizes
            at = np.repeat(first[groups] - inner, sizes) + np.arange(int(sizes.sum()))
            lift = scale[source_sum[at]]
            most = np.maximum.reduceat(lift, inner)
            x = np.ldexp(part[source_sum[at]] * weight[at], lift - np.repeat(most, sizes))
            sums = np.add.reduceat(x, inner)
            share[at] = x / np.repeat(sums, sizes)
            ends = target[first[groups]]
            part[ends], raised = np.frexp(sums)
            scale[ends] = most + raised
        for g in by_level[np.searchsorted(heights, LEVELS + 1) :].tolist():  # the ends of very long words
            at = slice(first[g], first[g] + count[g])
            lift = scale[source_sum[at]]
            x = np.ldexp(part[source_sum[at]] * weight[at], lift - lift.max())
            total = np.add.reduceat(x, [0])[0]
            share[at] = x / total
            part[target[first[g]]], raised = np.frexp(total)
            scale[target[first[g]]] = lift.max() + raised
        run = np.cumsum(np.rint(share * (1 << DRAW_BITS)).astype(np.int64))  # integers: the same wherever the word stands
        run -= np.repeat(run[first] - np.rint(share[first] * (1 << DRAW_BITS)).astype(np.int64), count)
        run = np.minimum(run, 1 << DRAW_BITS)
        run[first + count - 1] = 1 << DRAW_BITS
        sizes = np.array([len(w) + 2 for w in new])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        end = self.nodes + np.cumsum(sizes)
        self.first, self.last = np.concatenate([self.first, end - sizes]), np.concatenate([self.last, end - 1])
        if self.nodes + nodes >= 1 << (64 - DRAW_BITS):
            raise ValueError("the words of a batch have too many nodes")
        self.cum = np.concatenate([self.cum, ((target + self.nodes).astype(np.uint64) << np.uint64(DRAW_BITS)) + run.astype(np.uint64)])
        self.source = np.concatenate([self.source, (source + self.nodes).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece.astype(np.uint16)])
        self.nodes += nodes

    def encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids (u16) of each text; keys: a 64-bit key for each."""
        split = [(t or "").split(" ") for t in texts]
        flat = [w for x in split for w in x]
        at = self.places(flat)
        sizes = np.array([len(x) for x in split])
        begin = np.cumsum(sizes) - sizes
        start, node = self.first[at], self.last[at]
        key = mix64(np.repeat(keys, sizes) + (np.arange(len(flat)) - np.repeat(begin, sizes)).astype(np.uint64) * _GOLD)
        steps = np.zeros(len(flat), np.int64)
        active, drawn = np.argsort(node, kind="stable"), []  # searches near each other are quick
        step = 0
        while len(active):
            draw = mix64(key[active] + np.array([step], np.uint64) * _ODD) >> np.uint64(64 - DRAW_BITS)
            edge = np.searchsorted(self.cum, (node[active].astype(np.uint64) << np.uint64(DRAW_BITS)) + draw, side="right")
            drawn.append((active, self.piece[edge]))
            node[active] = self.source[edge]
            step += 1
            steps[active] = step
            active = active[node[active] != start[active]]
        place = np.cumsum(steps) - 1
        out = np.empty(int(steps.sum()), np.uint16)
        for k, (who, ids) in enumerate(drawn):
            out[place[who] - k] = ids
        ends = np.concatenate([[0], np.cumsum(steps)])
        cut = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def sampler(path: str, alpha: float = ALPHA) -> Sampler:
    return held_by_worker(("sampler", path, alpha), lambda: Sampler(path, alpha))


def row_keys(ids: list[int | None], seed: int = SEED) -> np.ndarray:
    return mix64(np.array([-1 if i is None else i for i in ids], np.int64).astype(np.uint64) * _GOLD + mix64(np.array([seed], np.uint64)))


def _encoded(texts: list[str | None], ids: list[int | None], path: str, alpha: float, seed: int) -> list[np.ndarray]:
    return sampler(path, alpha).encode(texts, row_keys(ids, seed))


def encode(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian u16) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = _encoded(column(batch, "text"), column(batch, "doc_id"), path, alpha, seed)
            yield appended(batch.drop_columns(["text"]), {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id, ids."""
    ship(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = sampler(path).decode
        for batch in slices(batches):
            yield appended(batch.drop_columns(["ids"]), {"text": pa.array([to_text(np.frombuffer(x, "<u2")) for x in column(batch, "ids")], pa.string())})

    return coded.select("doc_id", "ids").mapInArrow(run, T.StructType([coded.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trips(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian u16), lossless: decoding gave back the whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = sampler(path, alpha).decode
        for batch in slices(batches):
            texts = column(batch, "text")
            ids = _encoded(texts, column(batch, "doc_id"), path, alpha, seed)
            same = [to_text(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            yield appended(batch.drop_columns(["text"]), {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u2").tobytes()) for x in ids], pa.int64()), "lossless": pa.array(same)})

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())]))
