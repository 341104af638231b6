"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages (PASSAGE bytes of UTF-8 each, the whole text). Each passage is seen as the shares of its
byte trigrams, hashed to BUCKETS, and of its byte classes and pairs of neighbouring classes; a learned layer embeds it;
gated attention (tanh times sigmoid) weighs it; the weighted mean of the embeddings is scored. Only labels of documents
train the net, passages have none. The score depends on the text alone.

The net is fitted on all passages of all labelled rows of folds other than the held-out one. Up to LOCAL passages in all are
learned from on the driver, whole at each step. More are dealt by a hash of their ids to shards of about BATCH rows, EPOCHS
shards at most; each of EPOCHS steps takes the next shard, so every labelled row is learned from at least once. Workers send
sums of slopes as integers of a text each, so the net is the same whatever the partitioning; no text reaches the driver.
Of repeated rows of an id, the smallest label and text count. Defined results: a null or empty text is
one empty passage; without labels of both kinds every score is 0.5; repeated rows score alike; null ids stay; scored texts
of any length are read whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import Bitmap, appended, column, known_labels, packed, removed, ship, slices, written

PASSAGE, HIDDEN, ATTENTION = 512, 16, 8
MOST, EPOCHS, RATE = 32, 160, 0.02
#: Passages that the driver learns from by itself, rows of a shard, files at least, bytes of a row group, and bits of
#: slopes after the point.
LOCAL, BATCH, PARTS, ROW_GROUP, BITS = 1 << 15, 1024, 6, 1 << 20, 40
BUCKETS = 1 << 9
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
#: Bits, as a power of two, of the bitmap of labelled ids.
LABEL_BITS = 24
#: Bytes that are seen at a time, in whole passages: texts are scored in groups of so many, a longer text in parts.
GROUP = 1 << 18

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",", b"!?", b"|", b"#$%&*", b"<>{}[]\\/=@_~^", b"'\"`()-:;+", bytes(range(128, 192)), bytes(range(192, 256))]
CLASSES = len(_KINDS) + 1
CLASS = np.full(256, CLASSES - 1, np.uint8)
for _i, _kind in enumerate(_KINDS):
    CLASS[list(_kind)] = _i
#: What a passage is seen as: classes, pairs and length, then trigrams.
KINDS = CLASSES + CLASSES * CLASSES + 1
WIDTH = KINDS + BUCKETS


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and of each text the number of its passages."""
    return seen([packed(t) for t in texts])


def parts(raw: bytes) -> Iterator[np.ndarray]:
    """Feature rows of one text, GROUP bytes at a time."""
    for at in range(0, max(len(raw), 1), GROUP):
        yield seen([raw[at : at + GROUP]])[0]


def seen(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """`passages` of texts as bytes; takes some 70 times their size."""
    sizes = np.array([len(r) for r in raws])
    n = np.maximum(1, -(-sizes // PASSAGE))
    plain = np.frombuffer(b"".join(raws), np.uint8)
    code = CLASS[plain].astype(np.int64)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    bag = np.repeat(np.cumsum(n) - n, sizes) + (np.arange(len(code)) - begin) // PASSAGE
    total = int(n.sum())
    one = np.bincount(bag * CLASSES + code, minlength=total * CLASSES).reshape(total, CLASSES)
    same = bag[1:] == bag[:-1]
    two = np.bincount((bag[1:] * CLASSES + code[:-1])[same] * CLASSES + code[1:][same], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    within, wide = bag[2:] == bag[:-2], plain.astype(np.uint32)
    three = ((wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)) // np.uint32((1 << 32) // BUCKETS)
    three = np.bincount((bag[2:] * BUCKETS + three)[within], minlength=total * BUCKETS).reshape(total, -1)
    long = one.sum(1, keepdims=True)
    shares = [np.sqrt(x / np.maximum(long, 1)) for x in (one, two)]
    return np.hstack([*shares, long / PASSAGE, np.sqrt(three / np.maximum(three.sum(1, keepdims=True), 1))]), n


@dataclass
class Net:
    """Encoder w, attention (v, u, a), output (o): all passages of a bag weigh by softmax of their attention."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    o: np.ndarray
    c: np.ndarray

    NAMES = ("w", "b", "v", "u", "a", "o", "c")

    @staticmethod
    def start(seed: int = 3) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return Net(draw(WIDTH, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION), draw(HIDDEN), np.zeros(1))

    def embedded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.tanh(x @ self.w + self.b)
        return h, np.tanh(h @ self.v), 1 / (1 + np.exp(-h @ self.u))

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple]:
        return self.forward_of([x], n)

    def forward_of(self, some: Iterable[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, tuple]:
        """some: the rows of passages, in parts; what is kept of a part is some 30 numbers a passage."""
        first, bag = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        h, t, s = (np.concatenate(k) for k in zip(*map(self.embedded, some), strict=True))
        e = (t * s) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(weight[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ self.o + self.c, -30, 30)))
        return p, (first, bag, h, t, s, weight, z)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)[0]

    def slopes(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
        return self.slopes_of(lambda: [x], n, y, each)

    def slopes_of(self, some: Callable[[], Iterable[np.ndarray]], n: np.ndarray, y: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
        """The same from parts of the rows, which are gone through twice."""
        p, (first, bag, h, t, s, weight, z) = self.forward_of(some(), n)
        d = (p - y) * each
        dz = d[:, None] * self.o
        dw = (dz[bag] * h).sum(1)
        de = weight * (dw - np.add.reduceat(weight * dw, first)[bag])
        dt, ds = de[:, None] * self.a * s * (1 - t * t), de[:, None] * self.a * t * s * (1 - s)
        dh = (weight[:, None] * dz[bag] + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        w, at = 0, 0
        for x in some():
            w, at = w + x.T @ dh[at : at + len(x)].astype(x.dtype), at + len(x)
        return {"w": w, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "o": z.T @ d, "c": d.sum(keepdims=True)}


class Adam:
    """Steps of a net along its slopes."""

    def __init__(self) -> None:
        self.k, self.moved, self.spread = 0, {}, {}

    def step(self, net: Net, slopes: dict[str, np.ndarray]) -> None:
        self.k += 1
        k, moved, spread = self.k, self.moved, self.spread
        for name, g in slopes.items():
            g = g + 1e-5 * getattr(net, name)
            moved[name] = 0.9 * moved.get(name, 0) + 0.1 * g
            spread[name] = 0.999 * spread.get(name, 0) + 0.001 * g * g
            step = RATE * moved[name] / (1 - 0.9**k) / (np.sqrt(spread[name] / (1 - 0.999**k)) + 1e-8)
            setattr(net, name, (getattr(net, name) - step).astype(np.float32))


def train(x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Net:
    """Adam on all bags (rows of passages, and how many each has) at once; both labels weigh alike in sum."""
    net, adam = Net.start(), Adam()
    net.w = net.w.astype(x.dtype)
    each = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for _ in range(epochs):
        adam.step(net, net.slopes(x, n, y, each))
    return net


def summed(net: Net, texts: list[str | None], y: list[int], weight: dict[int, float]) -> np.ndarray:
    """Slopes of texts by their labels' weights as whole numbers of 2 ** -BITS, summed: in any order the same."""
    total = 0
    for text, label in zip(texts, y, strict=True):
        raw = packed(text)
        n = np.array([max(1, -(-len(raw) // PASSAGE))])
        slopes = net.slopes_of(lambda raw=raw: (x.astype(np.float32) for x in parts(raw)), n, np.array([label]), np.array([weight[label]]))
        total = total + np.rint(np.concatenate([slopes[k].ravel() for k in Net.NAMES]).astype(np.float64) * 2.0**BITS).astype(np.int64)
    return total


def train_shards(bags: DataFrame, shards: int, count: dict[int, int], epochs: int = EPOCHS) -> Net:
    """The same by steps of a shard each. bags: shard, y, text, files sorted by shard; count: rows of each label."""
    net, adam, less = Net.start(), Adam(), min(count.values())
    weight = {k: less / n for k, n in count.items()}
    net.w = net.w.astype(np.float32)
    for step in range(max(epochs, shards)):

        def run(batches: Iterator[pa.RecordBatch], net: Net = net) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in slices(batches):
                if batch.num_rows:
                    total = total + summed(net, column(batch, "text"), column(batch, "y"), weight)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["slopes"])

        sums = bags.where(F.col("shard") == step % shards).select("y", "text").mapInArrow(run, "slopes binary").collect()
        total = sum((np.frombuffer(r["slopes"], np.int64) for r in sums), np.zeros(sum(getattr(net, k).size for k in Net.NAMES), np.int64))
        flat, slopes, at = total * (2.0**-BITS * 0.5 * shards / less), {}, 0
        for name in Net.NAMES:
            part = getattr(net, name)
            slopes[name] = flat[at : at + part.size].reshape(part.shape).astype(part.dtype)
            at += part.size
        adam.step(net, slopes)
    return net


def sampled(texts: list[str | None]) -> list[bytes]:
    """Passages of each text, as 32-bit floats; of a text with more than MOST, so many that are evenly spaced."""
    out = []
    for t in texts:
        x, _ = passages([t])
        out.append(x[np.unique(np.linspace(0, len(x) - 1, min(MOST, len(x))).astype(int))].astype("<f4").tobytes())
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, y, text of all labelled ids outside the held-out fold, as a plan: texts without a label leave it before any shuffle,
    but for the few that a bitmap of labelled ids lets pass."""
    known = known_labels(labels, label, (FOLDS, HELD_OUT))
    name = F.xxhash64(F.col("doc_id").cast("string")).alias("hash")
    held = docs.sparkSession.sparkContext.broadcast(Bitmap(known.select(name), LABEL_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(2).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(held.value.may_hold(hashes))).select([0, 1])

    some = docs.where("doc_id is not null").select("doc_id", "text", name).mapInArrow(run, T.StructType([docs.schema["doc_id"], docs.schema["text"]]))
    rows = some.select("doc_id", F.lit(None).cast("int").alias("y"), "text", F.lit(1).alias("found")).union(known.select("doc_id", "y", F.lit(None).cast("string").alias("text"), F.lit(0).alias("found")))
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"), F.max("found").alias("found")).where("y is not null and found = 1").drop("found")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", local: int = LOCAL) -> Net | None:
    spark = docs.sparkSession
    ship(spark)
    bags = written(labelled(docs, labels, label), "bags")
    size = F.greatest(F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE), F.lit(1))
    per = {r["y"]: r for r in bags.groupBy("y").agg(F.count("*").alias("n"), F.sum(size).alias("passages")).collect()}
    if len(per) < 2:
        removed(bags)
        return None
    if sum(r["passages"] for r in per.values()) <= local:
        got = bags.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).orderBy("h", "doc_id").select("y", "text").toArrow()
        raws = [packed(t) for t in got["text"].to_pylist()]
        removed(bags)
        return train(np.concatenate([x.astype(np.float32) for raw in raws for x in parts(raw)]), np.array([max(1, -(-len(raw) // PASSAGE)) for raw in raws]), got["y"].to_numpy())
    count = {y: r["n"] for y, r in per.items()}
    shards = min(EPOCHS, -(-sum(count.values()) // BATCH))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("shard"))
    files = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    dealt = bags.select("y", "text", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.shiftright(place, 32).alias("part")).repartition(files, "part").drop("part").sortWithinPartitions("shard")
    # Short row groups in the order of shards, so that a step reads its own ones.
    laid = written(dealt, "shards", {"parquet.block.size": str(ROW_GROUP)})
    removed(bags)
    net = train_shards(laid, shards, count)
    removed(laid)
    return net


def scores(net: Net | None, texts: list[str | None]) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.5)
    out, group, size = [np.zeros(0)], [], 0
    for raw in [packed(t) for t in texts]:
        if group and size + len(raw) > GROUP:
            out.append(net.score(*seen(group)))
            group, size = [], 0
        if len(raw) > GROUP:
            out.append(net.forward_of(parts(raw), np.array([-(-len(raw) // PASSAGE)]))[0])
        else:
            group.append(raw)
            size += len(raw)
    return np.concatenate([*out, net.score(*seen(group))] if group else out)


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield appended(batch.drop_columns(["text"]), {"score": pa.array(scores(net, column(batch, "text")), pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep(docs: DataFrame, net: Net | None, cut: float = CUT) -> DataFrame:
    """The rows of docs that score `cut` or more, with the columns that they had."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(net, column(batch, "text")) >= cut))

    return docs.mapInArrow(run, docs.schema)


def predictions(scored: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted; a null id is in no fold."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
