"""What the operators of this subpackage share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

_own_folders: dict[str, str] = {}
_shipped: set[str] = set()

#: Rows of an Arrow batch that are held as Python objects at a time.
SLICE = 256


#: Rows and bytes of an Arrow batch between the JVM, which holds some of them outside its heap, and a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}

_held: dict[tuple, object] = {}


def held_by_worker(key: tuple, make: Callable[[], T]) -> T:
    """What make() returned for the key; a worker holds one such thing at a time, so operators do not pile up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors that do not have the repository on their path, and batches short.

    The sizes of BATCH are set for the session, as plans are made lazily: they hold for what the session runs later, too.
    """
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{package.name}_src.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only where it is unset and all of Spark runs in
    this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return _own_folders.setdefault(app, "file://" + tempfile.mkdtemp(prefix="shared-"))


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more, as that of an earlier round."""
    spark, path = df.sparkSession, df._written
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def packed(text: str | None) -> bytes:
    """UTF-8 of a text; null is the empty text."""
    return (text or "").encode("utf-8", "surrogatepass")


def appended(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bitmap:
    """Which 64-bit hashes occur, as 2 ** bits bits by their upper bits: of a fixed size, whatever it is made from."""

    def __init__(self, hashes: DataFrame, bits: int) -> None:
        """hashes: one long column `hash`."""
        self.bits, self.words = bits, np.zeros(1 << (bits - 5), np.uint32)
        top = F.shiftrightunsigned("hash", 64 - bits)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 31 as int))")
        got = hashes.groupBy(F.shiftright(top, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.words[got["word"].to_numpy()] = got["bits"].to_numpy()

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """False for hashes that do not occur, true for those that do and a few others."""
        top = hashes >> np.uint64(64 - self.bits)
        return (self.words[(top >> np.uint64(5)).astype(np.int64)] >> (top & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def known_labels(labels: DataFrame, label: str, folds: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, y of all labelled ids.

    folds=(5, 0) leaves out ids whose crc32 (of the id as text) has remainder 0 by 5. Null ids or labels and labels other
    than 0 and 1 are ignored; of repeated rows of an id, the smallest label counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if folds:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds[0] != folds[1])
    return known.groupBy("doc_id").agg(F.min("y").alias("y"))


#: Buckets, as a power of two, that a pass over the values cuts a bracket into, and rows that it looks at together.
RANK_BITS, RANK_ROWS = 12, 1 << 16


def ranked(rows: DataFrame, wanted: list[tuple[int, int]], of: Callable[[np.ndarray], np.ndarray] | None = None) -> list[float]:
    """Exact order statistics of all rows: of `x` (array<double>, none below 0) for each (place, rank) the value at that place
    of the rank, from 0, in ascending order.

    The bits of such doubles are in the order of the values. A pass counts the buckets of a bracket and goes on within the one
    that holds the rank, so counts alone leave the tasks: of each bracket 2 ** RANK_BITS at most. `of` makes the values from those of
    x, here and not in a step before, which would take a second worker for each task.
    """
    found: list[float] = [0.0] * len(wanted)
    todo = {k: (place, 0, 63, rank) for k, (place, rank) in enumerate(wanted)}
    while todo:
        brackets = sorted({b[:3] for b in todo.values()})

        def run(batches: Iterator[pa.RecordBatch], brackets: list[tuple[int, int, int]] = brackets) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def counted() -> pa.RecordBatch:
                keys = (np.concatenate(held) + 0.0).view(np.int64)
                out = []
                for k, (place, low, wide) in enumerate(brackets):
                    at = np.sort(keys[:, place])
                    at = at[np.searchsorted(at, low) : np.searchsorted(at, low + (1 << wide) - 1, "right")]
                    bucket = (at - low) >> max(wide - RANK_BITS, 0)
                    name, first, n = np.unique(bucket, return_index=True, return_counts=True)
                    out.append((np.full(len(name), k), name, n, at[first], at[first + n - 1]))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["k", "bucket", "n", "least", "most"])

            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                    held.append(of(x) if of else x)
                    size += batch.num_rows
                if size >= RANK_ROWS:
                    yield counted()
                    held, size = [], 0
            if held:
                yield counted()

        made = rows.select("x").mapInArrow(run, "k long, bucket long, n long, least long, most long")
        per: dict[int, list] = {}
        for r in made.groupBy("k", "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
            per.setdefault(r["k"], []).append((r["bucket"], r["n"], r["least"], r["most"]))
        per = {k: sorted(v) for k, v in per.items()}
        for k, (place, low, wide, rank) in list(todo.items()):
            for bucket, n, least, most in per[brackets.index((place, low, wide))]:
                if rank < n:
                    break
                rank -= n
            else:
                raise ValueError("there are fewer rows than a rank asks for")
            if least == most or n == 2:
                found[k] = float(np.array([most if rank else least], np.int64).view(np.float64)[0])
                del todo[k]
            else:
                todo[k] = place, low + (bucket << max(wide - RANK_BITS, 0)), max(wide - RANK_BITS, 0), rank
    return found
