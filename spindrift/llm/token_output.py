"""Token ids as binary blocks, coded by a static range asymmetric numeral system.

Every text is tokenised once; the counts of all ids of all documents make one frequency table that all
blocks share. Documents are laid out in ascending doc_id order (null ids first, repeated ids by text): range
partitions hold ascending id ranges and frames ascend within them. The output is a folder of two Parquet tables:
`frequencies` (id, frequency: the shared table) and `frames`; any later session reads it with `opened`. A frame holds
whole documents and is a binary record:

    magic "RNS1", u32 docs, u64 first token's place in the partition, u32 crc32 of the table, u32 blocks,
    per document: i64 doc_id, u8 null flag, u32 tokens
    per block (the checkpoints): u32 tokens, u32 words, u32 crc32 of the words, LANES u64 states
    per block: its words, u32 each
    u32 crc32 of all before

Blocks are independent: BLOCK tokens are dealt to LANES interleaved coders whose states stand in the
checkpoint, so any block of any frame can be decoded alone (`block`) and in parallel, and a stretch of tokens takes only
the blocks that hold it (`stretch`). Frames are rows of a Parquet table, because Python workers cannot open files of a
store that only Spark reaches; `frame_bytes` of a row is the whole file format.

Defined results: a null or empty text is the end id alone; special tokens' strings are ordinary text;
unknown code points are bytes to the tokenizer; a damaged frame raises ValueError; a text of any length is one document
of one frame; repeated ids are documents of their own; an empty table gives empty tables; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import column, held_by_worker, mix64, shared_folder, ship, slices, written

END = 0
LANES, BLOCK, FRAME = 2048, 1 << 19, 1 << 20
#: Frequencies of the shared table add up to 2 ** BITS; states stay in [2 ** 31, 2 ** 63).
BITS, LOW = 20, np.uint64(1 << 31)
#: Parts that a worker remembers, and their ids.
SLOTS, POOL = 1 << 21, 1 << 23
MAGIC = b"RNS1"


# -- tokens ---------------------------------------------------------------------------------------


def _letters() -> np.ndarray:
    """By code point under 0x800: whether it is a letter or a number."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x800)])


class Encoder:
    """Ids of whole texts as little-endian u16, with the tokenizers library.

    This byte-level tokenizer cuts texts into pre-tokens: runs of letters, of digits and of other signs, each
    with one space before it, and runs of white space. So a new one begins at a single space between
    two characters that are not white space, at a full stop or comma behind a letter or digit, and at a line
    break behind what is not white space. Texts are cut there, and each part is encoded once and remembered
    by 128 bits of hashes (SLOTS parts at most). A text with a mark that stands otherwise goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letter = _letters()
        rng = np.random.default_rng(11)
        self.random = rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
        self.powers = [np.array([1, b], np.uint64) for b in rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
        self.forget(0)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u2").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, parts: list[str]) -> list[bytes]:
        """As whole, for parts of a space and then letters and digits: a token begins a part where it begins with a space."""
        out: list[bytes] = []
        for x in self.tokenizer.encode_batch_fast(["".join(parts[k : k + 256]) for k in range(0, len(parts), 256)], add_special_tokens=False):
            ids = np.array(x.ids, "<u2")
            cut = np.flatnonzero(self.spaced[ids]).tolist()
            raw = ids.tobytes()
            out += [raw[2 * a : 2 * b] for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)]
        return out

    def regular(self, texts: list[str]) -> np.ndarray:
        """Whether every mark of a text stands where a pre-token begins."""
        raws = [("x" + t + "x").encode("utf-8") for t in texts]
        sizes = np.array([len(r) for r in raws])
        at = np.frombuffer(b"".join(raws), np.uint8)
        point = np.zeros(len(at), np.int64)  # code points as far as they have two bytes, at either byte; else 0x7FF
        two = (at[:-1] >= 0xC2) & (at[:-1] < 0xE0)
        point[:] = np.where(at < 0x80, at, 0x7FF)
        pairs = np.flatnonzero(two)
        point[pairs] = point[pairs + 1] = ((at[pairs].astype(np.int64) & 31) << 6) | (at[pairs + 1] & 63)
        letter = self.letter[point]
        ascii_sign = (at > 32) & (at < 127)
        mark = (at == 46) | (at == 44)
        bad = mark[1:] & ~letter[:-1]
        bad |= (at[1:] == 32) & ~(letter[:-1] | ascii_sign[:-1])
        bad |= (at[:-1] == 32) & ~(letter[1:] | (ascii_sign[1:] & ~mark[1:]))
        bad |= (at[1:] == 10) & ~(letter[:-1] | ascii_sign[:-1])
        bad |= at[1:] == 0
        return ~np.logical_or.reduceat(np.append(bad, False), np.cumsum(sizes) - sizes)

    def forget(self, tokens: int) -> None:
        """Empties the memory: a table of SLOTS parts by two 64-bit hashes, and the ids of the parts one after another."""
        self.one, self.two = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.offset, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(max(POOL, 2 * tokens), np.uint16), 0

    def hashes(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each part: sums of random numbers of its bytes times powers of an odd number."""
        place = np.arange(len(at)) - np.repeat(start, size)
        while len(self.powers[0]) <= size.max():
            self.powers = [np.concatenate([x, x * x[-1] * x[1]]) for x in self.powers]
        return [mix64(np.add.reduceat(r[at] * x[place], start)) | np.uint64(1) for r, x in zip(self.random, self.powers, strict=True)]

    def learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of new parts into the pool; returns where they stand and how many they are."""
        word = [p[:1] == " " and p[1:].isalnum() for p in parts]
        known = [p for p, w in zip(parts, word, strict=True) if w]
        words, other = iter(self.words(known)), iter(self.whole([p for p, w in zip(parts, word, strict=True) if not w]))
        ids = [next(words if w else other) for w in word]
        count = np.array([len(x) // 2 for x in ids], np.int64)
        offset = self.used + np.cumsum(count) - count
        flat = np.frombuffer(b"".join(ids), "<u2")
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return offset, count

    def cut(self, raws: list[bytes]) -> list[bytes]:
        """Ids of regular texts that are not empty, all parts of all texts looked up together."""
        joined = b"".join(raws)
        at, sizes = np.frombuffer(joined, np.uint8), np.array([len(r) for r in raws])
        if self.used + len(at) > len(self.pool):
            self.forget(len(at))
        begin = np.cumsum(sizes) - sizes
        marks = (at == 32) | (at == 46) | (at == 44) | (at == 10)
        marks[begin] = True
        start = np.flatnonzero(marks)
        size = np.diff(start, append=len(at))
        one, two = self.hashes(at, start, size)
        slot = (one >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        offset, count = self.offset[slot].astype(np.int64), self.count[slot].astype(np.int64)
        missing = np.flatnonzero((self.one[slot] != one) | (self.two[slot] != two))
        if len(missing):
            _, first, where = np.unique(one[missing], return_index=True, return_inverse=True)
            new = missing[first]
            parts = [joined[a:b].decode("utf-8") for a, b in zip(start[new].tolist(), (start[new] + size[new]).tolist(), strict=True)]
            o, c = self.learn(parts)
            offset[missing], count[missing] = o[where], c[where]
            self.one[slot[new]], self.two[slot[new]], self.offset[slot[new]], self.count[slot[new]] = one[new], two[new], o, c
        ends = np.cumsum(count)
        raw = self.pool[np.arange(ends[-1]) - np.repeat(ends - count - offset, count)].tobytes()
        stop = ends[np.append(np.searchsorted(start, begin[1:]), len(start)) - 1].tolist()
        return [raw[2 * a : 2 * b] for a, b in zip([0, *stop], stop, strict=False)]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out = [b""] * len(texts)
        regular = self.regular(texts) if texts else []
        odd = [k for k, r in enumerate(regular) if not r and texts[k]]
        even = [k for k, r in enumerate(regular) if r and texts[k]]
        for at, ids in ((odd, self.whole([texts[k] for k in odd])), (even, self.cut([texts[k].encode("utf-8") for k in even]) if even else [])):
            for k, x in zip(at, ids, strict=True):
                out[k] = x
        return out


def encoder(path: str) -> Encoder:
    return held_by_worker(("encoder", path), lambda: Encoder(path))


def clean(text: str | None) -> str:
    """Lone surrogates, which no store of UTF-8 holds, would stop the library."""
    return (text or "").encode("utf-8", "replace").decode("utf-8")


def tokenised(docs: DataFrame, path: str, partitions: int) -> DataFrame:
    """doc_id, part, at, ids (u16, end id included) of every row, in range partitions by doc_id, ascending.

    at: tokens of the partition's documents before it.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [x + b"\0\0" for x in encoder(path).batch([clean(t) for t in column(batch, "text")])]
            ends = at + np.cumsum([len(x) // 2 for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array([at, *ends[:-1]], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "at", "ids"])
            at = int(ends[-1])

    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, F.col("doc_id"))
    return laid.sortWithinPartitions("doc_id", "text").mapInArrow(run, "doc_id long, part int, at long, ids binary")


# -- the coder ------------------------------------------------------------------------------------


def token_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; as many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(column(batch, "ids")), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


class Table:
    """Frequencies of at least 1 for every id that occurs, adding up to 2 ** BITS."""

    def __init__(self, frequencies: dict[int, int]) -> None:
        if frequencies and sum(frequencies.values()) != 1 << BITS:
            raise ValueError("frequencies do not add up")
        self.freq = np.zeros(1 << 16, np.uint64)
        self.freq[list(frequencies)] = list(frequencies.values())
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(1 << 16, dtype=np.uint16), self.freq.astype(np.int64))

    @staticmethod
    def of(counts: dict[int, int]) -> Table:
        ids = np.array(sorted(counts), np.int64)
        if not len(ids):
            return Table({})
        n = np.array([counts[i] for i in ids], np.float64)
        room = (1 << BITS) - len(ids)
        share = np.floor(n / n.sum() * room).astype(np.int64)
        share[np.argmax(n)] += room - share.sum()
        return Table(dict(zip(ids.tolist(), (share + 1).tolist(), strict=True)))

    def rows(self, spark: SparkSession) -> DataFrame:
        """id, frequency of the ids that occur."""
        ids = np.flatnonzero(self.freq)
        return spark.createDataFrame(list(zip(ids.tolist(), self.freq[ids].astype(np.int64).tolist(), strict=True)), "id int, frequency int")


def coded(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """States and u32 words of one block; token k is coded by lane k % LANES, last rows first."""
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    rows = -(-len(ids) // LANES)
    for r in range(rows - 1, -1, -1):
        now = ids[r * LANES : (r + 1) * LANES]
        x, f = state[: len(now)], table.freq[now]
        # One step of 32 bits is enough, as a word holds more than BITS bits.
        over = x >= (f << np.uint64(63 - BITS))
        if over.any():
            words.append(x[over].astype(np.uint32))
            x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(now)] = (q << np.uint64(BITS)) + (x - q * f) + table.start[now]
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decoded(n: int, state: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    out = np.empty(n, np.uint16)
    state, at, mask = state.copy(), 0, np.uint64((1 << BITS) - 1)
    for r in range(-(-n // LANES)):
        x = state[: min(LANES, n - r * LANES)]
        slot = x & mask
        sym = table.symbol[slot]
        out[r * LANES : r * LANES + len(x)] = sym
        x = table.freq[sym] * (x >> np.uint64(BITS)) + slot - table.start[sym]
        under = np.flatnonzero(x < LOW)
        if len(under):
            x[under] = (x[under] << np.uint64(32)) | words[at : at + len(under)]
            at += len(under)
        state[: len(x)] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block does not end where its coder began")
    return out


def frame(docs: list[tuple[int | None, bytes]], first: int, table: Table) -> bytes:
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u2")
    blocks = [(len(part := ids[k : k + BLOCK]), *coded(part, table)) for k in range(0, len(ids), BLOCK)]
    out = [MAGIC, struct.pack("<IQII", len(docs), first, table.crc, len(blocks))]
    out += [struct.pack("<qBI", d or 0, d is None, len(x) // 2) for d, x in docs]
    out += [struct.pack("<III", n, len(w), zlib.crc32(w.astype("<u4").tobytes())) + s.astype("<u8").tobytes() for n, s, w in blocks]
    out += [w.astype("<u4").tobytes() for _, _, w in blocks]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Heads:
    """The place of a frame's first token in its partition; id (or None) and tokens of its documents; of its blocks, the
    tokens, words, checksums, states, and where their words begin."""

    first: int
    docs: list[tuple[int | None, int]]
    blocks: list[tuple[int, int, int, np.ndarray, int]]


def heads(raw: bytes, table: Table) -> Heads:
    """What stands before the words of a frame."""
    if raw[:4] != MAGIC or len(raw) < 28:
        raise ValueError("not a frame")
    n_docs, first, crc, n_blocks = struct.unpack_from("<IQII", raw, 4)
    if crc != table.crc:
        raise ValueError("the frame was coded with another table")
    at, each = 24 + 13 * n_docs, 12 + 8 * LANES
    begin = at + each * n_blocks
    if len(raw) < begin + 4:
        raise ValueError("not a whole frame")
    docs = [(None if null else d, n) for d, null, n in struct.iter_unpack("<qBI", raw[24:at])]
    blocks = []
    for _ in range(n_blocks):
        n, words, check = struct.unpack_from("<III", raw, at)
        blocks.append((n, words, check, np.frombuffer(raw, "<u8", LANES, at + 12), begin))
        at, begin = at + each, begin + 4 * words
    if len(raw) != begin + 4:
        raise ValueError("not a whole frame")
    return Heads(first, docs, blocks)


def block(raw: bytes, k: int, table: Table, of: Heads | None = None) -> np.ndarray:
    """The ids of block k, from its checkpoint and words alone."""
    n, words, check, state, at = (of or heads(raw, table)).blocks[k]
    if zlib.crc32(raw[at : at + 4 * words]) != check:
        raise ValueError("a block's checksum differs")
    return decoded(n, state.astype(np.uint64), np.frombuffer(raw, "<u4", words, at), table)


def stretch(raw: bytes, low: int, high: int, table: Table) -> np.ndarray:
    """Ids low to high of a frame, decoding only the blocks that hold them."""
    of = heads(raw, table)
    out, at = [np.zeros(0, np.uint16)], 0
    for k, (n, *_) in enumerate(of.blocks):
        if at < high and at + n > low:
            out.append(block(raw, k, table, of)[max(low - at, 0) : high - at])
        at += n
    return np.concatenate(out)


def unframed(raw: bytes, table: Table) -> tuple[int, list[tuple[int | None, np.ndarray]]]:
    """The place of the frame's first token in its partition, and its documents."""
    of = heads(raw, table)
    if struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise ValueError("the frame's checksum differs")
    ids = np.concatenate([np.zeros(0, np.uint16), *(block(raw, k, table, of) for k in range(len(of.blocks)))])
    cut = np.cumsum([0, *(n for _, n in of.docs)])
    return of.first, [(d, ids[a:b]) for (d, _), a, b in zip(of.docs, cut, cut[1:], strict=False)]


def frames(tokens: DataFrame, table: Table) -> DataFrame:
    """part, first_token, n_tokens, frame_bytes: the file format, a row for each frame.

    A frame ends where its size is reached or the next row does not continue it, so that tokens may be
    read from files that were split or put together in any way.
    """
    table = tokens.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        part, begun, size = None, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([begun], pa.int64()), pa.array([size], pa.int64()), pa.array([frame(held, begun, table.value)], pa.binary())], names=["part", "first_token", "n_tokens", "frame_bytes"])

        for batch in slices(batches):
            for d, p, at, x in zip(*(column(batch, c) for c in ("doc_id", "part", "at", "ids")), strict=True):
                if held and (p != part or at != begun + size or size >= FRAME):
                    yield out()
                    held = []
                if not held:
                    part, begun, size = p, at, 0
                held.append((d, x))
                size += len(x) // 2
        if held:
            yield out()

    return tokens.mapInArrow(run, "part int, first_token long, n_tokens long, frame_bytes binary")


def encode(docs: DataFrame, path: str, partitions: int, folder: str | None = None) -> str:
    """The folder with the coded frames of all documents and their shared table; in the shared folder unless one is named."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    tokens = written(tokenised(docs, path, partitions), "tokens")
    table = Table.of(token_counts(tokens))
    table.rows(docs.sparkSession).coalesce(1).write.parquet(f"{folder}/frequencies")
    frames(tokens, table).write.parquet(f"{folder}/frames")
    return folder


def opened(spark: SparkSession, folder: str) -> tuple[DataFrame, Table]:
    """The frames of a folder and the table that its files hold, of as many rows as the vocabulary has at most."""
    ship(spark)
    rows = spark.read.schema("id int, frequency int").parquet(f"{folder}/frequencies").collect()
    return spark.read.schema("part int, first_token long, n_tokens long, frame_bytes binary").parquet(f"{folder}/frames"), Table({r["id"]: r["frequency"] for r in rows})


def _read(coded_frames: DataFrame, table: Table, names: dict[str, pa.DataType], of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """doc_id, part, at and what `of` makes of the ids of every document of the frames."""
    held = coded_frames.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            part = column(batch, "part")[0]
            first, docs = unframed(column(batch, "frame_bytes")[0], held.value)
            at = first + np.cumsum([0, *(len(x) for _, x in docs)])[:-1]
            made = list(zip(*(of(x) for _, x in docs), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([part] * len(docs), pa.int32()), pa.array(at, pa.int64()), *(pa.array(v, t) for v, t in zip(made, names.values(), strict=True))], names=["doc_id", "part", "at", *names])

    spark_types = {pa.int64(): "long", pa.binary(): "binary"}
    return coded_frames.select("part", "frame_bytes").mapInArrow(run, "doc_id long, part int, at long, " + ", ".join(f"{n} {spark_types[t]}" for n, t in names.items()))


def decode(coded_frames: DataFrame, table: Table) -> DataFrame:
    """doc_id, part, at (place in the partition), ids (u16) of every document, read from the frames."""
    return _read(coded_frames, table, {"ids": pa.binary()}, lambda x: (x.astype("<u2").tobytes(),))


def digests(coded_frames: DataFrame, table: Table) -> DataFrame:
    """doc_id, part, at, n_tokens, ids_crc32 (of the ids as little-endian u32), read from the frames."""
    return _read(coded_frames, table, {"n_tokens": pa.int64(), "ids_crc32": pa.int64()}, lambda x: (len(x), zlib.crc32(x.astype("<u4").tobytes())))


def part_starts(coded_frames: DataFrame) -> DataFrame:
    """part, start: ids of all partitions before it; a row for each range partition."""
    totals = {r["part"]: r["n"] for r in coded_frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    rows, run = [], 0
    for part in sorted(totals):
        rows.append((part, run))
        run += totals[part]
    return coded_frames.sparkSession.createDataFrame(rows, "part int, start long")
