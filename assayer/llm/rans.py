"""Token ids as binary files: a static range asymmetric numeral system over independent interleaved blocks.

Texts are put in order first and tokenized block by block; the pass that makes the ids adds up how often each occurs, so
the shared table costs no pass of its own. A folder holds two Parquet tables that carry the binary format, so Spark's
committers make the writes atomic: ``table`` (one row: the shared frequency table) and ``blocks`` (one row a block, in
ascending doc_id order by ``part, block``). A block decodes on its own: up to LANES interleaved states, the renormalisation words of all lanes in
the order a decoder reads them, checkpoints (states and word position every CHECK steps) from which decoding can start
inside a block, a CRC-32 of the coded bytes and one of the ids.

Defined results: null text is empty and has the end id alone; null doc_ids come first; equal doc_ids stay beside each
other in an order fixed by their texts; an empty table writes an empty ``blocks`` table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.text import chunks, emit
from assayer.llm.tokens import encoder
from assayer.plans.store import Scratch

END_ID = 0
SCALE = 18  # frequencies add up to 2**SCALE
LANES = 4096
CHECK = 32  # steps between checkpoints
BLOCK_IDS = 262_144
#: before: ids of the part ahead of the block. ends: where each document ends in the block.
BLOCKS = "part int, block int, before long, n_ids long, docs array<long>, ends array<long>, coded binary"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MAGIC = b"RANS"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, checkpoints, words, CRC of the coded bytes, CRC of the ids


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**SCALE, at least 1 where a count is; all zero for no counts."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not total:
        return out
    some = np.flatnonzero(counts)
    room = (1 << SCALE) - len(some)
    if room < 0:
        raise ValueError("more kinds of ids than slots")
    share = counts[some].astype(np.float64) * (room / total)
    out[some] = 1 + np.floor(share).astype(np.int64)
    rest = (1 << SCALE) - int(out.sum())
    order = np.lexsort((some, np.floor(share) - share))  # largest remainder first
    out[some[order[:rest]]] += 1
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        n, lanes = len(ids), min(LANES, len(ids))
        steps = -(-n // lanes) if n else 0
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
        marks = []
        for s in range(steps - 1, -1, -1):
            some = ids[s * lanes : (s + 1) * lanes]
            x, f = state[: len(some)], self.freq[some]
            over = x >= (f << np.uint64(63 - SCALE))
            words[s] = x[over].astype(np.uint32)
            x = np.where(over, x >> _WORD, x)
            whole = x // f
            state[: len(some)] = (whole << np.uint64(SCALE)) + (x - whole * f) + self.start[some]
            if s % CHECK == 0:
                marks.append((s, state.copy()))
        before = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        body = b"".join(struct.pack("<II", s, before[s]) + x.astype("<u8").tobytes() for s, x in reversed(marks))
        stream = np.concatenate(words).astype("<u4") if words else np.empty(0, "<u4")
        body += stream.tobytes()
        return _HEAD.pack(_MAGIC, n, lanes, len(marks), len(stream), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body

    def decode(self, block: bytes | pa.Buffer, first_mark: int = 0, marks: int | None = None) -> np.ndarray:
        """The ids of a block, or of ``marks`` checkpoints' stretches from ``first_mark`` on."""
        magic, n, lanes, held, n_words, crc, ids_crc = _HEAD.unpack_from(block)
        body = memoryview(block)[_HEAD.size :]
        if magic != _MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        if not n:
            return np.empty(0, np.uint32)
        wide, steps = 8 + 8 * lanes, -(-n // lanes)
        _, at = struct.unpack_from("<II", body, first_mark * wide)
        state = np.frombuffer(body, "<u8", lanes, first_mark * wide + 8).astype(np.uint64)
        stream = np.frombuffer(body, "<u4", n_words, held * wide)
        last = steps if marks is None else min(steps, (first_mark + marks) * CHECK)
        out = []
        for s in range(first_mark * CHECK, last):
            k = min(lanes, n - s * lanes)
            x = state[:k]
            slot = x & np.uint64((1 << SCALE) - 1)
            ids = self.slots[slot]
            x = self.freq[ids] * (x >> np.uint64(SCALE)) + slot - self.start[ids]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << _WORD) | stream[at : at + len(low)]
            at += len(low)
            state[:k] = x
            out.append(ids)
        ids = np.concatenate(out)
        if marks is None and first_mark == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("ids differ from those written")
        return ids


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_TOKENS = "part int, block int, before long, n_ids long, docs array<long>, ends array<long>, ids binary, kinds array<int>, times array<long>"
_TOKENS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("ids", pa.binary()), ("kinds", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


def tokenized(documents: DataFrame, tokenizer: str, vocabulary: int, end_id: int = END_ID) -> DataFrame:
    """Blocks of whole documents in ascending doc_id order, and a row a task (no block) with how often it met each id.

    ids are little-endian unsigned 16-bit integers where the vocabulary allows it, so that half as much is moved.
    """
    kind = _id_type(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, total = np.array([end_id], kind).tobytes(), np.zeros(vocabulary, np.int64)
        part, block, before, docs, held, n = None, 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            total[:] += np.bincount(ids, minlength=vocabulary)
            ends = np.cumsum([len(x) // ids.itemsize for x in held])
            return emit([(part, block, before, n, docs, ends.tolist(), ids.tobytes(), None, None)], _TOKENS_ARROW)

        for some in chunks(batches, 2):
            for (part, doc_id, _), ids in zip(some, encoder(tokenizer, code=kind).encode([r[2] for r in some]), strict=True):
                docs.append(doc_id)
                held.append(ids + end)
                n += len(held[-1]) // len(end)
                if n >= BLOCK_IDS:
                    yield out()
                    block, before, docs, held, n = block + 1, before + n, [], [], 0
        if docs:
            yield out()
        met = np.flatnonzero(total)
        yield emit([(part, None, None, None, None, None, None, met.tolist(), total[met].tolist())], _TOKENS_ARROW)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(cut, _TOKENS)


def _counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; what reaches the driver is bounded by the vocabulary."""
    pairs = tokens.where("block is null").select(F.explode(F.arrays_zip("kinds", "times")).alias("x"))
    out = np.zeros(vocabulary, np.int64)
    for r in pairs.groupBy(F.col("x.kinds").alias("id")).agg(F.sum("x.times").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write(documents: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    """Writes ``table`` and ``blocks`` below ``folder``."""
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = _id_type(vocabulary)
    scratch = Scratch(spark, "rans")
    tokens = scratch.keep(tokenized(documents, tokenizer, vocabulary, end_id), "tokens", codec="lz4")
    freq = scaled(_counts(tokens, vocabulary))
    spark.createDataFrame([(SCALE, freq.astype("<u4").tobytes())], "scale int, frequencies binary").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                coded = coder.encode(np.frombuffer(one.column("ids")[0].as_buffer(), kind))
                kept = [c for c in one.schema.names if c != "ids"]
                yield pa.RecordBatch.from_arrays([*map(one.column, kept), pa.array([coded], pa.binary())], names=[*kept, "coded"])

    blocks = tokens.where("block is not null").select("part", "block", "before", "n_ids", "docs", "ends", "ids").mapInArrow(code, BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    scratch.drop("tokens")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian unsigned 32 bits) from the files."""
    freq = np.frombuffer(bytes(spark.read.parquet(f"{folder}/table").first()["frequencies"]), "<u4")
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    located = blocks.join(F.broadcast(parts), "part")  # one row a written partition, however much it holds

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at in range(len(batch)):
                base, docs, ends, coded = (batch.column(c)[at] for c in ("base", "docs", "ends", "coded"))
                ids = coder.decode(coded.as_buffer()).astype("<u4").tobytes()
                stops = ends.values.to_numpy()
                starts = np.concatenate(([0], stops[:-1]))
                some = [ids[4 * s : 4 * e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
                out = [docs.values, pa.array(base.as_py() + starts), pa.array(stops - starts), pa.array([zlib.crc32(x) for x in some], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, *[pa.array(some, pa.binary())] * with_ids], names=[*names, *["ids"] * with_ids])

    named = located.select((F.col("base") + F.col("before")).alias("base"), "docs", "ends", "coded")
    return named.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
