"""Benchmark decontamination: normalised word windows of the benchmark against all training tokens.

The windows (13 words; a shorter item is one window) form a hash set that is broadcast while the benchmark's texts hold at
most MOST_BYTES: the set keeps the items' words once, as numbers, and 16 bytes a window, so a worker holds a small
multiple of that bound. For a larger benchmark the same windows meet through a shuffle. Either way a hash hit is verified
on the words themselves, and the result is the same.

Defined results: null or empty text has no words, no hits and is clean; benchmark rows with a null item_id or no
words are ignored; repeated item ids count as one item with all their windows; repeated documents get equal rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.text import alnum_words, beside, carried, emit, parts, rows
from assayer.plans.store import Scratch

N = 13
#: Bytes of benchmark texts up to which the windows are broadcast.
MOST_BYTES = 16 << 20
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WindowSet:
    """The benchmark's windows: a bit table by length ahead of sorted hashes, and the items' words to verify a hit on."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.code: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        texts, at = [], 0
        for item, text in items:
            words = alnum_words(text)
            codes = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words], np.int32)
            if k := min(n, len(codes)):
                keys = self._keys(codes, k)
                held.setdefault(k, []).append((keys, at + np.arange(len(keys)), np.full(len(keys), number[item])))
            texts.append(codes)
            at += len(codes)
        self.words = np.concatenate(texts) if texts else np.empty(0, np.int32)
        self.by_length = {}
        for k, some in held.items():
            keys, places, of = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(keys, kind="stable")
            shift = np.uint64(64 - max(12, min(24, (64 * len(keys)).bit_length())))
            bits = np.zeros(1 << (64 - int(shift)), bool)
            bits[(keys >> shift).astype(np.int64)] = True
            self.by_length[k] = keys[order], places[order].astype(np.int32), of[order].astype(np.int32), bits, shift

    @staticmethod
    def _keys(codes: np.ndarray, n: int) -> np.ndarray:
        h, codes = np.zeros(len(codes) - n + 1, np.uint64), codes.astype(np.uint64)
        for j in range(n):
            h = (h + codes[j : len(codes) - n + 1 + j]) * _STEP
        return h

    def find(self, words: list[bytes]) -> tuple[int, list[str], list[tuple[int, int]]]:
        """(words hit, items with a window there, spans hit)."""
        get = self.code.get
        codes = np.array([get(w, 0) for w in words], np.int32)
        edge, found = None, set()
        for n, (keys, places, of, bits, shift) in self.by_length.items():
            if len(words) < n:
                continue
            own = self._keys(codes, n)
            near = np.flatnonzero(bits[(own >> shift).astype(np.int64)])
            if not len(near):
                continue
            begin, end = np.searchsorted(keys, own[near], "left"), np.searchsorted(keys, own[near], "right")
            held = np.flatnonzero(begin < end)
            for p, first, last in zip(near[held].tolist(), begin[held].tolist(), end[held].tolist(), strict=True):
                at = places[first:last]
                same = (self.words[at[:, None] + np.arange(n)] == codes[p : p + n]).all(axis=1)
                if same.any():
                    if edge is None:
                        edge = np.zeros(len(words) + 1, np.int32)
                    edge[p] += 1
                    edge[p + n] -= 1
                    found.update(of[first:last][same].tolist())
        if edge is None:
            return 0, [], []
        n_hit, spans = _covered(edge)
        return n_hit, [self.items[i] for i in sorted(found)], spans


def _covered(edge: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    inside = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype(np.int8)
    turns = np.diff(inside)
    return int(inside.sum()), list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True))


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item, window): the distinct windows of every item, as arrays of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.string()), ("window", pa.list_(pa.binary()))])
        for item, text in rows(batches):
            words = alnum_words(text)
            k = min(n, len(words))
            if item is not None and k:
                yield emit([(item, list(w)) for w in {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}], schema)

    source = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, "item string, window array<binary>")


def scan(documents: DataFrame, benchmark: DataFrame, n: int = N, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``doc_id, text`` with n_words, n_hit, items and the word spans hit."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return _scanned(docs, 1, benchmark, n, most_bytes)


def _scanned(docs: DataFrame, text_at: int, benchmark: DataFrame, n: int, most_bytes: int) -> DataFrame:
    """Adds n_words, n_hit, items and spans to rows whose text is column ``text_at``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text <> ''")
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0) > most_bytes:
        return _scan_by_shuffle(docs, text_at, Scratch(docs.sparkSession, "decontaminate").keep(item_windows(benchmark, n), "windows"))
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])  # ``most_bytes`` of text

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(held.value, n)
        for part in parts(batches, text_at):
            out = []
            for text in part.column(text_at):
                words = alnum_words(text.as_py())
                n_hit, found, spans = known.find(words)
                out.append((len(words), n_hit, found, [{"start": a, "end": b} for a, b in spans]))
            yield beside(part, emit(out, pa.schema(_FOUND)))

    return docs.mapInArrow(look, _with_found(docs))


def _with_found(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, *T.StructType.fromDDL(FOUND).fields])


def _scan_by_shuffle(docs: DataFrame, text_at: int, windows: DataFrame) -> DataFrame:
    """For a benchmark too large to broadcast: windows of distinct texts and of items meet by digest, and bring their words along."""
    lengths = sorted(r[0] for r in windows.select(F.size("window")).distinct().collect())  # at most n of them
    grams = windows.select(F.to_binary(F.expr("md5(cast(array_join(transform(window, w -> hex(w)), ' ') as binary))"), F.lit("hex")).alias("key"), "item", "window").distinct()
    text = F.coalesce(F.col(docs.columns[text_at]).cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), F.sha2(text, 256).alias("sha")).dropDuplicates(["sha"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sha", pa.string()), ("at", pa.int32()), ("n", pa.int32()), ("key", pa.binary())])
        for text, sha in rows(batches):
            words = [w.hex().upper().encode() for w in alnum_words(text)]
            for n in lengths:
                for base in range(0, len(words) - n + 1, 20_000):
                    some = range(base, min(base + 20_000, len(words) - n + 1))
                    yield emit([(sha, i, n, hashlib.md5(b" ".join(words[i : i + n])).digest()) for i in some], schema)

    hits = texts.mapInArrow(cut, "sha string, at int, n int, key binary").join(grams, "key")
    hits = hits.groupBy("sha").agg(F.collect_set(F.struct("at", "window", "item")).alias("_hits"))
    joined = docs.withColumn("_sha", F.sha2(text, 256)).join(hits, F.col("_sha") == F.col("sha"), "left").drop("sha", "_sha")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text_at):
            out = []
            for text, found in zip(part.column(text_at), part.column("_hits"), strict=True):
                words, items = alnum_words(text.as_py()), set()
                edge = np.zeros(len(words) + 1, np.int32)
                for h in found.as_py() or ():
                    at, window = h["at"], h["window"]
                    if words[at : at + len(window)] == window:
                        edge[at] += 1
                        edge[at + len(window)] -= 1
                        items.add(h["item"])
                n_hit, spans = _covered(edge)
                out.append((len(words), n_hit, sorted(items), [{"start": a, "end": b} for a, b in spans]))
            kept = pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])
            yield beside(kept, emit(out, pa.schema(_FOUND)))

    return joined.mapInArrow(add_up, _with_found(docs))


def verdicts(found: DataFrame) -> DataFrame:
    """One row per document: counts, the items' digest and the contamination rule (a twentieth of the words)."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose verdict is clean."""
    coded, text_at, back = carried(documents)
    found = _scanned(coded, text_at, benchmark, N, MOST_BYTES)
    return found.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))).select(back)


def remove_spans(found: DataFrame) -> DataFrame:
    """doc_id and the normalised words left once every hit span is cut out, joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            left = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = alnum_words(text)
                for s in reversed(spans):
                    del words[s["start"] : s["end"]]
                left.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(left, pa.string())], names=["doc_id", "text"])

    return found.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, text string")
