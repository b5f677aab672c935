"""Best-fit packing by exact-complement hashing.

Only the number of pieces of each length decides the packing, and there are at most ``capacity`` lengths, so the plan
is made on the driver from that histogram; it does not grow with the corpus. ``Sums`` indexes the sums of one, two and
three lengths: by a sum it finds the combinations that make it. The gap that the longest open length leaves is looked up
there, the combination goes out as often as the counts of its members allow, and what no exact combination takes is placed
best-fit. The plan is a table of allotments (length, first rank, count, sequence base, offset), and pieces find
their places by a join on (length, block).

Defined results: null text is empty and still has the end id; equal documents are packed each for itself; null
doc_ids rank first among pieces of one length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.text import chunks, emit
from assayer.llm.tokens import encoder, release
from assayer.plans.store import Scratch

CAPACITY = 4096
END_ID = 1
#: Rows of one length that one task ranks.
RANK_BLOCK = 512


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian unsigned 32 bits)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for part in chunks(batches, 1):
            out = []
            for (doc_id, _), ids in zip(part, encoder(tokenizer).encode([t or "" for _, t in part]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    some = ids[at : at + step]
                    out.append((doc_id, k, at // 4, len(some) // 4, zlib.crc32(some), *[some] * with_ids))
            yield emit(out, schema)
        release()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Sums:
    """By a sum, the combinations of one, two and three of the lengths that make it; built once, asked under the counts of the day."""

    def __init__(self, lengths: list[int], capacity: int):
        single = np.zeros(capacity + 1, bool)
        single[lengths] = True
        self.single = single
        #: pair[s]: the larger members of pairs of sum s; triple[s]: the largest members of triples of sum s.
        self.pair = [self._larger(single, single, s, 2) for s in range(capacity + 1)]
        paired = np.array([len(p) > 0 for p in self.pair])
        self.triple = [self._larger(single, paired, s, 3) for s in range(capacity + 1)]

    @staticmethod
    def _larger(first: np.ndarray, rest: np.ndarray, total: int, members: int) -> np.ndarray:
        a = np.arange(-(-total // members), total)
        return a[first[a] & rest[total - a]]

    def pairs(self, total: int, have: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        """Pairs of that sum whose members are there and not over ``most``, the most plentiful first: fewer steps, and scarce lengths stay."""
        a = self.pair[total]
        a = a[a <= most]
        times = np.minimum(have[a], have[total - a])
        a = a[np.argsort(-times, kind="stable")[: np.count_nonzero(times)]]
        yield from zip(a.tolist(), (total - a).tolist(), strict=True)

    def triples(self, total: int, have: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for a in self.triple[total][::-1].tolist():
            if have[a]:
                for b, c in self.pairs(total - a, have, a):
                    yield a, b, c


class Plan:
    """Allotments for a histogram of lengths: every length's pieces, in runs of equal sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used = capacity, dict(counts), defaultdict(int)
        self.have = np.zeros(capacity + 1, np.int64)
        self.have[list(counts)] = list(counts.values())
        self.sequences, self.runs = 0, []
        self.exact(), self.best_fit()

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        """``times`` sequences that each hold these lengths in this order."""
        at = 0
        for n in lengths:
            self.runs.append((n, self.used[n], times, self.sequences, at))
            self.used[n] += times
            self.left[n] -= times
            self.have[n] -= times
            at += n
            if not self.left[n]:
                del self.left[n]
        self.sequences += times

    def most(self, lengths: tuple[int, ...]) -> int:
        return min((self.left.get(n, 0) // lengths.count(n) for n in set(lengths)), default=0)

    def exact(self) -> None:
        """Longest first: the gap a length leaves is looked up among single, pair and triple sums."""
        while self.left.get(self.capacity):
            self.take((self.capacity,), self.left[self.capacity])
        sums = Sums(list(self.left), self.capacity)
        for longest in sorted(self.left, reverse=True):
            while self.left.get(longest) and (found := self.complement(sums, longest)):
                self.take(found, self.most(found))

    def complement(self, sums: Sums, longest: int) -> tuple[int, ...] | None:
        gap = self.capacity - longest
        one = [(gap,)] if sums.single[gap] else []
        for rest in chain(one, sums.pairs(gap, self.have, gap), sums.triples(gap, self.have)):
            if self.most((longest, *rest)):
                return longest, *rest
        return None

    def best_fit(self) -> None:
        """The rest, longest first, each into the open sequence with the smallest gap that takes it; equal sequences move as one."""
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
        gaps: list[int] = []
        for n in sorted(self.left, reverse=True):
            rest = self.left[n]
            while rest:
                at = bisect_left(gaps, n)
                if at < len(gaps):
                    gap = gaps[at]
                    first, many = open_[gap].pop()
                    if not open_[gap]:
                        gaps.pop(at)
                    times = min(rest, many)
                    if many > times:
                        self._open(open_, gaps, gap, first + times, many - times)
                    fits = min(gap // n, rest // times)
                    for j in range(fits):
                        self.runs.append((n, self.used[n], times, first, self.capacity - gap + j * n))
                        self.used[n] += times
                    rest -= times * fits
                    self._open(open_, gaps, gap - fits * n, first, times)
                else:
                    each = min(self.capacity // n, rest)
                    times = rest // each
                    for j in range(each):
                        self.runs.append((n, self.used[n], times, self.sequences, j * n))
                        self.used[n] += times
                    self._open(open_, gaps, self.capacity - each * n, self.sequences, times)
                    self.sequences += times
                    rest -= each * times
            del self.left[n]

    @staticmethod
    def _open(open_: dict, gaps: list[int], gap: int, first: int, many: int) -> None:
        if gap:
            if not open_[gap]:
                insort(gaps, gap)
            open_[gap].append((first, many))


def assign(cut: DataFrame, capacity: int = CAPACITY, block: int = RANK_BLOCK) -> DataFrame:
    """Adds sequence_id and offset to written pieces."""
    spark: SparkSession = cut.sparkSession
    counts = cut.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # one row per length, ``capacity`` at most
    plan = Plan(histogram, capacity)
    parts = spark.createDataFrame([(n, -(-k // block)) for n, k in histogram.items()], "length long, parts long")
    salted = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), "parts")).drop("parts")
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within")).drop("base", "within", "part")

    # A run covers the ranks [first, first + times) of its length. Cut at multiples of ``width`` it is found by equality
    # on (length, rank / width) and a comparison; the runs of one length are disjoint.
    runs = spark.createDataFrame(plan.runs or [], "run_length long, first long, times long, sequence long, at long")
    width = 16_384
    runs = runs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("times") - 1) / width))))
    held = (F.col("length") == F.col("run_length")) & (F.floor(F.col("rank") / width) == F.col("cell")) & F.col("rank").between(F.col("first"), F.col("first") + F.col("times") - 1)
    sequence = (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id")
    return ranked.join(runs, held).select(*cut.columns, sequence, F.col("at").alias("offset"))


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    written = Scratch(documents.sparkSession, "packing").keep(pieces(documents, tokenizer, capacity, end_id, with_ids), "pieces")
    return assign(written, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens: the packed ids of each sequence in order; a group holds ``capacity`` ids at most."""
    together = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return together.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("tokens"))
