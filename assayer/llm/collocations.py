"""Phrase collocation mining by marginalisation from the longest windows.

Each word leads one window of up to four words, padded at the end of its piece; only these windows are counted, in the task and then, packed,
by parts of their hash, so that ROLLUP takes each distinct window once. It sums them by successively shorter beginnings, and as every
occurrence of a phrase leads exactly one window, the sums are the counts of all phrases of four, three, two and one words, and of all words
of a language.

Before that, one pass counts words and pairs of neighbours by a hash, spread over buckets of the hash, and marks those that occur often
enough in a bitmap of fixed size; a second one does so with triples of marked pairs. A window ends before a pair or triple that is not
marked, and words that are not marked lead an empty window: a phrase can't be frequent where what it holds is not. Hashes or
bits that coincide only leave a window longer than it need be, so counts are exact at every size; once the bitmap is crowded it merely
saves less.

Rows: a null language is ``und``, a null or empty text has no words. Texts of any length, repeated rows and ids in any number are all counted;
columns other than ``text`` and ``lang`` are left alone. Phrases with equal score and count rank by their bytes, so ranks have no ties. An
empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.text import MOST, chunks, mix
from assayer.plans.store import Scratch

#: Words of a phrase at most.
LONGEST = 4
#: Words that a task holds at once, as numbers.
HELD = 2_000_000
#: Size of the bitmap of frequent hashes, as a power of two of bits: 16 MB, whatever the corpus.
BITS = 27
#: Ranges of the hash, as a power of two, one of which is counted at a time; raise it with the number of distinct pairs.
BUCKETS = 12
#: Hashes of a bucket that are held before equal ones are summed.
HELD_HASHES = 1_000_000
_BREAK = b"."
#: Lower-cases A-Z, makes each separator of pieces a full stop and a tab a space.
_READ = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    """Numbers of words; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, words as numbers, a break after each text, the words of the numbers), about ``HELD`` words or one text at a time."""
    words, held, n = _Words(), {}, 0

    def out() -> Iterator:
        names = list(words)
        for lang, found in held.items():
            yield lang, np.concatenate(found), names

    for rows in chunks(batches, 1):
        for lang, text in rows:
            if not text:
                continue
            data, at = text.encode().translate(_READ).replace(_BREAK, b" . ") + b" .", 0
            while at < len(data):
                end = data.find(b" ", at + MOST)
                tokens = data[at : end if end > 0 else len(data)].split()
                held.setdefault(lang, []).append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                n, at = n + len(tokens), at + len(data) if end < 0 else end
            if n >= HELD:
                yield from out()
                words, held, n = _Words(), {}, 0
    yield from out()


def _hashes(lang: str, ids: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Of every number that occurs the hash of its word in this language."""
    import xxhash

    seed, out = zlib.crc32(lang.encode()), np.zeros(len(names), np.uint64)
    for i in np.unique(ids).tolist():
        out[i] = xxhash.xxh3_64_intdigest(names[i], seed)
    return out


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second * np.uint64(0x9E3779B97F4A7C15))


def _leads(ids: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of at most ``HELD`` leading words, with the words behind them that their windows reach, padded with breaks."""
    ids = np.concatenate([ids, np.zeros(LONGEST - 1, np.int32)])
    for at in range(0, len(ids) - LONGEST + 1, HELD):
        n = min(HELD, len(ids) - LONGEST + 1 - at)
        yield ids[at : at + n + LONGEST - 1], n


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


_COUNTED = "bucket int, hashes binary, counts binary"


def _often(marked, hashes: np.ndarray) -> np.ndarray:
    """``marked``: the broadcast bitmap."""
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (marked.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _words_of(marked, of: np.ndarray) -> np.ndarray:
    """Which numbers are words to look at: with a bitmap the marked ones, without all but the break."""
    words = np.ones(len(of), bool) if marked is None else _often(marked, of)
    words[0] = False
    return words


def _runs(marked, of: np.ndarray, words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word but the last: whether it and the next are neighbours of ``words``, a marked pair if there is a bitmap, and the pair's hash.

    A pair's bit may be set by another's, so the words are asked for as well: only marked words have a place in a window.
    """
    pair = words[part[:-1]] & words[part[1:]]
    hashes = np.zeros(len(pair), np.uint64)
    hashes[pair] = _paired(of[part[:-1][pair]], of[part[1:][pair]])
    if marked is not None:
        pair[pair] = _often(marked, hashes[pair])
    return pair, pair[:-1] & pair[1:], hashes


def _triples(of: np.ndarray, part: np.ndarray, both: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Hashes of three words in a row, where ``both`` of their pairs hold."""
    return _paired(pairs[:-1][both], ~of[part[2:][both]])


def _counter(marked):
    """Without a bitmap words and pairs of neighbours are counted by hash, with it the triples made of marked pairs; a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names in _streams(batches):
            of = _hashes(lang, ids, names)
            words = _words_of(marked, of)
            for part, n in _leads(ids):
                reached = part[: n + (1 if marked is None else 2)]
                pair, both, pairs = _runs(marked, of, words, reached)
                if marked is None:
                    single = np.bincount(part[:n], minlength=len(names))
                    single[0] = 0
                    there = np.flatnonzero(single)
                    found, many = np.unique(pairs[pair], return_counts=True)
                    hashes, counts = _summed([of[there], found], [single[there], many])
                else:
                    hashes, counts = np.unique(_triples(of, reached, both, pairs), return_counts=True)
                # a bucket's hashes differ by the 32 bits behind its own; ones that don't only mark too much
                rest = (hashes >> np.uint64(32 - BUCKETS)).astype(np.uint32)
                bounds = np.searchsorted(hashes, np.arange(1 << BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS)).tolist() + [len(hashes)]
                filled = [b for b in range(1 << BUCKETS) if bounds[b] < bounds[b + 1]]
                cut = lambda x: pa.array([x[bounds[b] : bounds[b + 1]].tobytes() for b in filled], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), cut(rest), cut(counts.astype(np.int64))], names=["bucket", "hashes", "counts"])

    return count


def _bits_of(least: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bitmap's slice of each bucket; a task's rows are in order of buckets, and one bucket is held at a time."""
        now, hashes, counts, held = -1, [], [], 0

        def close() -> list[tuple[int, bytes]]:
            if now < 0:
                return []
            found, many = _summed(hashes, counts)
            bits = np.zeros(1 << (BITS - BUCKETS), np.uint8)
            bits[found[many >= least] >> np.uint32(32 - (BITS - BUCKETS))] = 1
            return [(now, zlib.compress(np.packbits(bits).tobytes(), 1))]

        def emit(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "bits"])

        for batch in batches:
            rows = []
            for i in range(len(batch)):
                bucket, h, c = (column[i].as_py() for column in batch.columns)
                if bucket != now:
                    rows += close()
                    now, hashes, counts, held = bucket, [], [], 0
                hashes.append(np.frombuffer(h, np.uint32))
                counts.append(np.frombuffer(c, np.int64))
                held += len(hashes[-1])
                if held > HELD_HASHES:
                    found, many = _summed(hashes, counts)
                    hashes, counts, held = [found], [many], 0
            yield emit(rows)
        yield emit(close())

    return mark


def frequent_bits(texts: DataFrame, least: int, marked=None) -> np.ndarray:
    """A bitmap of ``2 ** BITS`` bits, in bytes, with those set whose words or pairs occur ``least`` times, beside those of ``marked``
    the triples of marked pairs. It comes to the driver, whose size it has at any number of words."""
    counted = texts.mapInArrow(_counter(marked), _COUNTED).repartition("bucket").sortWithinPartitions("bucket")
    bits = np.zeros(1 << (BITS - 3), np.uint8) if marked is None else marked.value.copy()
    size = len(bits) >> BUCKETS
    for bucket, found in counted.mapInArrow(_bits_of(least), "bucket int, bits binary").collect():
        bits[bucket * size : (bucket + 1) * size] |= np.frombuffer(zlib.decompress(found), np.uint8)
    return bits


#: Parts that windows are dealt to by hash, one of which is held by a task at a time; raise it with the number of distinct windows.
PARTS = 1024
_DEALT = "part int, lang string, lines binary, counts binary"
_WINDOWS = "lang string, " + "".join(f"w{k} string, " for k in range(1, LONGEST + 1)) + "c long"


def _windows_of(marked):
    """Windows counted in the task, sorted and packed: a row a part, with a line a window and its words between spaces."""

    def unique(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct rows of columns of small numbers, and how many there are of each."""
        place, firsts = np.zeros(len(columns[0]), np.int64), None
        for c in columns:
            _, first, place = np.unique(place * (int(c.max(initial=0)) + 1) + c, return_index=True, return_inverse=True)
            firsts = first
        return [c[firsts] for c in columns], np.bincount(place, minlength=len(firsts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names in _streams(batches):
            of = _hashes(lang, ids, names)
            often = _words_of(marked, of)
            kept = np.flatnonzero(often)
            short = np.zeros(len(names), np.int64)
            short[kept] = np.arange(1, len(kept) + 1)
            hashed = np.concatenate([np.zeros(1, np.uint64), of[kept]])
            spelled = ["", *(names[i].decode() for i in kept.tolist())]
            for part, n in _leads(ids):
                pair, both, pairs = _runs(marked, of, often, part)
                both[both] = _often(marked, _triples(of, part, both, pairs))
                leads = short[part]
                reach = [part[:n] > 0, pair[:n], both[:n], both[:n] & both[1 : n + 1]]
                longer = reach[1]
                single = np.bincount(leads[:n][reach[0] & ~longer], minlength=len(kept) + 1)
                there = np.flatnonzero(single)
                windows, many = unique(*(np.where(reach[k][longer], leads[k : k + n][longer], 0) for k in range(LONGEST)))
                columns = [np.concatenate([there, windows[0]]), *(np.concatenate([np.zeros(len(there), np.int64), w]) for w in windows[1:])]
                c, part_of = np.concatenate([single[there], many]), np.zeros(len(columns[0]), np.uint64)
                for w in columns:
                    part_of = _paired(part_of, hashed[w])
                part_of = (part_of % np.uint64(PARTS)).astype(np.int64)
                order = np.lexsort((*columns[::-1], part_of))
                words = zip(*(w[order].tolist() for w in columns), strict=True)
                lines = [" ".join([spelled[i] for i in window if i]) for window in words]
                bounds = np.searchsorted(part_of[order], np.arange(PARTS + 1)).tolist()
                filled, c = [p for p in range(PARTS) if bounds[p] < bounds[p + 1]], c[order].astype(np.int64)
                text = [zlib.compress("\n".join(lines[bounds[p] : bounds[p + 1]]).encode(), 1) for p in filled]
                counts = [zlib.compress(c[bounds[p] : bounds[p + 1]].tobytes(), 1) for p in filled]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([lang] * len(filled), pa.string()), pa.array(text, pa.binary()), pa.array(counts, pa.binary())], names=["part", "lang", "lines", "counts"])

    return count


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct window once, with its count over all tasks; rows come by part and language."""
    now, held = None, {}

    def close() -> Iterator[pa.RecordBatch]:
        found = list(held.items())
        for at in range(0, len(found), 50_000):
            lines, counts = zip(*found[at : at + 50_000], strict=True)
            words = [(line.split(" ") if line else []) + [None] * LONGEST for line in lines]
            columns = [pa.array([w[k] for w in words], pa.string()) for k in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([pa.array([now[1]] * len(lines), pa.string()), *columns, pa.array(counts, pa.int64())], names=["lang", *(f"w{k}" for k in range(1, LONGEST + 1)), "c"])

    for batch in batches:
        for i in range(len(batch)):
            part, lang, text, counts = (column[i].as_py() for column in batch.columns)
            if (part, lang) != now:
                yield from close()
                now, held = (part, lang), {}
            for line, c in zip(zlib.decompress(text).decode().split("\n"), np.frombuffer(zlib.decompress(counts), np.int64).tolist(), strict=True):
                held[line] = held.get(line, 0) + c
    yield from close()


def phrases(documents: DataFrame, least: int = 30) -> DataFrame:
    """(lang, words, phrase, f): phrases of one to four words that occur ``least`` times in a language; with no words, all its words."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    pairs = spark.sparkContext.broadcast(frequent_bits(texts, least))
    marked = spark.sparkContext.broadcast(frequent_bits(texts, least, pairs))
    names = [f"w{k}" for k in range(1, LONGEST + 1)]
    dealt = texts.mapInArrow(_windows_of(marked), _DEALT).repartition("part").sortWithinPartitions("part", "lang")
    sums = dealt.mapInArrow(_merged, _WINDOWS).rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("rolled"))
    # of a row with the last n columns rolled up, the column before them must hold a word; padding there repeats a shorter phrase
    last = F.coalesce(*(F.when(F.col("rolled") == (1 << (LONGEST - k)) - 1, F.col(f"w{k}").isNotNull()) for k in range(1, LONGEST + 1)))
    whole = F.col("rolled") == (1 << LONGEST) - 1
    kept = sums.where(whole | (last & (F.col("f") >= least)))
    words = F.when(whole, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*names)))
    kept = kept.select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "f")
    return Scratch(spark, "phrases").keep(kept, "counted")


#: Decimals, as the product may pass 64 bits.
SCORE = "cast(cast(a AS decimal(20, 0)) * cast(2000000 AS decimal(7, 0)) div (cast(l AS decimal(20, 0)) + r) AS bigint)"


def collocations(documents: DataFrame, least: int = 30, absorbed: int = 80, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of two to four words by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase cut in two has the score ``2000000 * a / (l + r)``, rounded down; of equal cuts the first counts. A phrase inside a longer
    candidate that has ``absorbed`` percent of its count or more is dropped.
    """
    counted = phrases(documents, least)
    known = counted.where(F.size("words") > 0)
    candidates = known.where(F.size("words") > 1)
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("_right"))
    side = lambda key, n: known.select("lang", F.col("phrase").alias(key), F.col("f").alias(n))
    cuts = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"])
    weakest = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "a", "l", "r"))
    scored = cuts.groupBy("lang", "phrase").agg(weakest.alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.score")

    longer = candidates.where(F.size("words") > 2)
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: part(i, n))))
    inside = longer.select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * absorbed, F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language's phrases, then of these
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = left.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counted.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
