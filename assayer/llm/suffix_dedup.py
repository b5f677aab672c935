"""Removal of long repeats: every byte that a ``length``-byte string covers which also starts anywhere else.

Every window of ``length`` bytes has one anchor, the KGRAM bytes in it with the least hash (the last of equal ones);
equal windows have equal anchors at the same place, so windows meet by anchor hash, and an anchor that occurs once clears
all its windows without their bytes being moved. An anchor's windows of one text are one slice; equal slices count as one
that occurs so often. Different slices of one anchor go through the suffix structure: they are parsed into
content-cut phrases, each shard's Burrows-Wheeler transform is built, the shards are merged by interleave refinement, and
from the common prefixes of the merge come the repeated intervals. Two windows are equal if their whole phrases are one
interval and the bytes ahead of and behind them, less than a phrase each, agree.

A group of more than GROUP different slices is split: its windows are dealt by where the anchor stands in them (WIDTH
places together) and by the bytes that all windows of such places hold, and what is still larger by the window itself.
Each step only puts windows apart that differ.

Defined results: null text is empty; texts shorter than ``length`` keep all; a repeated row is a repeat of the other;
rows of equal text get equal results whatever their doc_id; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.bwt import intervals, ranked
from assayer.llm.text import carried, chunks, emit, mix, parts, rows
from assayer.plans.store import Scratch

LENGTH = 400
KGRAM = 64
SHARDS = 4
#: Different slices that meet in one merge at most, and places of the anchor that stay together when a group is split.
GROUP, WIDTH = 500, 43
#: Bytes of slices, of whole groups, that go through one merge.
CHUNK = 1 << 20
_STRETCH = 1 << 20
_PLACE = np.uint64(21)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_INVERSE = pow(_B1, -1, 1 << 64), pow(_B2, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse, self.up, self.down = base, inverse, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        while len(self.up) <= len(data):
            n = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, n, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, n, 1 << 64))))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Hash of every n-byte window; equal windows have equal hashes wherever they stand."""
        return (sums[n:] - sums[:-n]) * self.down[: len(sums) - n]


_FIRST, _SECOND = Powers(_B1, _INVERSE[0]), Powers(_B2, _INVERSE[1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from block prefixes and suffixes."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash, anchor, first window, last window) of every run of windows with one anchor."""
    for base in range(0, len(data) - length + 1, _STRETCH):
        part = data[base : base + _STRETCH + length - 1]
        grams = mix(_FIRST.windows(_FIRST.sums(part), KGRAM))
        places = np.uint64((1 << 21) - 1) - np.arange(len(grams), dtype=np.uint64)
        least = _least((grams >> _PLACE << _PLACE) | places, length - KGRAM + 1)
        at = ((1 << 21) - 1) - (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        turns = np.flatnonzero(np.diff(at)) + 1
        starts = np.concatenate(([0], turns))
        ends = np.concatenate((turns, [len(at)])) - 1
        for h, a, p, q in zip(grams[at[starts]].view(np.int64).tolist(), at[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
            yield h, base + a, base + p, base + q


def text_key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def _texts(documents: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(_key(text).alias("key"), text.alias("text"), *more)


_OCCURRENCE = "key binary, h long, d long, a int, p int, q int"


def occurrences(documents: DataFrame, length: int) -> DataFrame:
    """One row a run: text key, anchor hash, digest of the slice and its place in the run, anchor, first and last window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("h", pa.int64()), ("d", pa.int64()), ("a", pa.int32()), ("p", pa.int32()), ("q", pa.int32())])
        for part in chunks(batches, 0):
            out = []
            for (text,) in part:
                if len(raw := text.encode()) < length:
                    continue
                key = text_key(raw)
                for h, a, p, q in anchors(np.frombuffer(raw, np.uint8), length):
                    d = hashlib.blake2b(raw[p : q + length], digest_size=8, salt=(a - p).to_bytes(8, "little")).digest()
                    out.append((key, h, int.from_bytes(d, "little", signed=True), a, p, q))
            yield emit(out, schema)

    return _texts(documents).select("text").mapInArrow(cut, _OCCURRENCE)


def _phrases(data: np.ndarray) -> np.ndarray:
    """Places where a phrase begins: after four bytes whose hash says so, so equal bytes are cut alike."""
    if len(data) < 4:
        return np.empty(0, np.int64)
    x = data.astype(np.uint32)
    h = ((x[:-3] * np.uint32(257) + x[1:-2]) * np.uint32(65539) + x[2:-1]) * np.uint32(31) + x[3:]
    return np.flatnonzero((h * np.uint32(2654435769)) >> np.uint32(28) == 0) + 4


def repeated_windows(slices: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each (bytes, shard): which of its windows also stand in another slice (slices are all different)."""
    data = [np.frombuffer(b, np.uint8) for b, _ in slices]
    cuts = [_phrases(x) for x in data]
    one, two = [_FIRST.sums(x) for x in data], [_SECOND.sums(x) for x in data]
    # Phrase names: 64-bit hashes of the stretches between cuts, numbered over the chunk.
    names = []
    for x, c, sums in zip(data, cuts, one, strict=True):
        edges = np.concatenate((c, [len(x)]))
        size = np.diff(edges).astype(np.uint64)
        names.append(mix((sums[edges[1:]] - sums[edges[:-1]]) * _FIRST.down[edges[:-1]] + size) if len(c) else np.empty(0, np.uint64))
    counts = [len(c) for c in cuts]
    _, numbered = np.unique(np.concatenate(names), return_inverse=True)
    per_slice = np.split(numbered + 1, np.cumsum(counts)[:-1])
    shards, members = [], []
    for s in sorted({s for _, s in slices}):
        own = [i for i, (_, t) in enumerate(slices) if t == s]
        members.append(own)
        symbols = np.concatenate([np.concatenate((per_slice[i], [0])) for i in own])
        shards.append((symbols, np.cumsum([counts[i] + 1 for i in own]) - 1))
    depth = 1 + max(int((np.searchsorted(c, c + length) - np.arange(len(c))).max()) if len(c) else 0 for c in cuts)
    ranks, common = ranked(shards, depth)
    row: list[np.ndarray] = [np.empty(0)] * len(slices)
    for own, found in zip(members, ranks, strict=True):
        at = 0
        for i in own:
            row[i] = found[at : at + counts[i]]
            at += counts[i] + 1

    # Of each window: the cut that its whole phrases begin at, how many there are, and the bytes on both sides.
    spots, begin, whole, heads, tails, heads2, tails2, sizes = [], [], [], [], [], [], [], []
    for i, x in enumerate(data):
        c, p = np.append(cuts[i], len(x)), np.arange(len(x) - length + 1)
        first = np.searchsorted(cuts[i], p + 4)
        k = np.searchsorted(cuts[i], p + length, side="right") - 1 - first
        none = k <= 0  # no whole phrase inside: all of the window is its head
        k = np.where(none, 0, k)
        near, far = np.where(none, p + length, c[first]), np.where(none, p + length, c[first + k])
        spots.append(p)
        begin.append(np.where(none, -1, np.append(row[i], 0)[np.minimum(first, counts[i])]))
        whole.append(k)
        sizes.append(near - p)
        for sums, powers, ahead, behind in ((one[i], _FIRST, heads, tails), (two[i], _SECOND, heads2, tails2)):
            ahead.append((sums[near] - sums[p]) * powers.down[p])
            behind.append((sums[p + length] - sums[far]) * powers.down[far])
    begin, whole, sizes = np.concatenate(begin), np.concatenate(whole), np.concatenate(sizes)
    phrased = np.flatnonzero(whole)
    pairs, back = np.unique(begin[phrased] * (depth + 1) + whole[phrased], return_inverse=True)
    group, many = np.full(len(begin), -1, np.int64), np.full(len(begin), 2, np.int64)
    start, held = intervals(common, pairs // (depth + 1), pairs % (depth + 1))
    group[phrased], many[phrased] = (start * (depth + 1) + pairs % (depth + 1))[back], held[back]

    # Windows of an interval that no other suffix shares are out; the others meet by interval and sides.
    able = np.flatnonzero(many > 1)
    told = lambda h, t: mix(mix(np.concatenate(h)[able]) * np.uint64(_B1) + np.concatenate(t)[able])
    inner = mix((group[able] * 4096 + sizes[able]).astype(np.uint64))
    key, check = mix(told(heads, tails) + inner), told(heads2, tails2) ^ inner
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    if (equal & (check[order[1:]] != check[order[:-1]])).any():  # sides of equal first and different second hashes
        order = np.lexsort((check, key))
        equal = (key[order[1:]] == key[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    twice = np.zeros(len(begin), bool)
    twice[able[order[1:]]] |= equal
    twice[able[order[:-1]]] |= equal
    return [p[t] for p, t in zip(spots, np.split(twice, np.cumsum([len(p) for p in spots])[:-1]), strict=True)]


def _runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of the runs of consecutive ones."""
    if not len(places):
        return [], []
    turns = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate(([0], turns + 1))].tolist(), places[np.concatenate((turns, [len(places) - 1]))].tolist()


def _merged(slices: DataFrame, length: int) -> DataFrame:
    """(g, e, runs of repeated windows) for different slices (g, e, shard, bytes) of groups g, in chunks of whole groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.binary()), ("e", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])

        def done(part: list[tuple]) -> pa.RecordBatch:
            found = repeated_windows([(b, s) for _, _, s, b in part], length)
            return emit([(g, e, *_runs(p)) for (g, e, _, _), p in zip(part, found, strict=True) if len(p)], schema)

        part, held = [], 0
        for row in rows(batches):
            if held >= CHUNK and row[0] != part[-1][0]:
                yield done(part)
                part, held = [], 0
            part.append(row)
            held += len(row[3])
        if part:
            yield done(part)

    dealt = slices.repartition("g").sortWithinPartitions("g", "e").select("g", "e", "shard", "bytes")
    return dealt.mapInArrow(work, "g binary, e long, first array<int>, last array<int>")


_SLICE = "h long, d long, at int, off int, n int, shard int, g binary, e long, bytes binary"
_SLICE_ARROW = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("at", pa.int32()), ("off", pa.int32()), ("n", pa.int32()), ("shard", pa.int32()), ("g", pa.binary()), ("e", pa.int64()), ("bytes", pa.binary())])


def _split(slices: DataFrame, length: int, width: int) -> DataFrame:
    """Slices of windows of ``width`` neighbouring anchor places, grouped by these and by the bytes that all such windows hold.

    A slice (h, d, at: place of its anchor, off: its first window in the slice of (h, d)) becomes several; n: its windows.
    With a width of 1 a group is a window, and its bytes are not moved.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "bytes"):
            for h, d, at, off, shard, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                low, high, out = at - (len(raw) - length), at, []  # the anchor's places in the windows
                for b in range(low // width, high // width + 1):
                    near, far = b * width, min((b + 1) * width - 1, length - KGRAM)
                    first, last = at - min(far, high), at - max(near, low)
                    same = hashlib.blake2b(raw[at - near : at - far + length], digest_size=16, salt=h.to_bytes(8, "little", signed=True), person=b.to_bytes(2, "little")).digest()
                    own = raw[first : last + length]
                    e = hashlib.blake2b(own, digest_size=8, salt=(at - first).to_bytes(8, "little")).digest()
                    out.append((h, d, at - first, off + first, last - first + 1, shard, same, int.from_bytes(e, "little", signed=True), own if width > 1 else b""))
                yield emit(out, _SLICE_ARROW)

    return slices.select("h", "d", "at", "off", "shard", "bytes").mapInArrow(cut, _SLICE)


def _shifted(slices: DataFrame, whole: DataFrame, found: DataFrame) -> DataFrame:
    """(h, d, first, last) in places of the slice (h, d), of its parts that are whole repeats or hold found runs."""
    joined = slices.drop("bytes").join(whole.select("g", "e", F.lit(True).alias("whole")), ["g", "e"], "left").join(found, ["g", "e"], "left").where("whole or first is not null")
    move = lambda c: F.transform(c, lambda x: x + F.col("off"))
    all_of = lambda end: F.array(end)
    first = F.when(F.col("whole"), all_of(F.col("off"))).otherwise(move("first"))
    last = F.when(F.col("whole"), all_of(F.col("off") + F.col("n") - 1)).otherwise(move("last"))
    return joined.select("h", "d", first.alias("first"), last.alias("last"))


def _hot(slices: DataFrame, length: int, group: int, scratch: Scratch) -> DataFrame:
    """(h, d, runs of repeated windows) of groups with more than ``group`` different slices."""
    some = scratch.keep(_split(slices, length, WIDTH), "parts")
    kinds = scratch.keep(some.groupBy("g", "e").agg(F.count("*").alias("times")), "kinds")
    sizes = scratch.keep(kinds.groupBy("g").agg(F.count("*").alias("many")).where("many > 1"), "sizes")
    meet = some.join(sizes.where(F.col("many") <= group).select("g"), "g", "left_semi").dropDuplicates(["g", "e"])
    found = scratch.keep(_merged(meet, length), "found-parts")
    once = _shifted(some, kinds.where("times > 1"), found)
    single = scratch.keep(_split(some.join(sizes.where(F.col("many") > group).select("g"), "g", "left_semi"), length, 1), "windows")
    twice = scratch.keep(single.groupBy("g").agg(F.count("*").alias("times")).where("times > 1"), "twice")
    each = single.join(twice, "g").select("h", "d", F.array("off").alias("first"), F.array("off").alias("last"))
    # A slice holds at most as many windows as an anchor has places.
    return once.union(each).groupBy("h", "d").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))


def repeats(documents: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """key, spans: for every text with removed bytes, the windows' [first byte, end) stretches, not yet merged."""
    scratch = Scratch(documents.sparkSession, "suffix-dedup")
    runs = scratch.keep(occurrences(documents, length), "runs")
    several = runs.groupBy("h").agg(F.count("*").alias("n"), (F.min("d") != F.max("d")).alias("open")).where("n > 1").select("h", "open")
    several = scratch.keep(several, "several")
    # Dealt anew by the whole key: a common passage's anchor would else keep its rows in one task.
    held = runs.join(several, "h").repartition("key", "h", "d", "a").groupBy(*runs.columns, "open").agg(F.count("*").alias("times"))
    held = scratch.keep(held, "held")
    scratch.drop("runs")
    slices = held.groupBy("h", "d").agg(F.sum("times").alias("times"), F.min(F.struct("key", "a", "p", "q")).alias("at"), F.max("open").alias("open"))
    slices = scratch.keep(slices, "slices")
    open_ = slices.where("open").select("h", "d", "at.*")
    large = scratch.keep(open_.groupBy("h").agg(F.count("*").alias("many")).where(F.col("many") > group).select("h"), "large")

    wanted = open_.groupBy("key").agg(F.collect_list(F.struct("h", "d", "a", "p", "q")).alias("wanted"))
    texts = _texts(documents).dropDuplicates(["key"]).join(wanted, "key").select("key", "text", "wanted")

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            out = []
            for key, text, some in part:
                raw = text.encode()
                for w in some:
                    h, p, q = w["h"], w["p"], w["q"]
                    out.append((h, w["d"], w["a"] - p, 0, q - p + 1, key[0] % SHARDS, h.to_bytes(8, "little", signed=True), w["d"], raw[p : q + length]))
            yield emit(out, _SLICE_ARROW)

    bytes_ = scratch.keep(texts.mapInArrow(slice_up, _SLICE), "bytes")
    found = _merged(bytes_.join(large, "h", "left_anti"), length)
    found = found.join(bytes_.select("g", "e", "h", "d"), ["g", "e"]).select("h", "d", "first", "last")
    if not large.isEmpty():
        found = found.union(_hot(bytes_.join(large, "h", "left_semi"), length, group, scratch))
    found = scratch.keep(found, "found")
    scratch.drop("bytes")

    whole = slices.where("times > 1").select("h", "d", F.lit(True).alias("whole"))
    verdict = scratch.keep(slices.select("h", "d").join(whole, ["h", "d"], "left").join(found, ["h", "d"], "left").where("whole or first is not null"), "verdict")
    marked = held.select("key", "h", "d", "p", "q").join(verdict, ["h", "d"])
    stretch = lambda f, e: F.struct(f.alias("start"), (e + length).alias("end"))
    own = F.arrays_zip(F.transform("first", lambda x: x + F.col("p")).alias("f"), F.transform("last", lambda x: x + F.col("p")).alias("l"))
    spots = F.when(F.col("whole"), F.array(stretch(F.col("p"), F.col("q")))).otherwise(F.transform(own, lambda x: stretch(x["f"], x["l"])))
    spans = marked.select("key", spots.alias("spots")).groupBy("key").agg(F.flatten(F.collect_list("spots")).alias("spans"))
    return scratch.keep(spans, "spans")


def _cover(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _left(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """(the bytes outside of the spans, how many stretches went)."""
    held, at, left = _cover(spans), 0, []
    for s, e in held:
        left.append(text[at:s])
        at = e
    return b"".join([*left, text[at:]]), len(held)


def _with_spans(docs: DataFrame, text: str, documents: DataFrame, length: int, group: int) -> DataFrame:
    """Adds ``spans``, null where nothing goes, as the last column."""
    found = repeats(documents, length, group).withColumnRenamed("key", "_key")
    key = _key(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.withColumn("_own", key).join(found, F.col("_own") == F.col("_key"), "left").select(*docs.columns, "spans")


def dedup(documents: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the remaining bytes)."""
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = _with_spans(docs, "text", documents, length, group)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for part in parts(batches, 1):
            out = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                kept, n = _left(raw := text.encode(), spans)
                out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            done = emit(out, new)
            yield pa.RecordBatch.from_arrays([part.column(0), *done.columns], names=["doc_id", *new.names])

    schema = T.StructType([joined.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    return joined.mapInArrow(cut, schema)


def without_repeats(documents: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The documents with their repeats cut out of ``text`` and ``n_chars`` (if there) counted anew where something went.

    A cut may fall inside a character; the bytes left of it are dropped, so that the text stays valid.
    """
    coded, text_at, back = carried(documents)
    joined = _with_spans(coded, coded.columns[text_at], documents, length, group)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text_at):
            *columns, spans = part.columns
            gone = [bool(s) for s in spans.to_pylist()]
            if any(gone):
                texts = zip(columns[text_at].to_pylist(), spans.to_pylist(), strict=True)
                columns[text_at] = pa.array([_left(t.encode(), s)[0].decode(errors="ignore") if s else t for t, s in texts], columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone)], names=[*part.schema.names[:-1], "gone"])

    out = joined.mapInArrow(cut, T.StructType([*coded.schema.fields, T.StructField("gone", T.BooleanType())]))
    if "n_chars" in documents.columns:
        at = documents.columns.index("n_chars")
        counted = F.when(F.col("gone"), F.length(coded.columns[text_at])).otherwise(F.col(coded.columns[at]))
        back[at] = counted.cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return out.select(back)
