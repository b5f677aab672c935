"""Near-duplicate documents: MinHash signatures, banding, signature and full-set verification, star components.

Plan. One pass over the texts writes, per row, a digest of its word sequence, the number of distinct shingles, a bit
sketch of the signature and the band hashes. Rows of one word sequence collapse to their least doc_id. A bucket (one
band's equal hashes) of n sequences yields n - 1 links to its least member, never all pairs; links that the sizes and the
sketch allow are confirmed on the full sets. After star components, buckets whose members still lie in several components
are searched for links across them in blocks (see ``_across``), so no link between different texts is lost, no pair
leaves a task unless it is a link, and a bucket of copies costs nothing more. Rows and bands follow from the threshold: a pair at it shares no bucket with
a probability of at most MISS.

Defined results: null or wordless texts have 0 shingles and are linked with nothing; fewer words than a shingle takes make
one shingle; repeated rows of one doc_id get equal results; a null doc_id is linked with nothing, has a null component
and is kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.llm.text import WordHash, chunks, emit, mix, rows, space_words
from assayer.plans.store import Scratch

WORDS, PERCENT = 5, 80
MISS = 1e-7
SKETCH = 192  # minima that give one bit each
#: Rows of a bucket, and texts of a family, that one task holds at a time.
BUCKET_BLOCK, FAMILY_BLOCK = 512, 1000
_SIGNED = "doc_id long, n long, key binary, s0 long, s1 long, s2 long, bands array<long>"
_HASHES = WordHash()


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands: (1 - t**rows)**bands <= MISS, with about two hundred minima."""
    rows_ = 6 if percent >= 85 else 5 if percent >= 75 else 4
    return rows_, max(math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows_))), -(-SKETCH // rows_))


def most_bits(percent: int) -> int:
    """Sketch bits in which a pair at the threshold differs at most, 6.5 standard deviations out."""
    q = (1 - percent / 100) / 2
    return math.ceil(SKETCH * q + 6.5 * math.sqrt(SKETCH * q * (1 - q)))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one."""
    if not words:
        return np.empty(0, np.uint64)
    h = _HASHES.of(words)
    k = min(n, len(words))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(x)


class Signer:
    """Minima of the universal family h(x) = (a x + b mod 2**64) / 2**32 over 32 bits of each shingle's hash."""

    def __init__(self, percent: int):
        self.rows, self.bands = banding(percent)
        rng = np.random.default_rng(20240229)
        k = self.rows * self.bands
        self.a = rng.integers(0, 1 << 64, k, np.uint64)[:, None]
        self.b = rng.integers(0, 1 << 64, k, np.uint64)[:, None]

    def minima(self, x: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        x32 = x >> np.uint64(32)
        for at in range(0, len(x32), 512):
            h = self.a * x32[None, at : at + 512]
            h += self.b
            np.minimum(low, h.min(axis=1), out=low)
        return low >> np.uint64(32)  # the least of the shifted values is the least one shifted

    def sign(self, x: np.ndarray) -> tuple[list[int], list[int]]:
        low = self.minima(x)
        bits = np.packbits((mix(low[:SKETCH]) & np.uint64(1)).astype(np.uint8)).view("<i8")
        h = np.arange(self.bands, dtype=np.uint64)
        for column in low.reshape(self.bands, self.rows).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return bits.tolist(), h.view(np.int64).tolist()


def signed(documents: DataFrame, n_words: int, percent: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), *[(f"s{i}", pa.int64()) for i in range(3)], ("bands", pa.list_(pa.int64()))])
        signer = Signer(percent)
        for part in chunks(batches, 1):
            out = []
            for doc_id, text in part:
                x = shingles(words := space_words(text), n_words)
                if not len(x):
                    out.append((doc_id, 0, b"", 0, 0, 0, []))
                    continue
                bits, bands = signer.sign(x)
                out.append((doc_id, len(x), hashlib.blake2b(b" ".join(words), digest_size=16).digest(), *bits, bands))
            yield emit(out, schema)
        _HASHES.clear()  # the worker lives on, and may serve other operators

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(sign, _SIGNED)


def _alike(percent: int, a: str, b: str):
    """Sizes and sketches that a pair of that similarity can have."""
    differ = F.lit(0)
    for i in range(3):
        differ = differ + F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (differ <= most_bits(percent))


def confirmed(pairs: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Of pairs (src, dst) those whose full sets are that similar."""
    left = texts.select(F.col("id").alias("src"), F.col("text").alias("a"))
    right = texts.select(F.col("id").alias("dst"), F.col("text").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        last_text, last = None, None
        for part in chunks(batches, 3):
            out = []
            for src, dst, a, b in part:
                if a != last_text:
                    last_text, last = a, shingles(space_words(a), n_words)
                other = shingles(space_words(b), n_words)
                both = len(np.intersect1d(last, other, assume_unique=True))
                if 100 * both >= percent * (len(last) + len(other) - both):
                    out.append((src, dst))
            yield emit(out, schema)

    found = pairs.select("src", "dst").join(right, "dst").join(left, "src").select("src", "dst", "a", "b")
    return found.mapInArrow(compare, "src long, dst long")


def near_duplicates(documents: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents``."""
    scratch = Scratch(documents.sparkSession, "minhash")
    rows_ = scratch.keep(signed(documents, n_words, percent), "signed")
    some = rows_.where("n > 0 and doc_id is not null")
    # Rows of one word sequence: the least doc_id stands for all.
    firsts = scratch.keep(some.groupBy("key").agg(F.min("doc_id").alias("first")), "firsts")
    standing = some.join(firsts.select(F.col("key").alias("k"), "first"), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("first")), "left_semi")
    nodes = standing.select(F.explode("bands").alias("bucket"), F.struct(F.col("doc_id").alias("id"), "n", "s0", "s1", "s2").alias("m"))
    nodes = scratch.keep(nodes, "nodes")
    buckets = nodes.groupBy("bucket").agg(F.min("m").alias("pivot"), F.count("*").alias("many")).where("many > 1").drop("many")
    buckets = scratch.keep(buckets, "buckets")
    members = scratch.keep(nodes.join(buckets, "bucket"), "members")
    scratch.drop("nodes")

    # A pivot and its members.
    star = members.where(F.col("m.id") != F.col("pivot.id")).where(_alike(percent, "m", "pivot"))
    star = scratch.keep(star.select(F.col("pivot.id").alias("src"), F.col("m.id").alias("dst")).distinct(), "star")
    texts = _texts(documents, members.select(F.col("m.id").alias("id")).distinct(), scratch)
    edges = scratch.keep(confirmed(star, texts, n_words, percent), "edges")
    found = components(edges, scratch, "first")

    labels = scratch.keep(found.select(F.col("node").alias("id"), "component"), "labels")
    more = scratch.keep(_across(members, labels, texts, n_words, percent, scratch), "more")
    found = labels.withColumnRenamed("id", "node")
    if not more.isEmpty():  # the components found so far are stars already
        joined = components(labels.select(F.col("id").alias("src"), F.col("component").alias("dst")).union(more), scratch, "second")
        found = scratch.keep(joined, "components")

    out = rows_.select("doc_id", "n", "key").join(firsts, "key", "left").join(found.withColumnRenamed("node", "first"), "first", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "first"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(members: DataFrame, labels: DataFrame, texts: DataFrame, n_words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (src, dst) between members of one bucket that lie in different components; none is missed.

    The pivot has met every member already, so a bucket matters if its other members lie in two components or more; then
    those outside of its largest component are the queries, so members of one component never meet each other for being many.
    Sketches are compared in blocks inside tasks; what comes out is not the pairs but the families they make up. In
    a family, the texts outside its largest component are the queries: each meets blocks of the family's sets through an
    inverted index, and one link per component found comes out.
    """
    others = members.where(F.col("m.id") != F.col("pivot.id")).select("bucket", "m.*").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    others = scratch.keep(others, "others")
    sizes = others.groupBy("bucket", "component").agg(F.count("*").alias("many"))
    largest = F.max_by("component", F.struct("many", "component")).alias("home")
    open_ = sizes.groupBy("bucket").agg(largest, F.sum("many").alias("all"), F.max("many").alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = lambda n: F.ceil(n / BUCKET_BLOCK).cast("int")
    open_ = scratch.keep(open_.select("bucket", "home", blocks(F.col("all")).alias("held_blocks"), blocks(F.col("all") - F.col("most")).alias("query_blocks")), "open")
    joined = others.join(open_, "bucket")
    row = ["id", "component", "n", "s0", "s1", "s2"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    held = joined.select("bucket", own("held_blocks").alias("held"), each("query_blocks").alias("asked"), F.lit(0).alias("query"), *row)
    asked = joined.where(F.col("component") != F.col("home"))
    asked = asked.select("bucket", each("held_blocks").alias("held"), own("query_blocks").alias("asked"), F.lit(1).alias("query"), *row)
    dealt = held.union(asked).repartition("bucket", "held", "asked").sortWithinPartitions("bucket", "held", "asked", "query", "id")
    differ = most_bits(percent)

    def kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            if out := _kin(list(group), percent, differ):
                yield emit(out, schema)

    kinship = scratch.keep(dealt.mapInArrow(kin, "src long, dst long").distinct(), "kinship")
    families = scratch.keep(components(kinship, scratch, "kin"), "families").select(F.col("node").alias("id"), F.col("component").alias("family"))
    placed = families.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("family", "component").agg(F.count("*").alias("many"))
    largest = sizes.groupBy("family").agg(F.max_by("component", F.struct("many", "component")).alias("home"), F.ceil(F.sum("many") / FAMILY_BLOCK).cast("int").alias("blocks"))
    placed = placed.join(scratch.keep(largest, "largest"), "family").join(texts, "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = placed.select("family", block.alias("block"), F.lit(0).alias("query"), "id", "component", "text")
    asked = placed.where(F.col("component") != F.col("home"))
    asked = asked.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "id", "component", "text")
    met = held.union(asked).repartition("family", "block").sortWithinPartitions("family", "block", "query", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        for _, group in groupby(rows(batches), key=lambda r: r[:2]):
            index, sets = None, []
            for _, _, query, id_, component, text in group:
                x = shingles(space_words(text), n_words)
                if not query:
                    sets.append((id_, component, x))
                    continue
                if sets and index is None:
                    index = _Index(sets)
                if index is not None and (out := index.links(id_, component, x, percent)):
                    yield emit(out, schema)

    return met.mapInArrow(meet, "src long, dst long")


def _kin(group: list[tuple], percent: int, differ: int) -> list[tuple[int, int]]:
    """(member, family) of the rows of one block pair that resemble one of another component, by size and sketch."""
    ids, comps, n = (np.array([r[i] for r in group], np.int64) for i in (4, 5, 6))
    sketch = np.array([r[7:10] for r in group], np.int64).view(np.uint64)
    query = np.array([r[3] for r in group]) == 1
    left, right = np.flatnonzero(query), np.flatnonzero(~query)
    family = np.arange(len(group))
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        bits = np.bitwise_count(sketch[a][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32)
        sizes = 100 * np.minimum(n[a][:, None], n[right][None, :]) >= percent * np.maximum(n[a][:, None], n[right][None, :])
        hit = (bits <= differ) & sizes & (comps[a][:, None] != comps[right][None, :])
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            met = np.unique(family[np.append(right[hit[i]], a[i])])
            if len(met) > 1:
                family[np.isin(family, met)] = met[0]
    least = np.full(len(group), np.iinfo(np.int64).max)
    np.minimum.at(least, family, ids)
    several = np.bincount(family, minlength=len(group))[family] > 1
    return list(zip(ids[several].tolist(), least[family[several]].tolist(), strict=True))


class _Index:
    """Inverted index over the shingle sets of a block."""

    def __init__(self, sets: list[tuple[int, int, np.ndarray]]):
        self.ids, self.components = (np.array([s[i] for s in sets], np.int64) for i in (0, 1))
        self.sizes = np.array([len(s[2]) for s in sets])
        every, owner = np.concatenate([s[2] for s in sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]

    def links(self, id_: int, component: int, x: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """One link to every other component that holds a set similar to x."""
        first, last = np.searchsorted(self.every, x, "left"), np.searchsorted(self.every, x, "right")
        many = last - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        both = np.bincount(self.owner[at], minlength=len(self.ids))
        hit = np.flatnonzero((100 * both >= percent * (len(x) + self.sizes - both)) & (self.components != component))
        _, one = np.unique(self.components[hit], return_index=True)
        return [(id_, int(self.ids[i])) for i in hit[one]]


def _texts(documents: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """id, text of the documents that any bucket holds with others."""
    wanted = scratch.keep(ids, "wanted")
    source = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return scratch.keep(source.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "texts")


def first_of_each(documents: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, that stay: one (the least doc_id) of every group of near duplicates."""
    gone = near_duplicates(documents, n_words, percent).where("not kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in documents.columns))
