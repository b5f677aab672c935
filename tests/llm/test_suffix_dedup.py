import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from assayer.llm import suffix_dedup
from assayer.llm import bwt
from assayer.llm.queries import op4_suffix_array_dedup
from tests.llm.cases import ODD, PROSE, documents


def brute(docs, length):
    starts = Counter()
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raws:
        for i in range(len(b) - length + 1):
            starts[b[i : i + length]] += 1
    out = []
    for d, b in raws:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        hit = np.cumsum(edge[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((d, len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(op4_suffix_array_dedup(spark, sf)) == brute(docs, 400)


def planted(seed, n):
    """Texts with shared passages around the threshold, periodic stretches, near copies and exact ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(120)[:size] for size in (399, 400, 401, 430, 700, 64, 65)]
    docs = []
    for i in range(n):
        text = prose(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages) + prose(rng.randint(0, 30))
        if i % 11 == 0:
            text += rng.choice(["ab", "a", "xyz "]) * rng.randint(150, 420)
        if docs and i % 5 == 0:
            other = list(docs[rng.randrange(len(docs))][1])
            for _ in range(rng.randint(0, 2)):
                if other:
                    other[rng.randrange(len(other))] = "#"
            text = "".join(other)
        docs.append((i, text))
    return docs


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3, 0])
def test_planted_passages(spark, group):
    docs = planted(group, 120)
    assert rows(suffix_dedup.dedup(documents(spark, docs), group=group)) == brute(docs, 400)


def test_odd_rows(spark):
    assert rows(suffix_dedup.dedup(documents(spark, ODD))) == brute(ODD, 400)
    assert rows(suffix_dedup.dedup(documents(spark, []))) == []
    twice = [(1, PROSE * 5), (1, PROSE * 5), (2, "ü" + PROSE * 4), (3, "ö" + PROSE * 4)]
    assert rows(suffix_dedup.dedup(documents(spark, twice))) == brute(twice, 400)
    docs = documents(spark, twice)
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == 4


def slices_of(seed, length=40):
    """Different slices, as one anchor would hold, with shared stretches around the length."""
    rng = np.random.default_rng(seed)
    parts = [bytes(rng.choice(list(b"abcd "), n).tolist()) for n in (38, 39, 40, 41, 60)]
    draw = lambda: bytes(rng.choice(list(b"abcdefgh "), rng.integers(0, 30)).tolist())
    out = {b"".join([draw(), parts[rng.integers(5)], draw(), parts[rng.integers(5)], draw()]) for _ in range(30)}
    return [(b, int(rng.integers(3))) for b in sorted(out) if len(b) >= length]


def by_count(slices, length):
    where = defaultdict(set)
    for i, (b, _) in enumerate(slices):
        for p in range(len(b) - length + 1):
            where[b[p : p + length]].add(i)
    return [[p for p in range(len(b) - length + 1) if len(where[b[p : p + length]]) > 1] for b, _ in slices]


def test_repeats_come_out_of_the_merge(monkeypatch):
    def found(slices):
        # A slice here may repeat a window inside itself, which slices of one anchor cannot: such windows are left out.
        inner = [Counter(b[p : p + 40] for p in range(len(b) - 39)) for b, _ in slices]
        got, want = suffix_dedup.repeated_windows(slices, 40), by_count(slices, 40)
        keep = lambda i, ps: [int(p) for p in ps if inner[i][slices[i][0][p : p + 40]] == 1]
        return [keep(i, g) for i, g in enumerate(got)], [keep(i, w) for i, w in enumerate(want)]

    cases = [slices_of(seed) for seed in range(25)]
    for slices in cases:
        got, want = found(slices)
        assert got == want
    real = bwt.merge
    for constant in (lambda n, depth: np.zeros(n, np.int32), lambda n, depth: np.full(n, depth, np.int32) * (np.arange(n) > 0)):

        def off(transforms, depth, constant=constant):
            interleave, common = real(transforms, depth)
            return interleave, constant(len(common), depth)

        monkeypatch.setattr(bwt, "merge", off)
        assert any(got != want for got, want in map(found, cases))


def test_intervals():
    common = np.array([0, 3, 1, 2, 2, 0])
    first, many = bwt.intervals(common, np.array([1, 3, 4, 5]), np.array([1, 2, 3, 1]))
    assert first.tolist() == [0, 2, 4, 5] and many.tolist() == [5, 3, 1, 1]


def common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_merged_transforms_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(40):
        kinds, shards, suffixes = rng.integers(2, 5), [], defaultdict(list)
        for s in range(rng.integers(1, 5)):
            sequences = [rng.integers(1, kinds + 1, rng.integers(0, 12)) for _ in range(rng.integers(1, 5))]
            shards.append((np.concatenate([np.append(q, 0) for q in sequences]), np.cumsum([len(q) + 1 for q in sequences]) - 1))
            suffixes[s] = [q[i:].tolist() for q in sequences for i in range(len(q) + 1)]
        every = [(s, p, x) for s, own in suffixes.items() for p, x in enumerate(own)]
        ranks, shared = bwt.ranked(shards, 6)
        best = np.maximum(shared, np.append(shared[1:], 0))
        got = [best[r] for r in ranks]
        for s, p, x in every:
            if x:
                assert got[s][p] == min(6, max((common(x, y) for t, q, y in every if (t, q) != (s, p)), default=0))
