import random
import re

import pytest

from assayer.llm import minhash
from assayer.llm.components import components
from assayer.llm.queries import op3_minhash_near_dedup
from assayer.plans.store import Scratch
from tests.llm.cases import ODD, PROSE, documents


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def brute(docs, n, percent):
    """docs: distinct ids. All pairs, exactly."""
    docs = sorted(docs)
    sets = [shingles(t, n) for _, t in docs]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links.append((i, j))
    root = roots(len(docs), links)
    return [(d, len(s), docs[r][0], docs[r][0] == d) for (d, _), s, r in zip(docs, sets, root, strict=True)]


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_minhash_near_dedup(spark, sf).collect())) == brute(docs, 3, 85)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_group_of_near_copies_and_chains(spark, n, percent):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(120)]
    docs, now = [], base
    for i in range(160):  # copies with a few words changed, and a chain that drifts away step by step
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(120)] = word()
        now = list(now)
        now[rng.randrange(120)] = word()
        docs += [(3 * i, " ".join(text)), (3 * i + 1, " ".join(now)), (3 * i + 2, " ".join(word() for _ in range(rng.randint(0, 9))))]
    got = minhash.near_duplicates(documents(spark, docs), n, percent)
    assert sorted(map(tuple, got.collect())) == brute(docs, n, percent)


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert (got[2].component_id, got[2].kept, got[1].kept) == (1, False, True)
    assert (got[3].n_shingles, got[3].component_id, got[3].kept) == (0, 3, True)
    assert got[6].n_shingles == got[7].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    kept = minhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, None}
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert minhash.near_duplicates(documents(spark, [(5, PROSE)])).collect()[0].kept


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (60, 59), (30, 0)):
        links = [(i, i + 1) for i in range(m)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges = spark.createDataFrame([*links, (None, 1), (3, 3)], "src long, dst long")
        got = {r.node: r.component for r in components(edges, Scratch(spark, "test")).collect()}
        want = roots(n, links)
        assert all(got.get(i, i) == want[i] for i in range(n))
