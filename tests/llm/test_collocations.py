import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, w1 string, c long, words array<string>"


def plain(docs, least=30, absorbed=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    candidates = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    dropped = {(lang, *w[i:j]) for (lang, *w), v in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * v >= absorbed * f[(lang, *w[i:j])]}
    out = {}
    for (lang, *w), a in candidates.items():
        if (lang, *w) not in dropped:
            score, _, left, right = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def run(spark, docs, **more):
    df = spark.createDataFrame([(None, t, lang, "x", 1, "y", 2, ["z"]) for lang, t in docs], SCHEMA)
    return sorted(map(tuple, C.collocations(df, **more).collect()))


def made(seed, n=400):
    rng, words = random.Random(seed), "the of über New york a-b 日本 x1 und la AND\x00 \x1c".split(" ")
    return [(rng.choice(["en", None, "und", "", "de"]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def test_against_plain_counts(spark):
    docs = made(1) + [("en", None), (None, None), ("en", ""), ("fr", " \t."), ("en", "New York " * 40_000), ("en", "nospace" * 300_000)] + [("es", "uno dos tres cuatro cinco")] * 33
    got = run(spark, docs)
    assert got == plain(docs) and got
    got = run(spark, docs, least=4)
    assert got == plain(docs, least=4) and len(got) > 100
    assert run(spark, docs, least=6, absorbed=50, top=5) == plain(docs, least=6, absorbed=50, top=5)
    assert run(spark, [("en", None)]) == [] and run(spark, [("en", "a b " * 9)]) == []


def test_parts_of_a_long_text_count_each_window_once(monkeypatch):
    monkeypatch.setattr(C, "HELD", 7)
    monkeypatch.setattr(C, "MOST", 16)
    docs = [("en", t) for _, t in made(2, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], names=["lang", "text"])
    everything = SimpleNamespace(value=np.full(1 << (C.BITS - 3), 255, np.uint8))
    got = Counter()
    dealt = sorted((r for b in C._windows_of(everything)([batch]) for r in zip(*(x.to_pylist() for x in b.columns), strict=True)), key=lambda r: r[:2])
    for b in C._merged([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*dealt, strict=True)], names=["part", "lang", "lines", "counts"])]):
        for lang, *w, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            for k in range(1, 5):
                got[(lang, *w[:k])] += c if w[k - 1] else 0
    want = Counter()
    for _, text in docs:
        for piece in re.split("[.,;:!?\n-\r]", text.lower()):
            w = re.findall("[^ \t]+", piece)
            want.update(("en", *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_a_pair_marked_by_coincidence_counts_no_other_phrase():
    bits = np.full(1 << (C.BITS - 3), 255, np.uint8)
    names = [b".", b"rare", b"b", b"c"]
    at = int(C._hashes("en", np.arange(4), names)[1] >> np.uint64(64 - C.BITS))
    bits[at >> 3] &= 255 - (128 >> (at & 7))  # every bit is set but that of "rare"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["rare b. c rare b. rare"])], names=["lang", "text"])
    dealt = sorted((r for b in C._windows_of(SimpleNamespace(value=bits))([batch]) for r in zip(*(x.to_pylist() for x in b.columns), strict=True)), key=lambda r: r[:2])
    got = Counter()
    for b in C._merged([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*dealt, strict=True)], names=["part", "lang", "lines", "counts"])]):
        for _, *w, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[tuple(w)] += c
    assert got == {(None,) * 4: 3, ("b", None, None, None): 2, ("c", None, None, None): 1}


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**15 + 7, 3 * 10**15 + 1, 10**15 + 9), (9 * 10**18, 9 * 10**18, 9 * 10**18), (30, 31, 37)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(F.expr(C.SCORE)).collect()
    assert [r[0] for r in got] == [2000000 * a // (left + right) for a, left, right in rows]
