import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm import packing, rans
from assayer.llm.queries import op5_best_fit_packing, op8_token_rans
from assayer.llm.tokens import Encoder
from assayer.plans.store import Scratch
from tests.llm.cases import ODD, documents

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {path: Tokenizer.from_file(path) for path in (WORD, BYTE)}


def ids_of(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_stretches_equal_whole_texts(spark, sf, path):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    texts += [t or "" for _, t in ODD] + ["a b", "it's 'll we 'll", "x\n y", "a b c", "é ́x", "1 2 33  4", "a \nb", "tab\t x"]
    for text, got in zip(texts, Encoder(path, most=50).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(path, text), text[:80]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_made_up_texts_equal_the_library(path):
    rng = random.Random(5)
    signs = [*"abcXYZé\n\t\r'.,!?09½ßœ’—…²ºª\x0b\x85\u2028İ日́\x00", " ", " ", "  ", "'s", "'ll", " '", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(6000)]
    for code in ("<u2", "<u4"):
        for text, got in zip(texts, Encoder(path, code=code).encode(texts), strict=True):
            assert np.frombuffer(got, code).tolist() == ids_of(path, text), text


def test_odd_pieces_fall_back_to_whole_texts():
    known = Encoder(WORD)
    known.spelt[:] = 1  # as if ids did not spell their pieces
    (got,) = known.encode(["some words, and more"])
    assert np.frombuffer(got, "<u4").tolist() == ids_of(WORD, "some words, and more")


def check_packing(rows, texts):
    expected = {}
    for d, t in texts:
        ids = [*ids_of(WORD, t), 1]
        for k in range(0, len(ids), 4096):
            expected[d, k // 4096] = (k, len(ids[k : k + 4096]), crc(ids[k : k + 4096]))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter((d, k, *expected[d, k]) for d, t in texts for k in range(1 + (max(x[1] for x in expected if x[0] == d))))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places), -(-sum(r.length for r in rows) // 4096)


def test_packing_of_a_table(spark, sf):
    rows = op5_best_fit_packing(spark, sf).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert used <= least + 1


def test_packing_of_odd_rows(spark):
    check_packing(packing.pack(documents(spark, ODD), WORD, with_ids=False).collect(), ODD)
    packed = packing.pack(documents(spark, ODD), WORD)
    assert max(len(r.tokens) for r in packing.sequences(packed).collect()) <= 4 * 4096
    assert packing.pack(documents(spark, []), WORD).count() == 0


def test_ranks_are_whole_over_salted_parts(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 7L, 1 + id % 4096) as length", "0L as ids_crc32")
    got = packing.assign(rows, block=64).collect()
    assert len(got) == 3000
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000


def test_sums_find_every_exact_combination():
    lengths, capacity = [3, 5, 6, 11, 14, 20], 30
    sums, have = packing.Sums(lengths, capacity), np.ones(capacity + 1, np.int64)
    for total in range(1, capacity + 1):
        assert sorted(sums.pairs(total, have, total)) == sorted((a, b) for a in lengths for b in lengths if b <= a and a + b == total)
        assert sorted(sums.triples(total, have)) == sorted((a, b, c) for a in lengths for b in lengths for c in lengths if c <= b <= a and a + b + c == total)
    plan = packing.Plan({20: 1, 5: 1, 3: 1, 2: 1, 16: 1, 14: 1}, 30)
    assert plan.sequences == 2  # 20 + 5 + 3 + 2, 16 + 14


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_least(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 5000).astype(int) + 1).tolist())
    plan = packing.Plan(dict(counts), 4096)
    assert plan.sequences <= -(-sum(n * k for n, k in counts.items()) // 4096) + 1
    taken = Counter()
    for n, _, times, _, _ in plan.runs:
        taken[n] += times
    assert taken == counts


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 200_000), 5000).astype(np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=5001)))
    block = coder.encode(ids)
    assert len(block) < 1.3 * len(ids)
    assert (coder.decode(block) == ids).all()
    step = rans.CHECK * rans.LANES
    assert (coder.decode(block, 1, 1) == ids[step : 2 * step]).all()
    for n in (1, 2, 1023, 1025):
        assert (coder.decode(coder.encode(ids[:n])) == ids[:n]).all()
    with pytest.raises(ValueError):
        coder.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_files_of_a_table(spark, sf):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    start, expected = 0, []
    for d, t in texts:
        ids = [*ids_of(BYTE, t), 0]
        expected.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op8_token_rans(spark, sf).collect())) == expected


def test_files_of_odd_rows(spark, monkeypatch):
    for texts in (ODD, []):
        files = Scratch(spark, "test").root
        rans.write(documents(spark, texts), BYTE, files)
        rows = sorted(rans.read(spark, files).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d))
        want = Counter((d, tuple([*ids_of(BYTE, t), 0])) for d, t in texts)
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
        at = 0
        for r in rows:
            assert r.start == at
            at += len(r.ids) // 4


#: With the contents of added tokens, held against the library's default call.
ADDED = [
    (1, "a <|endoftext|> b"),
    (2, "plain words stand here"),
    (3, "<|endoftext|>"),
    (4, "x<|startoftext|>y <|endoftext|><|endoftext|> z"),
    (5, "<|ENDOFTEXT|> <|endoftext |>"),
    (6, ""),
    (7, "last plain words"),
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_added_tokens_are_the_librarys(path):
    got = Encoder(path, most=50).encode([t for _, t in ADDED])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(path, t) for _, t in ADDED]


def test_queries_and_pipeline_follow_the_library(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, ADDED)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    start, want = 0, []
    for d, t in ADDED:
        ids = [*ids_of(BYTE, t), 0]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op8_token_rans(spark, str(tmp_path)).collect())) == want
    want = [(d, len(ids), crc(ids)) for d, t in ADDED for ids in [[*ids_of(WORD, t), 1]]]
    for rows in (op5_best_fit_packing(spark, str(tmp_path)).collect(), corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()):
        assert sorted((r.doc_id, r.length, r.ids_crc32) for r in rows) == want
