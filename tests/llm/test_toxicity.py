import random
import zlib

from assayer.llm import toxicity
from assayer.llm.queries import op7_toxicity
from tests.llm.cases import ODD, documents


def planted(n, seed=0):
    rng = random.Random(seed)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        text = rng.choices(common, k=rng.randint(20, 200))
        toxic = i % 5 == 1
        if toxic:
            for _ in range(rng.randint(3, 6)):
                text[rng.randrange(len(text))] = rng.choice(["zorvile", "zorvast", "zorvus", "quagmort"])
            text[0] = "women"
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_held_out_documents_and_neutral_mentions(spark):
    rows = planted(900)
    labels = spark.createDataFrame([(d, 1, t) for d, _, t in rows], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(d, x) for d, x, _ in rows])
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.verdicts(toxicity.score(docs, model)).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(t, got[d].predicted) for d, _, t in rows if got[d].held_out]
    assert sum(t == p for t, p in held) >= 0.97 * len(held)
    # Toxic texts here name a group; the swaps keep that name from counting.
    score = model.scorer()
    assert abs(score("women walk here") - score("men walk here")) < 0.05
    assert score("women walk here") < 0.5


def test_penalty_spares_neutral_mentions(spark):
    """Toxic texts name groups more often than clean ones; held-out clean texts that name one are spared by the swaps."""
    rng = random.Random(3)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(300)]
    terms = toxicity.IDENTITY["en"]
    rows, neutral = [], []
    for i in range(1500):
        text, toxic = rng.choices(common, k=rng.randint(15, 40)), i % 3 == 0
        if toxic and rng.random() < 0.6:
            text.append(rng.choice(["zorvile", "quagmort", "blenstig"]))
        if toxic or rng.random() < 0.06:
            text += rng.choices(terms[:12], k=3)
            if not toxic:
                neutral.append(i)
        rows.append((i, " ".join(text), int(toxic)))
    labels = spark.createDataFrame([(d, 1, t) for d, _, t in rows], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(d, x) for d, x, _ in rows])
    false = {}
    for penalty in (0.0, toxicity.PENALTY):
        score = toxicity.fit(docs, labels, penalty=penalty).scorer()
        held = [x for d, x, _ in rows if d in set(neutral) and zlib.crc32(str(d).encode()) % 5 == 0]
        false[penalty] = sum(score(x) >= 0.5 for x in held) / len(held)
    assert false[toxicity.PENALTY] < false[0.0]


def brute_swaps(text):
    """Feature sets of both copies, computed from the copies themselves."""
    out = []
    for gone, come in toxicity.swaps(text):
        out.append((set(gone), set(come)))
    return out


def test_swaps_are_differences_of_copies():
    for text in ("the women met the jewish doctor. all was well", "plain words stand here! and more of them", "one"):
        held = toxicity.words(text)
        every = {f for w in held for f in toxicity.features(w)}
        found = brute_swaps(text)
        assert len(found) == toxicity.SWAPS
        for gone, come in found:
            assert not gone & come
            if held & toxicity._LANGUAGES.keys():  # the copy with the first term is the text itself
                assert gone <= every and not come & every
                swapped = [(held - {a}) | {b} for a in held & toxicity._LANGUAGES.keys() for b in toxicity._LANGUAGES[a]]
                assert any({f for w in s for f in toxicity.features(w)} == every - gone | come for s in swapped)
    assert toxicity.swaps(None) == toxicity.swaps("") == []


def test_of_two_labels_the_toxic_one_counts(spark):
    docs = documents(spark, [(d, f"word{d} other") for d in range(40)])
    labels = spark.createDataFrame([(d, 0, t) for d in range(40) for t in (0, 1)], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in toxicity.sample(docs, labels).select("toxic").collect()} == {1}


def test_whole_table(spark, sf):
    rows = op7_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    for labels in ([], [(1, 0, None), (99, 0, 1), (None, 1, 1)], [(d, 0, int(d == 6)) for d in range(1, 10)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = toxicity.fit(docs, table)
        rows = toxicity.verdicts(toxicity.score(docs, model)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.without_toxic(docs, table).columns == docs.columns
    assert toxicity.score(documents(spark, []), model).count() == 0
