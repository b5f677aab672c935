import hashlib
import re

from assayer.llm import decontaminate
from assayer.llm.queries import op6_benchmark_decontamination
from tests.llm.cases import ODD, PROSE, documents


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for p in range(len(w) - k + 1) if k and i is not None else ():
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (i := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= i
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(10, PROSE.upper() + "!"), (9, "Two, WORDS."), (9, None), (8, ""), (7, "-- !"), (None, "word"), (6, "Two words"), (5, "say nothing at all")]


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op6_benchmark_decontamination(spark, sf).collect()), key=str) == brute(docs, items)


def test_odd_rows_by_broadcast_and_by_shuffle(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for texts in (ODD, []):
        for most in (1000, 0):
            found = decontaminate.scan(documents(spark, texts), bench, most_bytes=most)
            assert sorted(map(tuple, decontaminate.verdicts(found).collect()), key=str) == brute(texts, ITEMS)
    none = decontaminate.scan(documents(spark, ODD), bench.limit(0))
    assert sum(r.n_hit for r in none.collect()) == 0


def test_filter_and_spans_keep_rows_whole(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, ODD)
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_, bad in brute(ODD, ITEMS) if not bad}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(decontaminate.scan(docs, bench)).collect()}
    assert cut[7] == "" and cut[1] == "" and cut[6] == "word"
