import hashlib
from collections import defaultdict

from assayer.llm import warc
from assayer.llm.queries import op1_warc
from assayer.plans.store import Scratch


def brute(pages):
    groups = defaultdict(list)
    for p, h in pages:
        groups[(h or "").encode()].append(p)
    out = []
    for p, h in pages:
        b = (h or "").encode()
        ids = [x for x in groups[b] if x is not None]
        top = max(ids) if ids and len(b) >= 1000 and len(groups[b]) > 1 else None
        again = top is not None and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = op1_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages)


def test_odd_rows_and_exact_records(spark):
    long = "é" * 500
    html = [(1, long), (2, long), (3, long[:-1]), (4, None), (5, ""), (6, long), (6, long), (7, "x" * 999), (8, "x" * 999), (None, long), (9, "a\r\n\r\nb"), (10, "y" * 1000)]
    rows = [(p, None if p == 3 else f"http://x/\r\nWARC-Type: evil/{p}", h, "s", b"z", True) for p, h in html]
    schema = "page_id long, url string, html string, sha1 string, payload binary, revisit boolean"
    for some in (rows, []):
        folder = Scratch(spark, "test").root
        warc.write(spark.createDataFrame(some, schema), folder)
        got = warc.read(spark, folder, with_payload=True).collect()
        expected = brute([(p, h) for p, _, h, *_ in some])
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected
        for r in got:
            head, http, *_ = bytes(r.record).split(b"\r\n\r\n")
            said = int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
            assert len(r.record) == len(head) + 4 + said + 4
            assert bytes(r.record).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
            if r.record_type == "response":
                assert bytes(r.record)[len(head) + 4 + len(http) + 4 : -4] == bytes(r.payload)
    assert spark.read.parquet(f"{folder}/payloads").count() == 0
