import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from assayer.operators import trees


def made(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.3:
        return {rng.choice(["a", "b", "patient_id", "patient_ids", "ü", "x y"]): made(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and kind < 0.55:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 1, 0, 7, 2.5, -3.25, "P1", "P2", " ", "", 'quote"\\ n\n', "日本"])


def leaves(doc, path="$", name=None):
    if isinstance(doc, dict) and doc:
        return [x for k, v in doc.items() for x in leaves(v, f"{path}.{k}", k)]
    if isinstance(doc, list) and doc:
        return [x for i, v in enumerate(doc) for x in leaves(v, f"{path}[{i}]", name)]
    kind = {dict: "object", list: "array", bool: "boolean", type(None): "null", str: "string"}.get(type(doc), "number")
    return [(path, name, kind, {True: "true", False: "false"}[doc] if kind == "boolean" else str(doc) if kind in ("string", "number") else None)]


def ids(doc):
    if isinstance(doc, list):
        return {p for x in doc for p in ids(x)}
    out = set()
    for k, v in doc.items() if isinstance(doc, dict) else ():
        if k == "patient_id" and isinstance(v, str):
            out |= {v}
        elif k == "patient_ids" and isinstance(v, list):
            out |= {x for x in v if isinstance(x, str)}
        else:
            out |= ids(v)
    return {x for x in out if x.strip()}


def diff(p, v, path="$"):
    if isinstance(p, dict) and isinstance(v, dict):
        out = []
        for k in {*p, *v}:
            at = f"{path}.{k}"
            out += [(at, "extra in live")] if k not in p else [(at, "extra in published")] if k not in v else diff(p[k], v[k], at)
        return out
    if isinstance(p, list) and isinstance(v, list):
        return [(path, "length")] if len(p) != len(v) else [x for i in range(len(p)) for x in diff(p[i], v[i], f"{path}[{i}]")]
    if isinstance(p, (int, float)) and isinstance(v, (int, float)):
        if isinstance(p, bool) or isinstance(v, bool):
            return [(path, "boolean")] if type(p) is not type(v) or p != v else []
        if not (math.isfinite(p) and math.isfinite(v)):
            return [(path, "non-finite")]
        return [(path, "number")] if abs(p - v) > 1e-6 else []
    return [(path, "value")] if p != v else []


def changed(rng, doc):
    if rng.random() < 0.15:
        return made(rng, 3)
    if isinstance(doc, dict):
        return {k: changed(rng, v) for k, v in doc.items() if rng.random() > 0.05}
    if isinstance(doc, list):
        return [changed(rng, v) for v in doc if rng.random() > 0.05]
    return doc + rng.choice([1e-8, 1.0, float("nan"), float("inf")]) if isinstance(doc, float) else doc


def test_against_plain_recursion(spark):
    rng = random.Random(11)
    docs = [made(rng) for _ in range(150)] + [{"deep": [[[[[[{"patient_id": "P9"}]]]]]]}, {"patient_ids": ["P3", {"patient_id": "P4"}, 5]}]
    others = [changed(rng, d) for d in docs]
    rows = [(i, json.dumps(d), json.dumps(o)) for i, (d, o) in enumerate(zip(docs, others, strict=True))]
    df = spark.createDataFrame(rows, "path long, value string, live string")  # names that the operators use themselves
    got = trees.walk(df, "path", "value")
    want = [(i, *x) for i, d in enumerate(docs) for x in leaves(d)]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.toDF("k", "path", "name", "kind", "value").collect()), key=key) == sorted(want, key=key)
    df = df.toDF("id", "published", "live")
    assert {tuple(r) for r in trees.patient_ids(df, "id", "published").collect()} == {(i, p) for i, d in enumerate(docs) for p in ids(d)}
    got = sorted(map(tuple, trees.differences(df, "id", "published", "live").collect()))
    assert got == sorted((i, *x) for i, (d, o) in enumerate(zip(docs, others, strict=True)) for x in diff(d, o))
    assert len(got) > 50
    shas = [r[0] for r in df.orderBy("id").select(trees.canonical_sha(F.col("published"))).collect()]
    assert shas == [hashlib.sha256(json.dumps(d, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for d in docs]


def test_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"a": NaN, "s": "x NaN,"}'), (4, "3"), (5, "{}"), (None, '{"a":1}')], "id long, doc string")
    got = {(r.id, r.path, r.kind, r.value) for r in trees.walk(df, "id", "doc").collect()}
    assert got == {(2, "$", "invalid", None), (3, "$.a", "number", "Infinity"), (3, "$.s", "string", "x NaN,"), (4, "$", "number", "3"), (5, "$", "object", None), (None, "$.a", "number", "1")}
    assert trees.walk(df.where("false"), "id", "doc").count() == 0
    assert trees.differences(df.where("false"), "id", "doc", "doc").count() == 0
    assert [tuple(r) for r in trees.differences(df, "id", "doc", "doc").collect()] == [(3, "$.a", "non-finite")]


def test_equal_lines_stand_by_supplier_number(spark, sf, tmp_path):
    line, order = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    one = line.limit(1).withColumn("l_orderkey", F.lit(7).cast("long"))
    one.withColumn("l_suppkey", F.explode(F.array(*(F.lit(k).cast("long") for k in (10, 9, 100))))).select(line.columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    order.where("o_orderkey = 7").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.path: r.value for r in trees.jsn1_nested_leaves(spark, str(tmp_path)).collect()}
    assert [got[f"$.lines[{i}].patient_ids[0]"] for i in range(3)] == ["S9", "S10", "S100"]
    doc = spark.read.parquet(f"{tmp_path}/orders.parquet").first()
    first = line.limit(1).first()
    lines = [{"cents": round(first.l_extendedprice * 100), "n": first.l_linenumber, "open": first.l_linestatus == "O", "patient_ids": [f"S{k}", " "]} for k in (9, 10, 100)]
    whole = json.dumps({"lines": lines, "order": 7, "patient": {"patient_id": f"C{doc.o_custkey}", "status": doc.o_orderstatus}}, separators=(",", ":"))
    assert [r.sha for r in trees.prj18_nested_sha(spark, str(tmp_path)).collect()] == [hashlib.sha256(whole.encode()).hexdigest()]


def test_several_levels_a_pass(spark, monkeypatch):
    kept = []
    keep = trees.Scratch.keep
    monkeypatch.setattr(trees.Scratch, "keep", lambda self, df, name, *more: (kept.append(name), keep(self, df, name, *more))[1])
    one = {"patient": {"patient_id": "P1"}, "lines": [{"n": 1, "patient_ids": ["S1"]}], "big": float("inf")}
    other = {"patient": {"patient_id": "P2"}, "lines": [{"n": 2, "patient_ids": ["S1"]}], "big": float("inf")}
    df = spark.createDataFrame([(1, json.dumps(one), json.dumps(other))], "id long, p string, l string")
    assert {r.path for r in trees.walk(df, "id", "p").collect()} == {"$.patient.patient_id", "$.lines[0].n", "$.lines[0].patient_ids[0]", "$.big"}
    assert {tuple(r) for r in trees.differences(df, "id", "p", "l").collect()} == {(1, "$.patient.patient_id", "value"), (1, "$.lines[0].n", "number"), (1, "$.big", "non-finite")}
    assert len(kept) == 2
    deep, path = 1, "$" + ".a[0]" * 12
    for _ in range(12):
        deep = {"a": [deep], "b": {}}
    df = spark.createDataFrame([(1, json.dumps(deep), json.dumps(deep).replace("1", "2"))], "id long, p string, l string")
    got = trees.walk(df, "id", "p").collect()
    assert len(got) == 13 and [(r.name, r.value) for r in got if r.path == path] == [("a", "1")]
    assert [tuple(r) for r in trees.differences(df, "id", "p", "l").collect()] == [(1, path, "number")]
