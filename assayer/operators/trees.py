"""Nested documents: walks to their leaves, canonical digests, ids anywhere in them, and differences node by node.

A document is read once, as a variant, and is never a Python object. A walk opens several levels in one pass and writes what leaves it;
what is deeper still is opened from there, so there are as many passes as the deepest document has times that many levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.plans.store import Scratch
from assayer.sources.tables import table

#: Levels that a walk opens between two writes.
_LEVELS = 5
#: The same of pairs, which are opened as maps and arrays.
_PAIR_LEVELS = 3
#: Stands for the numbers that JSON has no words for: it is read as infinite.
_INFINITE = r"(?<=^|[:\[,])(\s*)-?(?:NaN|Infinity)(?=\s*(?:$|[,\]}]))"


def parsed(json: Column) -> Column:
    """The document as a variant, null if it is none.

    Bare NaN and Infinity, which some writers use, are numbers that are not finite. Only a document that is malformed but for them is
    read so; what looks like one between separators inside of its strings is then changed alike.
    """
    return F.coalesce(F.try_parse_json(json), F.try_parse_json(F.regexp_replace(json, _INFINITE, "$1 1e999")))


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _object(v: Column) -> Column:
    return _get(v, "map<string,variant>")


def _array(v: Column) -> Column:
    return _get(v, "array<variant>")


def scalar_kind(v: Column) -> Column:
    """null, boolean, string or number of a variant that holds no container; ``invalid`` where there is no document."""
    name = F.schema_of_variant(v)
    return F.when(v.isNull(), "invalid").when(F.is_variant_null(v), "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").otherwise("number")


def _with(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: a filter on them isn't pushed below, where it would work them out again."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _opened(nodes: DataFrame) -> DataFrame:
    """One level down: (key, path, name, v) of the children of each container, and of what has none as it is."""
    inner = nodes.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "field", "child")
    n = nodes.lateralJoin(inner)
    step = F.when(F.col("field").isNotNull(), F.concat("path", F.lit("."), "field")).when(F.col("pos").isNotNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).otherwise(F.col("path"))
    return n.select("key", step.alias("path"), F.coalesce("field", "name").alias("name"), F.coalesce("child", "v").alias("v"))


def walk(documents: DataFrame, key: str, json: str, wanted: Column | None = None) -> DataFrame:
    """(key, path, name, kind, value): the leaves of JSON documents; with ``wanted``, a condition on path and name, only those.

    Paths are ``$.a.b[0]``; ``name`` is the last field's. An empty object or array is a leaf, a document that can't be read one of
    the kind ``invalid``; a null document has none.
    """
    scratch, found, depth = Scratch(documents.sparkSession, "walk"), [], 0
    level = documents.where(F.col(json).isNotNull()).select(F.col(key).alias("key"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), parsed(F.col(json)).alias("v"))
    while True:
        for _ in range(_LEVELS):
            level = _opened(level)
        if wanted is not None:
            level = level.where(wanted | F.col("v").isNull() | F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<"))
        shaped = _with(level, shape=F.schema_of_variant("v"))
        shape = F.col("shape")
        kind = (
            F.when(F.col("v").isNull(), "invalid").when(shape.startswith("OBJECT<"), "object").when(shape.startswith("ARRAY<"), "array")
            .when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean").when(shape == "STRING", "string").otherwise("number")
        )
        inner = F.col("kind").isin("object", "array")
        nodes = shaped.select("key", "path", "name", "v", kind.alias("kind"))
        # of what is opened further only the variant is kept, without the names that belong to other parts of its document
        further = inner & ~F.to_json("_v").isin("{}", "[]")
        nodes = _with(nodes.withColumnRenamed("v", "_v"), value=F.when(~inner, _get(F.col("_v"), "string")), v=F.when(further, _get(F.col("_v"), "variant"))).drop("_v")
        nodes = scratch.keep(nodes if wanted is None else nodes.where(F.col("v").isNotNull() | wanted), str(depth))
        leaves = nodes.where("v is null")
        found.append(leaves.select(F.col("key").alias(key), "path", "name", "kind", "value"))
        level, depth = nodes.where("v is not null").select("key", "path", "name", "v"), depth + 1
        if level.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def patient_ids(documents: DataFrame, key: str, json: str) -> DataFrame:
    """(key, patient): the strings at any ``patient_id``, and in any list ``patient_ids``, that are not blank; distinct in each document."""
    leaves = walk(documents, key, json, F.col("name").isin("patient_id", "patient_ids")).where("kind = 'string'").where(F.col("value").rlike(r"\S"))
    # what a list of ids holds beside strings is not looked into
    single = F.col("path").rlike(r"\.patient_id$") & ~F.col("path").rlike(r"\.patient_ids(\[\d+\])+[.\[]")
    listed = F.col("path").rlike(r"\.patient_ids\[\d+\]$")
    return leaves.where(single | listed).select(key, F.col("value").alias("patient")).distinct()


def canonical_sha(json: Column) -> Column:
    """SHA-256 of a document in compact form with sorted keys at every level; null if it can't be read."""
    return F.sha2(F.to_json(parsed(json)), 256)


def differences(pairs: DataFrame, key: str, published: str, live: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, path, kind): where two documents differ.

    Of a field that only one has, it is ``extra in published`` or ``extra in live``; of arrays of different length, ``length``, and
    they are not looked into; of booleans against booleans or numbers, ``boolean``; of numbers, ``non-finite`` if either is, equal or not,
    and ``number`` beyond ``tolerance``; of all else, ``value``. Both sides go down level by level in one row, so nothing is joined; parts
    that read alike and hold no number that is not finite are not gone into.
    """
    scratch, found, depth = Scratch(pairs.sparkSession, "differences"), [], 0
    level = pairs.select(F.col(key).alias("key"), F.lit("$").alias("path"), parsed(F.col(published)).alias("p"), parsed(F.col(live)).alias("l"), F.lit(True).alias("in_p"), F.lit(True).alias("in_l"), F.lit(None).cast("string").alias("kind"))
    while True:
        for _ in range(_PAIR_LEVELS):
            level = _children(_judged(level, tolerance))
        nodes = scratch.keep(_judged(level, tolerance).drop("jp", "jl"), str(depth))
        found.append(nodes.where("kind is not null").select(F.col("key").alias(key), "path", "kind"))
        level, depth = nodes.where("kind is null"), depth + 1
        if level.isEmpty():
            break
        level = _children(level)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _judged(level: DataFrame, tolerance: float) -> DataFrame:
    """Pairs with the kind of their difference; the kind is open where both are containers that are to be gone into. Pairs without
    a difference are left out."""
    level = _with(level, jp=F.to_json("p"), jl=F.to_json("l"))
    # not finite numbers differ from themselves; a string that only looks like one is looked at more closely below
    alike = F.col("kind").isNull() & F.col("in_p") & F.col("in_l") & F.col("jp").eqNullSafe(F.col("jl")) & ~F.coalesce(F.col("jp").rlike("Infinity|NaN"), F.lit(False))
    level = level.where(~alike)
    p, v = F.col("p"), F.col("l")
    holds = lambda sign: F.col("jp").startswith(sign) & F.col("jl").startswith(sign)
    plain = ~F.coalesce(F.col("jp").rlike(r"^[{\[]"), F.lit(False)) & ~F.coalesce(F.col("jl").rlike(r"^[{\[]"), F.lit(False))
    kp, kl = scalar_kind(p), scalar_kind(v)
    number = lambda k: k.isin("number", "boolean")
    np_, nl = _get(p, "double"), _get(v, "double")
    infinite = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    same = F.col("jp").eqNullSafe(F.col("jl"))
    of_numbers = F.when(infinite(np_) | infinite(nl), "non-finite").when(F.abs(np_ - nl) > tolerance, "number")
    kind = (
        F.when(F.col("_kind").isNotNull(), F.col("_kind")).when(~F.col("in_p"), "extra in live").when(~F.col("in_l"), "extra in published").when(holds("{"), None)
        .when(holds("["), F.when(F.cardinality(_array(p)) != F.cardinality(_array(v)), "length"))
        .when(plain & number(kp) & number(kl), F.when((kp == "boolean") | (kl == "boolean"), F.when((kp != kl) | ~same, "boolean")).otherwise(of_numbers))
        .when(~same, "value")
    )
    found = _with(level.withColumnRenamed("kind", "_kind"), kind=kind).drop("_kind").where(F.col("kind").isNotNull() | holds("{") | holds("["))
    return found.withColumns({c: F.when(F.col("kind").isNull(), F.col(c)) for c in ("p", "l", "jp", "jl")})


def _children(nodes: DataFrame) -> DataFrame:
    """Pairs one level down; what has its kind stays as it is."""
    p, v, yes = F.col("p"), F.col("l"), F.lit(True)
    nodes = nodes.withColumns({"po": _object(p), "lo": _object(v), "pa": _array(p), "la": _array(v)})
    po, lo = F.col("po"), F.col("lo")
    fields = F.transform(F.array_union(F.map_keys(po), F.map_keys(lo)), lambda k: F.struct(F.concat(F.lit("."), k).alias("step"), F.element_at(po, k).alias("p"), F.element_at(lo, k).alias("l"), F.map_contains_key(po, k).alias("in_p"), F.map_contains_key(lo, k).alias("in_l")))
    items = F.transform(F.arrays_zip(F.col("pa").alias("p"), F.col("la").alias("l")), lambda x, i: F.struct(F.concat(F.lit("["), i, F.lit("]")).alias("step"), x["p"].alias("p"), x["l"].alias("l"), yes.alias("in_p"), yes.alias("in_l")))
    own = F.array(F.struct(F.lit("").alias("step"), p.alias("p"), v.alias("l"), F.col("in_p").alias("in_p"), F.col("in_l").alias("in_l")))
    below = nodes.select("key", "path", "kind", F.explode_outer(F.when(F.col("kind").isNotNull(), own).otherwise(F.coalesce(fields, items))).alias("c"))
    return below.select("key", F.concat("path", "c.step").alias("path"), "c.p", "c.l", "c.in_p", "c.in_l", "kind")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """order, doc: an order with its lines as a nested document, three levels deep."""
    line = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.struct(F.col("l_linenumber").cast("long").alias("n"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), (F.col("l_linestatus") == "O").alias("open"), "l_suppkey").alias("line"),
    )
    # a few lines an order; suppliers stand in order of their numbers, not of their digits
    written = lambda x: F.struct(x["n"].alias("n"), x["cents"].alias("cents"), x["open"].alias("open"), F.array(F.concat(F.lit("S"), x["l_suppkey"]), F.lit(" ")).alias("patient_ids"))
    lines = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("line")), written).alias("lines"))
    o = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    patient = F.struct(F.concat(F.lit("C"), "o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("status"))
    return o.select(F.col("o_orderkey").alias("order"), patient.alias("patient"), "lines")


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


_LINES = "ln AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, round(l_extendedprice * 100)::BIGINT, l_linestatus = 'O', l_suppkey) - 1 AS i, l_linenumber AS n, round(l_extendedprice * 100)::BIGINT AS cents, l_linestatus = 'O' AS open, l_suppkey AS s FROM lineitem)"
_WITH = f"WITH {_LINES}, od AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS st, l.n FROM orders JOIN (SELECT o, count(*) AS n FROM ln GROUP BY o) l ON o = o_orderkey)"


@query(
    f"""{_WITH} SELECT o AS "order", '$.order' AS path, 'order' AS name, 'number' AS kind, o::VARCHAR AS value FROM od UNION ALL SELECT o, '$.patient.patient_id', 'patient_id', 'string', 'C' || c FROM od
UNION ALL SELECT o, '$.patient.status', 'status', 'string', st FROM od UNION ALL SELECT o, '$.note', 'note', 'null', NULL FROM od UNION ALL SELECT o, '$.none', 'none', 'array', NULL FROM od
UNION ALL SELECT o, '$.lines[' || i || '].n', 'n', 'number', n::VARCHAR FROM ln UNION ALL SELECT o, '$.lines[' || i || '].cents', 'cents', 'number', cents::VARCHAR FROM ln
UNION ALL SELECT o, '$.lines[' || i || '].open', 'open', 'boolean', open::VARCHAR FROM ln UNION ALL SELECT o, '$.lines[' || i || '].patient_ids[0]', 'patient_ids', 'string', 'S' || s FROM ln
UNION ALL SELECT o, '$.lines[' || i || '].patient_ids[1]', 'patient_ids', 'string', ' ' FROM ln"""
)
def jsn1_nested_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf of every order's document, arrays indexed."""
    none = F.array().cast("array<string>").alias("none")
    docs = _orders(spark, folder).select("order", _json(F.col("order"), F.col("patient"), F.col("lines"), F.lit(None).cast("string").alias("note"), none).alias("doc"))
    return walk(docs, "order", "doc")


@query("SELECT event_id, '$.k' AS path, props::JSON->>'k' AS value FROM events WHERE props IS NOT NULL")
def jsn1_json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return walk(table(spark, folder, "events"), "event_id", "props").select("event_id", "path", "value")


@query("SELECT DISTINCT p.patient FROM (SELECT 'C' || o_custkey AS patient FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'S' || l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) p")
def prj20_patient_ids_collect(spark: SparkSession, folder: str) -> DataFrame:
    """Every patient id anywhere in the orders' documents, single or listed, blank ones left out."""
    docs = _orders(spark, folder).select("order", _json(F.col("patient"), F.col("lines")).alias("doc"))
    return patient_ids(docs, "order", "doc").select("patient").distinct()


@query(
    f"""{_WITH}, j AS (SELECT o, string_agg('{{"cents":' || cents || ',"n":' || n || ',"open":' || open || ',"patient_ids":["S' || s || '"," "]}}', ',' ORDER BY i) AS lines FROM ln GROUP BY o)
SELECT o AS "order", sha256('{{"lines":[' || lines || '],"order":' || o || ',"patient":{{"patient_id":"C' || c || '","status":"' || st || '"}}}}') AS sha FROM od JOIN j USING (o)"""
)
def prj18_nested_sha(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of nested documents whose keys come in another order."""
    return _orders(spark, folder).select("order", canonical_sha(_json(F.col("patient"), F.col("order"), F.col("lines"))).alias("sha"))


@query(
    f"""{_WITH} SELECT o AS "order", '$.patient.status' AS path, 'value' AS kind FROM od WHERE o % 7 = 1 UNION ALL SELECT o, '$.lines', 'length' FROM od WHERE o % 7 = 2
UNION ALL SELECT o, '$.lines[' || i || '].cents', 'number' FROM ln WHERE o % 7 = 3 AND o IN (SELECT o FROM od) UNION ALL SELECT o, '$.extra', 'extra in published' FROM od WHERE o % 7 = 4
UNION ALL SELECT o, '$.version', 'extra in live' FROM od WHERE o % 7 = 4 UNION ALL SELECT o, '$.order', 'value' FROM od WHERE o % 7 = 5
UNION ALL SELECT o, '$.lines[' || i || '].open', 'boolean' FROM ln WHERE o % 7 = 6 AND o IN (SELECT o FROM od) UNION ALL SELECT o, '$.worst', 'non-finite' FROM od WHERE o % 5 = 0"""
)
def jn9_nested_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Published documents that went apart from the live ones in every way there is, by order."""
    d, k = _orders(spark, folder), F.col("order") % 7
    worst = F.when(F.col("order") % 5 == 0, "NaN").otherwise("1")
    numbered = lambda json: F.concat(F.lit('{"worst":'), worst, F.lit(","), F.substring(json, 2, 1 << 30))
    live = F.when(k == 4, _json(F.col("order"), F.col("patient"), F.col("lines"), F.lit("1").alias("version"))).otherwise(_json(F.col("order"), F.col("patient"), F.col("lines")))
    moved = F.transform("lines", lambda x: x.withField("cents", x["cents"] + 1))
    shut = F.transform("lines", lambda x: x.withField("open", ~x["open"]))
    o, patient, lines = F.col("order"), F.col("patient"), F.col("lines")
    published = (
        F.when(k == 1, _json(o, patient.withField("status", F.lit("?")).alias("patient"), lines)).when(k == 2, _json(o, patient, F.slice(lines, 1, F.size(lines) - 1).alias("lines")))
        .when(k == 3, _json(o, patient, moved.alias("lines"))).when(k == 4, _json(o, patient, lines, F.lit("1").alias("extra"))).when(k == 5, _json(o.cast("string").alias("order"), patient, lines))
        .when(k == 6, _json(o, patient, shut.alias("lines"))).otherwise(_json(lines, patient, o))
    )
    return differences(d.select("order", numbered(published).alias("published"), numbered(live).alias("live")), "order", "published", "live")
