"""Gates as data: rules over a table become violation rows, and violation rows become verdicts.

A rule is a condition in SQL that must hold; a condition that is not true, null included, is a violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.registry import query
from assayer.plans.measures import SLICES, slices
from assayer.sources.tables import table


def violations(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, rule): one row a broken rule, in one pass over the table."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(held), F.lit(False)), name) for name, held in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def passes(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Per object, how many rules it breaks and whether it passes: no join, as the rules sit in the row."""
    n = sum((F.coalesce(F.expr(held), F.lit(False)).cast("int") for held in rules.values()), F.lit(0))
    return rows.select(key, (len(rules) - n).cast("long").alias("n_violations"), (n == len(rules)).alias("passes"))


def stage_verdict(stages: DataFrame, key: str, stage: str, state: str) -> DataFrame:
    """All pass -> accept; any fail -> reject; anything skipped or unverified -> incomplete, never a pass."""
    fail, open_ = F.count(F.when(F.col(state) == "FAIL", 1)), F.count(F.when(~F.coalesce(F.col(state).isin("PASS", "FAIL"), F.lit(False)), 1))
    verdict = F.when(fail > 0, "REJECT").when(open_ > 0, "INCOMPLETE").otherwise("ACCEPT")
    return stages.groupBy(key).agg(verdict.alias("verdict"), F.count(stage).alias("n_stages"))


def broken_sql(source: str, key: str, rules: dict[str, str]) -> str:
    """The same rules for another SQL engine."""
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM ({source}) WHERE NOT coalesce({held}, false)" for name, held in rules.items())


def passes_sql(source: str, key: str, rules: dict[str, str]) -> str:
    n = " + ".join(f"(coalesce({held}, false))::INT" for held in rules.values())
    return f"SELECT {key}, ({len(rules)} - ({n}))::BIGINT AS n_violations, ({n}) = {len(rules)} AS passes FROM ({source})"


METADATA = {"orientation": "o_orderstatus IN ('O', 'F')", "positive": "o_totalprice > 1000", "version": "o_orderpriority <> '5-LOW'", "known_patient": "o_custkey IS NOT NULL"}


@query(broken_sql("SELECT * FROM orders", "o_orderkey", METADATA))
def gt1_metadata_rules(spark: SparkSession, folder: str) -> DataFrame:
    return violations(table(spark, folder, "orders"), "o_orderkey", METADATA)


TREE = {"attrs": "l_extendedprice / l_quantity BETWEEN 850 AND 3000", "audit": "l_linestatus = 'O'", "manifest": "l_tax < 0.08"}


@query("WITH v AS (" + broken_sql("SELECT * FROM lineitem", "l_orderkey", TREE) + ") SELECT l_orderkey, rule, count(*) AS n FROM v GROUP BY ALL")
def gt2_tree_conformance(spark: SparkSession, folder: str) -> DataFrame:
    return violations(table(spark, folder, "lineitem"), "l_orderkey", TREE).groupBy("l_orderkey", "rule").agg(F.count("*").alias("n"))


PAIRED = {"task": "p_type IS NOT NULL", "fidelity": "p_retailprice > 900", "detectability": "p_size > 5", "together": "(p_retailprice > 900) = (p_size > 5)"}


@query(passes_sql("SELECT * FROM part", "p_partkey", PAIRED))
def gt3_paired_gate(spark: SparkSession, folder: str) -> DataFrame:
    return passes(table(spark, folder, "part"), "p_partkey", PAIRED)


@query("SELECT p_brand AS method, count(*) FILTER (p_size > 25) > 0 AS has_psnr, count(*) FILTER (p_retailprice > 1500) > 0 AS has_cnr, (count(*) FILTER (p_size > 25) > 0) = (count(*) FILTER (p_retailprice > 1500) > 0) AS consistent FROM part GROUP BY p_brand")
def gt4_paired_report(spark: SparkSession, folder: str) -> DataFrame:
    """Both metrics or neither per method."""
    a, b = F.count(F.when(F.col("p_size") > 25, 1)) > 0, F.count(F.when(F.col("p_retailprice") > 1500, 1)) > 0
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("method")).agg(a.alias("has_psnr"), b.alias("has_cnr"), (a == b).alias("consistent"))


CLAIM = {"task": "event_type <> 'error'", "patient": "user_id > 0", "evidence": "length(props) >= 9", "value": "value >= 1"}


@query(passes_sql("SELECT * FROM events", "event_id", CLAIM))
def gt5_claim_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return passes(table(spark, folder, "events"), "event_id", CLAIM)


_STAGES = "SELECT o_custkey AS bundle, o_orderkey AS stage, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN CASE WHEN o_totalprice > 400000 THEN 'FAIL' ELSE 'PASS' END ELSE CASE WHEN o_totalprice > 300000 THEN 'UNVERIFIED' ELSE 'PASS' END END AS state FROM orders"


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", F.when(F.col("o_totalprice") > 400000, "FAIL").otherwise("PASS")).otherwise(F.when(F.col("o_totalprice") > 300000, "UNVERIFIED").otherwise("PASS"))
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("stage"), state.alias("state"))


@query(f"SELECT bundle, CASE WHEN bool_or(state = 'FAIL') THEN 'FAIL' WHEN bool_or(state = 'UNVERIFIED') THEN 'UNVERIFIED' ELSE 'PASS' END AS state FROM ({_STAGES}) GROUP BY bundle")
def gt6_input_binding(spark: SparkSession, folder: str) -> DataFrame:
    """The worst of a bundle's bindings."""
    order = F.lit(["PASS", "UNVERIFIED", "FAIL"])
    worst = F.max(F.array_position(order, F.col("state")))
    return _stages(spark, folder).groupBy("bundle").agg(F.element_at(order, worst.cast("int")).alias("state"))


@query(f"SELECT bundle, CASE WHEN count(*) FILTER (state = 'FAIL') > 0 THEN 'REJECT' WHEN count(*) FILTER (state = 'UNVERIFIED') > 0 THEN 'INCOMPLETE' ELSE 'ACCEPT' END AS verdict, count(*) AS n_stages FROM ({_STAGES}) GROUP BY bundle")
def gt18_bundle_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return stage_verdict(_stages(spark, folder), "bundle", "stage", "state")


@query(f"WITH {SLICES}, p AS (SELECT vendor, count(DISTINCT patient) AS n_patients, corr(score_a, score_b) AS r, count(*) FILTER (score_a < 0) AS n_bad FROM s GROUP BY vendor) SELECT vendor, n_patients, round(r, 6) AS r, n_patients >= 10 AND r >= 0.99 AND n_bad = 0 AS passes FROM p")
def gt10_pairing_gate(spark: SparkSession, folder: str) -> DataFrame:
    p = slices(spark, folder).groupBy("vendor").agg(F.countDistinct("patient").alias("n_patients"), F.corr("score_a", "score_b").alias("r"), F.count(F.when(F.col("score_a") < 0, 1)).alias("n_bad"))
    return p.select("vendor", "n_patients", F.round("r", 6).alias("r"), ((F.col("n_patients") >= 10) & (F.col("r") >= 0.99) & (F.col("n_bad") == 0)).alias("passes"))


@query(f"WITH {SLICES}, p AS (SELECT vendor, corr(psnr, cnr) AS r, count(*) FILTER (cnr < 1) AS bad FROM s GROUP BY vendor) SELECT vendor, CASE WHEN r > 0.9 AND bad = 0 THEN 'valid' WHEN r > 0.9 THEN 'violations' ELSE 'low correlation' END AS reason FROM p")
def gt27_pairing_verdict(spark: SparkSession, folder: str) -> DataFrame:
    p = slices(spark, folder).groupBy("vendor").agg(F.corr("psnr", "cnr").alias("r"), F.count(F.when(F.col("cnr") < 1, 1)).alias("bad"))
    return p.select("vendor", F.when((F.col("r") > 0.9) & (F.col("bad") == 0), "valid").when(F.col("r") > 0.9, "violations").otherwise("low correlation").alias("reason"))


@query(f"WITH {SLICES}, m AS (SELECT vendor, method, count(*) AS rois, avg(cnr) AS b, avg(psnr) AS q FROM s GROUP BY ALL), c AS (SELECT vendor, min(b) FILTER (method = 'Brand#1') AS b, min(q) FILTER (method = 'Brand#1') AS q, min(b) FILTER (method <> 'Brand#1') AS least, max(q) FILTER (method <> 'Brand#1') AS most, min(rois) AS rois FROM m GROUP BY vendor) SELECT vendor, rois >= 48 AS enough, coalesce(b < least, false) AS control_last, coalesce(q > most, false) AS control_smoothest FROM c")
def gt11_roi_protocol_gate(spark: SparkSession, folder: str) -> DataFrame:
    m = slices(spark, folder).groupBy("vendor", "method").agg(F.count("*").alias("rois"), F.avg("cnr").alias("b"), F.avg("psnr").alias("q"))
    own, other = F.col("method") == "Brand#1", F.col("method") != "Brand#1"
    c = m.groupBy("vendor").agg(F.min(F.when(own, F.col("b"))).alias("b"), F.min(F.when(own, F.col("q"))).alias("q"), F.min(F.when(other, F.col("b"))).alias("least"), F.max(F.when(other, F.col("q"))).alias("most"), F.min("rois").alias("rois"))
    no = F.lit(False)
    return c.select("vendor", (F.col("rois") >= 48).alias("enough"), F.coalesce(F.col("b") < F.col("least"), no).alias("control_last"), F.coalesce(F.col("q") > F.col("most"), no).alias("control_smoothest"))


@query(f"WITH {SLICES}, c AS (SELECT method, dose, avg(cnr) AS y FROM s GROUP BY ALL), p AS (SELECT *, lag(y) OVER (PARTITION BY method ORDER BY dose) AS y0 FROM c) SELECT method, count(*) AS n_doses, count(*) >= 3 AS covered, coalesce(bool_and(y > y0), false) AS rising FROM p GROUP BY method")
def gt12_dose_curve_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Three doses at least, and a curve that rises at every step."""
    c = slices(spark, folder).groupBy("method", "dose").agg(F.avg("cnr").alias("y"))
    p = c.withColumn("y0", F.lag("y").over(Window.partitionBy("method").orderBy("dose")))
    return p.groupBy("method").agg(F.count("*").alias("n_doses"), (F.count("*") >= 3).alias("covered"), F.coalesce(F.bool_and(F.col("y") > F.col("y0")), F.lit(False)).alias("rising"))


AUDIT = {"order": "low <= high", "inside": "mean BETWEEN low AND high", "verdict": "verdict = said", "size": "n >= 100 OR verdict <> 'PASS'"}
_CREDENTIALS = f"WITH {SLICES} SELECT vendor, n, mean, low, high, CASE WHEN low > -0.6 AND high < 0.6 THEN 'PASS' WHEN low > 0.6 OR high < -0.6 THEN 'FAIL' ELSE 'INDETERMINATE' END AS verdict, CASE WHEN n % 3 = 0 THEN 'PASS' ELSE 'INDETERMINATE' END AS said FROM (SELECT vendor, count(*) AS n, avg(score_a - score_b) AS mean, avg(score_a - score_b) - CASE WHEN count(*) % 5 = 0 THEN -1 ELSE 1 END * 1.96 * stddev_samp(score_a - score_b) / sqrt(count(*)) AS low, avg(score_a - score_b) + CASE WHEN count(*) % 5 = 0 THEN -1 ELSE 1 END * 1.96 * stddev_samp(score_a - score_b) / sqrt(count(*)) AS high FROM s GROUP BY vendor)"


@query(broken_sql(_CREDENTIALS, "vendor", AUDIT))
def gt15_credential_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Credentials re-checked: interval order, mean inside, verdict derived anew, size behind a pass."""
    from assayer.operators.preparation import equivalence_verdict

    d = F.col("score_a") - F.col("score_b")
    g = slices(spark, folder).groupBy("vendor").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    half = F.when(F.col("n") % 5 == 0, -1).otherwise(1) * 1.96 * F.col("sd") / F.sqrt("n")
    g = g.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half, "said": F.when(F.col("n") % 3 == 0, "PASS").otherwise("INDETERMINATE")})
    return violations(g.withColumn("verdict", equivalence_verdict(F.col("low"), F.col("high"), 0.6)), "vendor", AUDIT)


@query(f"WITH v AS (SELECT bundle, CASE WHEN bool_or(state = 'FAIL') THEN 'REJECT' WHEN bool_or(state = 'UNVERIFIED') THEN 'UNVERIFIED' ELSE 'ACCEPT' END AS decision, list_sort(list(DISTINCT state)) AS reasons FROM ({_STAGES}) GROUP BY bundle) SELECT decision, reasons, count(*) AS n FROM v GROUP BY ALL")
def gt22_package_decision(spark: SparkSession, folder: str) -> DataFrame:
    has = lambda s: F.bool_or(F.col("state") == s)
    v = _stages(spark, folder).groupBy("bundle").agg(F.when(has("FAIL"), "REJECT").when(has("UNVERIFIED"), "UNVERIFIED").otherwise("ACCEPT").alias("decision"), F.array_sort(F.collect_set("state")).alias("reasons"))
    return v.groupBy("decision", "reasons").agg(F.count("*").alias("n"))


SAVE = {**METADATA, "dated": "o_orderdate < TIMESTAMP '1999-01-01 00:00:00'"}


@query("WITH v AS (" + broken_sql("SELECT * FROM orders", "o_orderkey", SAVE) + ") SELECT rule, count(*) AS n, count(DISTINCT o_orderkey) AS n_objects FROM v GROUP BY rule")
def gt23_save_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Every gate's violations together, counted by rule."""
    return violations(table(spark, folder, "orders"), "o_orderkey", SAVE).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_objects"))


@query("WITH g AS (SELECT *, " + " AND ".join(f"coalesce({r}, false)" for r in METADATA.values()) + " AS ok FROM orders), a AS (SELECT o_custkey AS vendor, o_orderkey AS entry, o_totalprice AS v FROM g WHERE ok) SELECT vendor, entry, row_number() OVER (PARTITION BY vendor ORDER BY v DESC, entry) AS rank FROM a")
def gt24_add_submission(spark: SparkSession, folder: str) -> DataFrame:
    """Only submissions that pass every rule are appended; the board is ranked anew."""
    from assayer.operators.board import ranked

    o = table(spark, folder, "orders")
    for held in METADATA.values():
        o = o.where(F.coalesce(F.expr(held), F.lit(False)))
    return ranked(o.select(F.col("o_custkey").alias("vendor"), F.col("o_orderkey").alias("entry"), F.col("o_totalprice").alias("v")), ["v"], ["entry"], ["vendor"]).drop("v")


@query("WITH v AS (" + broken_sql("SELECT * FROM orders", "o_orderkey", METADATA) + "), m AS (SELECT DISTINCT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)) SELECT o_orderkey, count(rule) AS n_violations, CASE WHEN count(rule) > 0 THEN 'FAIL' WHEN bool_or(m.o_orderkey IS NOT NULL) THEN 'SKIPPED' ELSE 'PASS' END AS state FROM orders LEFT JOIN v USING (o_orderkey) LEFT JOIN m USING (o_orderkey) GROUP BY o_orderkey")
def gt17_claim_stage(spark: SparkSession, folder: str) -> DataFrame:
    """The gates of one submission composed; a missing artefact is skipped, not passed."""
    o = passes(table(spark, folder, "orders"), "o_orderkey", METADATA)
    there = table(spark, folder, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("there")).distinct()
    state = F.when(F.col("n_violations") > 0, "FAIL").when(F.col("there").isNull(), "SKIPPED").otherwise("PASS")
    return o.join(there, "o_orderkey", "left").select("o_orderkey", "n_violations", state.alias("state"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 1000 THEN 'updated' ELSE o_orderstatus END AS status FROM orders")
def gt26_status_update(spark: SparkSession, folder: str) -> DataFrame:
    """Sets the status of the rows in question that pass the rules, and of no other."""
    new = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 1000), "updated").otherwise(F.col("o_orderstatus"))
    return table(spark, folder, "orders").select("o_orderkey", new.alias("status"))
