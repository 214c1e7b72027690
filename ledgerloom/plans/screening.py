"""Screening and linkage: gates over notice rows, decisions, consensus, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates, link
from ..sources.publish import fingerprint  # noqa: F401  (part of the public surface)
from ..sources.tables import table
from .base import PHASES_SQL, lines, phases
from .registry import query

GATES = ["valid_key", "valid_quantity", "finished", "chronological", "in_years"]


def _notices(spark, d):
    """Line rows with their order, as gates see them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("odate"))
    rows = lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "ship").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return gates.with_gates(rows, {
        "valid_key": F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull(), "valid_quantity": F.col("l_quantity").between(1, 45), "finished": F.col("o_orderstatus") != "P",
        "chronological": F.col("ship") >= F.col("odate"), "in_years": F.col("odate").isNull() | F.col("odate").between("1995-06-01", "2001-06-30"),
    })


_NOTICES = """WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS ship, o_custkey, CAST(o_orderdate AS DATE) AS odate,
 l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AS valid_key, coalesce(l_quantity BETWEEN 1 AND 45, false) AS valid_quantity, coalesce(o_orderstatus <> 'P', false) AS finished,
 coalesce(CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE), false) AS chronological, coalesce(o_orderdate IS NULL OR CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2001-06-30', false) AS in_years
 FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, CASE WHEN NOT valid_key THEN 'valid_key' WHEN NOT valid_quantity THEN 'valid_quantity' WHEN NOT finished THEN 'finished' WHEN NOT chronological THEN 'chronological' WHEN NOT in_years THEN 'in_years' END AS first_failed FROM n)
"""
_AND = [" AND ".join(GATES[: i + 1]) for i in range(len(GATES))]


@query("funnel_gates", _NOTICES + " UNION ALL ".join(
    f"SELECT {i + 1} AS step, '{g}' AS gate, CAST(count(*) FILTER ({_AND[i - 1] if i else 'true'}) AS BIGINT) AS rows_before, CAST(count(*) FILTER ({_AND[i]}) AS BIGINT) AS rows_after,"
    f" count(DISTINCT l_orderkey) FILTER ({_AND[i - 1] if i else 'true'}) AS entities_before, count(DISTINCT l_orderkey) FILTER ({_AND[i]}) AS entities_after FROM g" for i, g in enumerate(GATES)))  # fmt: skip
def funnel_gates(spark, d):
    return gates.funnel(_notices(spark, d), GATES, "l_orderkey")


@query("decision_log", _NOTICES + "SELECT l_orderkey, l_linenumber, coalesce(first_failed, 'all') AS stage, CASE WHEN first_failed IS NULL THEN 'included' ELSE 'excluded' END AS decision, count(*) AS n FROM g GROUP BY ALL")
def decision_log(spark, d):
    rows = _notices(spark, d)
    decision = F.when(F.col("eligible"), "included").otherwise("excluded")
    return rows.groupBy("l_orderkey", "l_linenumber", F.coalesce("first_failed", F.lit("all")).alias("stage"), decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("first_and_all_reasons", _NOTICES + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (NOT {g}) AS n_all, count(*) FILTER (first_failed = '{g}') AS n_first FROM g" for g in GATES))
def first_and_all_reasons(spark, d):
    return gates.failures(_notices(spark, d), GATES)


@query("removed_rows", "SELECT l_returnflag, 'range' AS stage, 'excluded' AS decision, 'quantity beyond 40' AS reason, count(*) AS n FROM lineitem WHERE NOT coalesce(l_quantity <= 40, false) GROUP BY 1")
def removed_rows(spark, d):
    _, gone = gates.split(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), F.col("l_quantity") <= 40, "range", "quantity beyond 40")
    return gone.groupBy("l_returnflag", "stage", "decision", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_dates_kept", "SELECT count(*) AS n, count(*) FILTER (s IS NULL) AS unknown FROM (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS s FROM lineitem) WHERE s IS NULL OR s BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def unknown_dates_kept(spark, d):
    s = F.when(F.col("l_linenumber") != 3, F.col("ship"))
    rows = lines(spark, d).select(s.alias("s")).filter(F.col("s").isNull() | F.col("s").between("1996-01-01", "1998-12-31"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s").isNull()).alias("unknown"))


_SIDES = "WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 5)"


def _sides(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return a, table(spark, d, "lineitem").filter("l_quantity > 5").select(F.col("l_orderkey").alias("k"))


@query("key_linkage_indicator", _SIDES + " SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS match FROM a FULL JOIN b ON a.k = b.k")
def key_linkage_indicator(spark, d):
    return link.indicator(*_sides(spark, d), ["k"])


@query("linkage_counts", _SIDES + " SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS match, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def linkage_counts(spark, d):
    return link.indicator(*_sides(spark, d), ["k"]).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


@query("set_reconciliation", _SIDES + " SELECT k, 'left_only' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right_only' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def set_reconciliation(spark, d):
    return link.reconcile(*_sides(spark, d), "k")


def _keyed(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", "ship", "l_returnflag", "l_suppkey", F.when(F.col("l_tax") > 0.01, F.col("l_linestatus")).alias("status"))


_KEYED = "WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship, l_returnflag, l_suppkey, CASE WHEN l_tax > 0.01 THEN l_linestatus END AS status FROM lineitem)"
_ONE = "CASE WHEN count(DISTINCT {0}) = 1 THEN max({0}) END"


@query("consensus_fields", f"{_KEYED} SELECT l_orderkey, l_linenumber, {_ONE.format('ship')} AS ship, {_ONE.format('l_returnflag')} AS l_returnflag, {_ONE.format('status')} AS status, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ' | ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers FROM r GROUP BY 1, 2")
def consensus_fields(spark, d):
    return _keyed(spark, d).groupBy("l_orderkey", "l_linenumber").agg(*(link.consensus(c).alias(c) for c in ("ship", "l_returnflag", "status")), link.sorted_distinct("l_suppkey").alias("suppliers"))


@query("conflict_fields", f"{_KEYED} SELECT l_orderkey, l_linenumber, concat_ws(' | ', CASE WHEN count(DISTINCT ship) > 1 THEN 'ship' END, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT status) > 1 THEN 'status' END) AS conflicts FROM r GROUP BY 1, 2")
def conflict_fields(spark, d):
    return _keyed(spark, d).groupBy("l_orderkey", "l_linenumber").agg(link.conflicts(["ship", "l_returnflag", "status"]).alias("conflicts"))


@query("strict_boundary", f"{_KEYED} SELECT l_orderkey, CASE WHEN count(DISTINCT status) = 1 AND count(status) = count(*) THEN max(status) END AS status, CASE WHEN count(DISTINCT ship) = 1 THEN max(ship) END AS ship FROM r GROUP BY 1")
def strict_boundary(spark, d):
    return _keyed(spark, d).groupBy("l_orderkey").agg(link.strict("status").alias("status"), link.strict("ship").alias("ship"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("stage_labels_in_order", "SELECT o_custkey, string_agg(s, ' || ' ORDER BY p) AS statuses FROM (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS p FROM orders GROUP BY 1, 2) GROUP BY 1")
def stage_labels_in_order(spark, d):
    firsts = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("p"))
    return firsts.groupBy("o_custkey").agg(link.in_order(F.col("o_orderstatus"), F.col("p")).alias("statuses"))


@query("any_all_flags", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'O') AS all_open FROM lineitem GROUP BY 1")
def any_all_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "O").alias("all_open"))


@query("pending_queue", "SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY d.n_chars, d.doc_id LIMIT 50")
def pending_queue(spark, d):
    docs, done = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id")
    return docs.join(done, "doc_id", "left_anti").orderBy("n_chars", "doc_id").limit(50)


@query("semi_by_id_set", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_by_id_set(spark, d):
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(poor, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("restricted_lookup", "SELECT a.l_orderkey, a.l_linenumber, round(sum(a.l_extendedprice), 2) AS amount FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'A') a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_quantity >= 40) GROUP BY 1, 2")
def restricted_lookup(spark, d):
    li = table(spark, d, "lineitem")
    kept = li.filter("l_quantity >= 40").select("l_orderkey", "l_linenumber").distinct()
    return li.filter("l_returnflag = 'A'").join(kept, ["l_orderkey", "l_linenumber"], "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(F.round("l_extendedprice", 2)), 2).alias("amount"))


@query("source_precedence", "SELECT o_orderkey, coalesce(s.v, c.v, o_totalprice) AS value, CASE WHEN s.v IS NOT NULL THEN 'state' WHEN c.v IS NOT NULL THEN 'table' ELSE 'sheet' END AS origin FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON s.k = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, min(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) c ON c.k = o_orderkey")
def source_precedence(spark, d):
    li = table(spark, d, "lineitem")
    s = li.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("sv"))
    c = li.filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_extendedprice").alias("cv"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(s, "o_orderkey", "left").join(c, "o_orderkey", "left")
    origin = F.when(F.col("sv").isNotNull(), "state").when(F.col("cv").isNotNull(), "table").otherwise("sheet")
    return rows.select("o_orderkey", F.coalesce("sv", "cv", "o_totalprice").alias("value"), origin.alias("origin"))


_CHECKS = {"positive_first": "t1 > 0", "positive_last": "t3 > 0", "non_negative_middle": "t2 >= 0", "quantity_present": "q IS NOT NULL AND q >= 0", "short_total": "t1 + t2 + t3 <= 1500"}


@query("contract_checks", f"WITH {PHASES_SQL} " + " UNION ALL ".join(f" SELECT '{k}' AS \"check\", count(*) FILTER (NOT coalesce({c}, false)) AS failures, CASE WHEN count(*) FILTER (NOT coalesce({c}, false)) = 0 THEN 'pass' ELSE 'fail' END AS status FROM phases" for k, c in _CHECKS.items()))
def contract_checks(spark, d):
    return gates.checks(phases(spark, d), {k: F.expr(c) for k, c in _CHECKS.items()})


@query("column_inventory", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({e}) AS missing FROM lineitem" for c, e in (("l_quantity", "nullif(l_quantity, 17)"), ("l_tax", "nullif(l_tax, 0)"), ("l_returnflag", "nullif(l_returnflag, 'N')"), ("l_shipdate", "l_shipdate"))))
def column_inventory(spark, d):
    df = table(spark, d, "lineitem").select(F.nullif(F.col("l_quantity"), F.lit(17.0)).alias("l_quantity"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("l_returnflag"), "l_shipdate")
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.unpivot(["n"], df.columns, "column_name", "missing").select("column_name", "n", "missing")


@query("row_fingerprint", "SELECT n_nationkey, sha256(concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS fingerprint FROM nation")
def row_fingerprint(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 256).alias("fingerprint"))


@query("allowed_categories", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') GROUP BY 1")
def allowed_categories(spark, d):
    allowed = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("HOUSEHOLD",)], "c_mktsegment string")
    return table(spark, d, "customer").join(F.broadcast(allowed), "c_mktsegment", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("formula_escape", "SELECT doc_id, CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END AS v FROM (SELECT doc_id, CASE CAST(doc_id AS INTEGER) % 4 WHEN 0 THEN '=1+1' WHEN 1 THEN '@name' WHEN 2 THEN '-5' ELSE 'plain' END AS v FROM documents)")
def formula_escape(spark, d):
    v = F.when(F.col("doc_id") % 4 == 0, "=1+1").when(F.col("doc_id") % 4 == 1, "@name").when(F.col("doc_id") % 4 == 2, "-5").otherwise("plain")
    return table(spark, d, "documents").select("doc_id", T.escaped(v).alias("v"))


_CHECKED = "SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


@query("checked_join", _CHECKED)
def checked_join(spark, d):
    """Orders with their customers, many to one, and these with their nations; both joins are checked as they run: no key twice on the right, none on the left without its row."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    both = link.checked_join(orders, customers, ["o_custkey"], most=(0, 1))
    return link.checked_join(both, nations, ["c_nationkey"], most=(0, 1)).select("o_orderkey", "o_custkey", "c_mktsegment", "n_name")


_FAULTS = "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS a FROM lineitem GROUP BY ALL), o AS (SELECT o_orderkey AS k, 1 AS n, count(*) AS b FROM orders GROUP BY ALL), j AS (SELECT coalesce(l.k, o.k) AS order_key, coalesce(l.n, o.n) AS line, coalesce(a, 0) AS left_rows, coalesce(b, 0) AS right_rows FROM l FULL JOIN o ON l.k = o.k AND l.n = o.n) SELECT *, 'left_repeated' AS fault FROM j WHERE left_rows > 1 UNION ALL SELECT *, 'unmatched' FROM j WHERE left_rows > 0 AND right_rows = 0"


@query("join_faults", _FAULTS)
def join_faults(spark, d):
    """What a one-to-one join of lines to the first line that each order should have would break: repeated lines, and lines that aren't the first."""
    lines_ = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"))
    firsts = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.lit(1).alias("line"))
    return link.join_faults(lines_, firsts, ["order_key", "line"])
