"""Text plans: normal forms, rule evidence, record completeness, document decisions, nested data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ladder import judge
from ..operators.rules import RULES, classify, evidence
from ..operators.scope import classify_scope
from ..sources.tables import table
from .registry import query

_UP = "trim(regexp_replace(replace(upper(strip_accents(coalesce({0}, ''))), 'ẞ', 'SS'), '\\s+', ' ', 'g'))"
_LOW = "trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '\\s+', ' ', 'g'))"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


@query("text_normalise", f"SELECT doc_id, md5({_UP.format('text')}) AS upper_md5, md5({_LOW.format('text')}) AS lower_md5, md5(regexp_replace({_LOW.format('text')}, '[^a-z0-9]', '', 'g')) AS compact_md5 FROM documents")
def text_normalise(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", *(F.md5(e.cast("binary")).alias(n) for n, e in (("upper_md5", T.upper_norm(c)), ("lower_md5", T.lower_norm(c)), ("compact_md5", T.compact(c)))))


@query("identifiers", "SELECT doc_id, nullif(regexp_replace(trim(v), '^(\\d+)\\.0+$', '\\1'), '') AS key FROM (SELECT doc_id, CASE CAST(doc_id AS INTEGER) % 5 WHEN 0 THEN CAST(doc_id AS VARCHAR) || '.0' WHEN 1 THEN '00' || CAST(doc_id AS VARCHAR) WHEN 2 THEN ' ' || CAST(doc_id AS VARCHAR) || '.00 ' WHEN 3 THEN NULL ELSE '  ' END AS v FROM documents)")
def identifiers(spark, d):
    i = F.col("doc_id").cast("string")
    v = F.when(F.col("doc_id") % 5 == 0, F.concat(i, F.lit(".0"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("00"), i)).when(F.col("doc_id") % 5 == 2, F.concat(F.lit(" "), i, F.lit(".00 "))).when(F.col("doc_id") % 5 == 4, "  ")
    return _docs(spark, d).select("doc_id", T.key(v).alias("key"))


_EVID = ", ".join(f"('{r.family}', '{r.name}', '{r.pattern}')" for r in RULES)
_RULES_SQL = f"WITH n AS (SELECT doc_id, {_UP.format('text')} AS t FROM documents), r(family, rule, pattern) AS (VALUES {_EVID}), e AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r.family}' AS family, '{r.name}' AS rule, unnest(regexp_extract_all(t, '{r.pattern}')) AS hit FROM n" for r in RULES) + ") "


@query("rule_evidence", f"{_RULES_SQL} SELECT doc_id, family, rule, count(*) AS hits, min(hit) AS first_hit FROM e GROUP BY 1, 2, 3")
def rule_evidence(spark, d):
    return evidence(_docs(spark, d), "doc_id", "text").groupBy("doc_id", "family", "rule").agg(F.count(F.lit(1)).alias("hits"), F.min("hit").alias("first_hit"))


@query("classify_documents", f"{_RULES_SQL}, s AS (SELECT doc_id, bool_or(family = 'positive') AS pos, bool_or(family = 'negative') AS neg, bool_or(family = 'boundary') AS bound, string_agg(DISTINCT rule, ' | ' ORDER BY rule) AS rules, string_agg(DISTINCT hit, ' | ' ORDER BY hit) AS hits FROM e GROUP BY 1) SELECT d.doc_id, CASE WHEN coalesce(bound, false) AND NOT coalesce(pos, false) THEN 'excluded' WHEN coalesce(bound, false) THEN 'unresolved' WHEN coalesce(pos, false) AND NOT coalesce(neg, false) THEN 'included' WHEN coalesce(neg, false) AND NOT coalesce(pos, false) THEN 'excluded' ELSE 'unresolved' END AS decision, coalesce(rules, '') AS rules, coalesce(hits, '') AS hits FROM documents d LEFT JOIN s USING (doc_id)")
def classify_documents(spark, d):
    return classify(_docs(spark, d), "doc_id", "text").select("doc_id", "decision", "rules", "hits")


#: Descriptions of orders: what is done (by priority), to what (by the part with which the order is largest) and where (by the customer's segment). With each asset goes what its words are evidence of.
_WORK = {"1-URGENT": "Rehabilitación", "2-HIGH": "Mejoramiento", "3-MEDIUM": "CREACIÓN", "4-NOT SPECIFIED": "construccion", "5-LOW": "Renovación"}
_ASSETS = [
    ("carretera", "road", "carretera"), ("paso  a desnivel", "road", "paso a desnivel"), ("pistas y veredas", "road", "pistas"), ("veredas peatonales", "on_foot", ""), ("pista de aterrizaje", "airport", "pista"),
    ("institución educativa", "other", "institucion educativa"), ("carretera y agua potable", "mixed", "carretera"), ("pista de atletismo", "other", "pista de atletismo"), ("intervención general", "nothing", ""),
    ("camino vecinal y drenaje pluvial", "road", "camino vecinal"), ("calzada con acceso a la escuela", "road", "calzada"), ("pavimento y colegios", "mixed", "pavimento"), ("trocha carrozable con acceso al colegio", "road", "trocha carrozable"), ("autopista y aeródromo", "airport_and_road", "autopista"),
]
_PLACE = {"BUILDING": " del distrito de Puente Carretera", "MACHINERY": " ubicado en la carretera central", "HOUSEHOLD": "", "FURNITURE": " - calle del cementerio", "AUTOMOBILE": " en los distritos de Pistas"}


def _descriptions(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda c, values: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in values.items()))
    asset = F.element_at(F.array(*(F.lit(a) for a, *_ in _ASSETS)), (F.pmod(F.year("o_orderdate") + F.month("o_orderdate"), F.lit(len(_ASSETS))) + 1).cast("int"))
    return o.select("o_orderkey", F.concat(pick("o_orderpriority", _WORK), F.lit(" de "), asset, pick("c_mktsegment", _PLACE)).alias("procedure"), F.lit(None).cast("string").alias("item"))


def _scope_sql() -> str:
    """The decision follows from the asset. An address on a road (MACHINERY) is no evidence of one, but leaves open whether walkers alone are served."""
    from ..operators.scope import REASONS as why

    rows = ", ".join(f"({i}, '{a}', '{why[k][0]}', '{why[k][1]}', '{hit.upper()}')" for i, (a, k, hit) in enumerate(_ASSETS))
    work = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {len(v) + 4}" for k, v in _WORK.items()) + " END"
    foot, none = why["on_foot"][1], why["nothing"]
    seen = f"c_mktsegment = 'MACHINERY' AND reason = '{foot}'"
    return f"WITH a(i, asset, decision, reason, hit) AS (VALUES {rows}) SELECT o_orderkey, CASE WHEN {seen} THEN '{none[0]}' ELSE decision END AS decision, CASE WHEN {seen} THEN '{none[1]}' ELSE reason END AS reason, CASE WHEN hit <> '' THEN {work} + strpos(upper(strip_accents(replace(asset, '  ', ' '))), hit) END AS first_start, nullif(hit, '') AS first_hit FROM orders JOIN customer ON c_custkey = o_custkey JOIN a ON a.i = (year(o_orderdate) + month(o_orderdate)) % {len(_ASSETS)}"


@query("scope_decision", _scope_sql())
def scope_decision(spark, d):
    """The decision on each order's description with the evidence that comes first in the text."""
    out = classify_scope(_descriptions(spark, d), "procedure", "item")
    first = F.array_min(F.transform("evidence", lambda e: F.struct(e["start"].alias("start"), (-e["stop"]).alias("stop"), e["hit"].alias("hit"))))
    return out.select("o_orderkey", "decision", "reason", first["start"].alias("first_start"), first["hit"].alias("first_hit"))


_CONV = "WITH c AS (SELECT conv_id, turn + 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)"


@query("record_completeness", f"{_CONV} SELECT conv_id, count(*) AS records, max(n) AS largest, bool_and(n = rn) AS complete FROM c GROUP BY 1")
def record_completeness(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rn"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("records"), F.max("n").alias("largest"), F.bool_and(F.col("n") == F.col("rn")).alias("complete"))


@query("missing_numbers", f"{_CONV}, g AS (SELECT conv_id, list(n) AS ns, max(n) AS top FROM c GROUP BY 1) SELECT conv_id, coalesce(array_to_string(list_sort(list_filter(range(1, top + 1), lambda x: NOT list_contains(ns, x))), ','), '') AS missing FROM g")
def missing_numbers(spark, d):
    """Numbers that a conversation lacks below its largest; as the rule has it, the first 200 of them and none where the largest is over 100,000."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set((F.col("turn") + 1).cast("int")).alias("found"))
    return c.select("conv_id", F.array_join(T.missing_numbers(F.col("found")), ",").alias("missing"))


@query("evidence_pages", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) SELECT doc_id, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS pages FROM p WHERE regexp_matches(lower(page), 'license|rights reserved|@') GROUP BY 1")
def evidence_pages(spark, d):
    pages = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "page")).filter(F.lower("page").rlike("license|rights reserved|@"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("no") + 1)), lambda x: x.cast("string")), ",").alias("pages"))


_KINDS = 9
#: Documents made of conversations, a page a turn, in the forms that the ladder tells apart: by conv_id % 9 they differ in title, absence statement and numbers.
_TITLE = {0: "Acta de no formulación de CONSULTAS y/o observaciones", 2: "Pliego de absolución de consultas y observaciones. No se presentaron ninguna consultas ni observaciones", 3: "No se han recibido consultas y observaciones", 4: "Relación de consultas", 7: "x", 8: "Un documento de otra clase, sin registros ni declaración alguna"}
_LIST = "PLIEGO de absolución de  consultas y observaciones"


def _forms(spark, d):
    """conv_id and pages of each conversation."""
    k, n = F.col("conv_id") % _KINDS, F.col("turn") + 1
    number = F.when(k == 5, 2 * n + 1).when(k == 6, n + 100_000).otherwise(n).cast("string")
    heading = F.when(k == 4, F.concat(F.lit("Consulta: Nro. "), number, F.lit("\n"))).otherwise(F.concat(F.lit("Nro. "), number, F.lit("\n Consulta / OBSERVACIÓN: ")))
    page = F.when(k.isin(1, 3, 4, 5, 6), F.concat(heading, F.coalesce("text", F.lit("")))).when(k == 8, F.col("text"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("page")))).alias("t"))
    title = F.coalesce(*(F.when(F.col("conv_id") % _KINDS == i, F.lit(t)) for i, t in _TITLE.items()), F.lit(_LIST))
    return turns.select("conv_id", F.concat(F.array(title), F.array_compact(F.transform("t", lambda x: x["page"]))).alias("pages"))


_DECISION = {0: ("OK", "HIGH", "0"), 1: ("OK", "HIGH", "n"), 2: ("CONTRADICTORY_EVIDENCE", "LOW", "NULL"), 3: ("CONTRADICTORY_EVIDENCE", "LOW", "NULL"), 4: ("DOCUMENT_TYPE_UNCONFIRMED", "LOW", "NULL"), 5: ("NUMBERING_UNRESOLVED", "LOW", "NULL"), 6: ("NUMBERING_UNRESOLVED", "LOW", "NULL"), 7: ("INSUFFICIENT_TEXT", "LOW", "NULL"), 8: ("NO_RECORDS_DETECTED", "LOW", "NULL")}
_case = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {v[i] if i == 2 else repr(v[i])}" for k, v in _DECISION.items()) + " END"


@query("document_decision", f"WITH c AS (SELECT conv_id, conv_id % {_KINDS} AS k, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, CAST({_case(2)} AS INTEGER) AS total, {_case(0)} AS status, {_case(1)} AS confidence, CAST(CASE WHEN k IN (1, 3, 4, 5, 6) THEN n ELSE 0 END AS INTEGER) AS headings, CASE k WHEN 1 THEN n WHEN 3 THEN n WHEN 4 THEN n WHEN 5 THEN 2 * n + 1 WHEN 6 THEN 100000 + n END AS largest, coalesce(CASE WHEN k = 5 THEN array_to_string(list_filter(range(1, 2 * n + 1), lambda x: x = 1 OR x % 2 = 0)[1:200], ',') END, '') AS missing, coalesce(CASE WHEN k IN (1, 4, 5, 6) THEN array_to_string(range(2, n + 2), ',') WHEN k = 3 THEN array_to_string(range(1, n + 2), ',') WHEN k IN (0, 2) THEN '1' END, '') AS evidence_pages FROM c")
def document_decision(spark, d):
    """Counts of numbered records in documents made of conversations, whose right answer follows from how they are made."""
    return judge(_forms(spark, d), "pages").select("conv_id", "total", "status", "confidence", "headings", "largest", "missing", "evidence_pages")


@query("date_tokens", "WITH t AS (SELECT o_orderkey, 'from ' || strftime(o_orderdate, '%-d/%-m/%Y') || ' 10:30 to ' || strftime(o_orderdate + INTERVAL 9 DAY, '%-d/%-m/%Y') AS s FROM orders) SELECT o_orderkey, len(regexp_extract_all(s, '\\d{1,2}/\\d{1,2}/\\d{4}')) AS dates, CAST(try_strptime(regexp_extract_all(s, '\\d{1,2}/\\d{1,2}/\\d{4}')[1], '%d/%m/%Y') AS DATE) AS first_date, CAST(CAST(try_strptime(regexp_extract_all(s, '\\d{1,2}/\\d{1,2}/\\d{4}')[2], '%d/%m/%Y') AS DATE) - CAST(try_strptime(regexp_extract_all(s, '\\d{1,2}/\\d{1,2}/\\d{4}')[1], '%d/%m/%Y') AS DATE) AS INTEGER) AS days FROM t")
def date_tokens(spark, d):
    o = table(spark, d, "orders")
    s = F.concat(F.lit("from "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" 10:30 to "), F.date_format(F.date_add(F.to_date("o_orderdate"), 9), "d/M/yyyy"))
    t = o.select("o_orderkey", F.regexp_extract_all(s, F.lit(r"\d{1,2}/\d{1,2}/\d{4}"), F.lit(0)).alias("tokens"))
    a, b = T.day(F.col("tokens")[0]), T.day(F.col("tokens")[1])
    return t.select("o_orderkey", F.size("tokens").cast("bigint").alias("dates"), a.alias("first_date"), F.datediff(b, a).alias("days"))


@query("json_flatten", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, count(*) AS n FROM events GROUP BY 1, 2")
def json_flatten(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_type", F.col("p.k").alias("props_k")).groupBy("event_type", "props_k").agg(F.count(F.lit(1)).alias("n"))


@query("list_items", "WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)) AS item FROM pages) SELECT page_id, count(*) AS items, min(item) AS smallest FROM p GROUP BY 1")
def list_items(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))).alias("item"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("items"), F.min("item").alias("smallest"))


_PROJ = "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CUI ' || CAST(1000000 + o_orderkey // 10 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN 'CUI 1234567 and CUI 7654321' ELSE 'none' END AS s, o_custkey, o_orderpriority FROM orders)"


@query("project_id", _PROJ + " SELECT o_orderkey, CASE WHEN len(list_distinct(regexp_extract_all(s, 'CUI (\\d{7})', 1))) = 1 THEN 'cui:' || regexp_extract(s, 'CUI (\\d{7})', 1) ELSE 'text:' || substr(sha256(CAST(o_custkey AS VARCHAR) || '|' || lower(o_orderpriority)), 1, 24) END AS project FROM p")
def project_id(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("CUI "), (1000000 + F.floor(k / 10)).cast("string"))).when(k % 3 == 1, "CUI 1234567 and CUI 7654321").otherwise("none")
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(r"CUI (\d{7})"), F.lit(1)))
    described = F.concat(F.lit("text:"), F.substring(F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), F.lower("o_orderpriority")), 256), 1, 24))
    return table(spark, d, "orders").select("o_orderkey", F.when(F.size(found) == 1, F.concat(F.lit("cui:"), found[0])).otherwise(described).alias("project"))
