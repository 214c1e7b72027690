"""Normal forms, spans and masks, the scope of descriptions, and the ladder of documents."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import ladder
from ledgerloom.operators.scope import classify_scope


def one(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def folded(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


TEXTS = ["plain", "", "ő ş Ñandú à", "ﬁ ﬃ ½ ㎏ ㍿ ﷺ", "Ｆｕｌｌ　ｗｉｄｔｈ", "ạ́ ̣́o ẛ̣", "한국어 값 가 힣", "日本語 ガ ｶﾞ", "𝔸𝟘 🙂", "اً ﻻ", "[a|b] (c) \\d $1", "İ K ß ẞ ǅ", "x\x1cy\x85z   "]


def test_folding_is_that_of_the_unicode_tables(spark):
    every = "".join(map(chr, [*range(0x80, 0x3400), *range(0xA000, 0xD7A4), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]))
    assert one(spark, [*TEXTS, every], T.fold) == list(map(folded, [*TEXTS, every]))
    assert one(spark, [None], T.fold) == [None]


def test_normal_forms(spark):
    texts = [*TEXTS, "  Señor\t\n  ÁRBOL ", None]
    assert one(spark, texts, T.upper_norm) == [" ".join(folded(t or "").upper().split()) for t in texts]
    low = [re.sub(r"\s+", " ", folded((t or "").lower())).strip() for t in texts]
    assert one(spark, texts, T.lower_norm) == low
    assert one(spark, texts, T.compact) == [re.sub("[^a-z0-9]", "", x) for x in low]


@pytest.mark.parametrize("pattern", [r"\bab?\b", r"(?<!\w)I\s*\.\s*E(?=\s|\.|$)", "🙂|é+", "aa"])
def test_hits_have_their_places(spark, pattern):
    texts = ["", "ab a xab ab", "I.E. xI.E I . E.", "é🙂éé a", "aaaaa", "nothing"]
    got = one(spark, texts, lambda c: T.hits(c, pattern))
    assert [[tuple(h) for h in g] for g in got] == [[(m.start() + 1, m.group()) for m in re.finditer(pattern, t)] for t in texts]
    blotted = [re.sub(pattern, lambda m: re.sub(r"\S", "_", m.group()), t) for t in texts]
    assert one(spark, texts, lambda c: T.masked(c, pattern)) == blotted


def decide(spark, *rows):
    df = spark.createDataFrame(rows, "a string, b string")
    return [(r["decision"], r["rules"], [tuple(e) for e in r["evidence"]]) for r in classify_scope(df, "a", "b").collect()]


# Descriptions and the decisions they are to get.
PHRASES = [
    ("REHABILITACION DE CARRETERA", "included"), ("CONSTRUCCION DE PUENTE VEHICULAR", "included"), ("MEJORAMIENTO DE CALLE DEL CEMENTERIO", "included"), ("CONSTRUCCION DE PISTAS Y VEREDAS", "included"),
    ("CONSTRUCCION DE VEREDAS PEATONALES", "excluded"), ("CONSTRUCCION DE PISTA DE ATERRIZAJE", "excluded"), ("CONSTRUCCION DE INSTITUCION EDUCATIVA", "excluded"), ("MEJORAMIENTO DE CARRETERA Y AGUA POTABLE", "unresolved"), ("INTERVENCION GENERAL", "unresolved"),
]


#: Descriptions whose context decides.
CONTEXTS = [
    ("PISTAS CON ACCESO A LA ESCUELA", "included"),  # a road that leads to it
    ("CARRETERA DE ACCESO AL COLEGIO", "included"),
    ("CARRETERA Y COLEGIO", "unresolved"),
    ("COLEGIO UBICADO EN LA CARRETERA CENTRAL", "excluded"),  # an address is no road
    ("COLEGIO DEL DISTRITO DE CARRETERA", "excluded"),  # nor is a district's name
    ("MEJORAMIENTO DE CALLES DE LA LOCALIDAD DE CALZADA", "included"),
    ("PISTAS DE LA CALLE MEJORAMIENTO DEL HOSPITAL", "included"),  # a street of that name
    ("PISTAS Y MEJORAMIENTO DEL HOSPITAL", "unresolved"),
    ("TRANSITABILIDAD DE LA PLAZA DE ARMAS", "included"),
    ("PLAZA DE ARMAS", "excluded"),
    ("CARRETERA CON DRENAJE PLUVIAL", "included"),
    ("DRENAJE PLUVIAL", "excluded"),
    ("AUTOPISTA Y AERODROMO", "unresolved"),
    ("I.E. N 20 Y PISTAS", "unresolved"),
    ("PISTAS DE LA CARRETERA XI. E", "included"),  # letters before the initials
    ("", "unresolved"),
]


def test_decisions(spark):
    """The phrases in either field, in lower case, with marks and more blanks, too."""
    odd = [(None, p.lower().replace("cion", "ción").replace(" ", "  ")) for p, _ in PHRASES]
    got = decide(spark, *((p, "") for p, _ in PHRASES), *odd, *((p, None) for p, _ in CONTEXTS), ("Mejoramiento de pista de atletismo y carretera a Piura", None))
    assert [(d[0]) for d in got] == [d for _, d in [*PHRASES, *PHRASES, *CONTEXTS, (0, "unresolved")]]
    # Evidence keeps its place behind masks.
    text = "MEJORAMIENTO DE PISTA DE ATLETISMO Y CARRETERA A PIURA"
    assert {(r, text[a - 1 : b]) for _, r, a, b, _ in got[-1][2]} == {("R01_road_network", "CARRETERA"), ("N23_sports_assets", "PISTA DE ATLETISMO")}


LIST = "Pliego de absolución de consultas y observaciones"
NONE = "No se han presentado  consultas y/u observaciones"
ITEM = "Nro. {}\n Consulta / Observación: texto"


def judged(spark, *documents):
    df = spark.createDataFrame([(i, list(p) if p is not None else None) for i, p in enumerate(documents)], "i int, pages array<string>")
    return [(r["total"], r["status"], r["reason"], r["missing"], r["evidence_pages"]) for r in ladder.judge(df, "pages").orderBy("i").collect()]


def test_each_rung(spark):
    items = lambda *ns: [ITEM.format(n) for n in ns]
    absent = "Acta de no formulación de consultas y observaciones"
    want = ladder.REASONS
    cases = [
        ([absent, *items(1)], "both", None, "", "1,2"), ([LIST, absent + " x" * 20], "titled", None, "", "2"), ([absent], "absent", 0, "", "1"), (["short"], "thin", None, "", ""), (None, "thin", None, "", ""), ([None, ""], "thin", None, "", ""),
        ([LIST, *items(1, 100_001)], "implausible", None, "", "2,3"), ([LIST, *items("9" * 30)], "implausible", None, "", "2"), (["x " * 40, *items(1, 2)], "untitled", None, "", "2,3"), ([LIST, *items(1, 2, 3)], "complete", 3, "", "2,3,4"),
        ([LIST, *items(1, 4)], "broken", None, "2,3", "2,3"), ([LIST, *items(1, 2, 1, 2)], "broken", None, "", "2,3,4,5"), ([LIST, *items(2, 1)], "broken", None, "", "2,3"), (["x " * 40], "nothing", None, "", ""),
        # A form's heading goes before a number that a line names; without one the line counts.
        ([LIST, *items(1), "Consulta: Nro. 7"], "complete", 1, "", "2,3"), ([LIST, "consulta : n° 1", "OBSERVACIÓN: número: 2"], "complete", 2, "", "2,3"),
        ([LIST, "wie in Consulta: Nro. 7 gesagt"], "nothing", None, "", ""),
    ]
    got = judged(spark, *(c[0] for c in cases))
    assert got == [(total, *want[why], missing, pages) for _, why, total, missing, pages in cases]
    assert {c[1] for c in cases} == set(want)
