"""What a document's numbered records say: how many there are, or why that can't be told.

A document is an array of pages. Records carry headings with a number; a form's own heading
goes before a number that a line only names. A verified count needs headings that run 1, 2,
3 .. without gap, restart or repetition under a confirmed title; a verified zero needs a
statement of absence and no record. All else is told apart by a status and a reason.

Null pages count as empty ones, and a null or empty array as a text of nothing. Numbers
beyond 64 bits count as the largest there is, which no sequence reaches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Forms:
    """Patterns of headings (over the text as it is; group 1 is the number) and of absence (over normal lower-case text), and the title that confirms a list of records."""

    own: str
    named: str
    absent: tuple[str, ...]
    title: str


# Headings, statements and the title of the forms that are counted.
CONSULTATIONS = Forms(
    own=r"(?imU)^\s*Nro\.?\s*(\d+)\s*\n\s*Consulta\s*/\s*Observaci[oó]n\s*:",
    named=r"(?imU)^\s*(?:consulta|observaci[oó]n)\s*:\s*(?:nro\.?|n[°ºo.]|n[uú]mero)\s*:?\s*(\d+)\s*$",
    absent=(
        r"\bno\s+se\s+(?:han\s+)?(?:formulado|formularon|registrado|registraron|presentado|presentaron|recibido|recibieron)\s+(?:(?:la\s+)?formulacion(?:es)?\s+de\s+)?(?:las\s+|ninguna\s+|ningunas\s+)?consultas?\s*(?:y\s*/\s*o|y/o|ni|y|u|o)\s*observaciones?\b",
        r"\bacta\s+de\s+no\s+formulacion\s+de\s+consultas?\s*(?:y/o|y|ni|o)\s*observaciones?\b",
    ),
    title="pliego de absolucion de consultas y observaciones",
)
#: Fewest characters of a text that can be judged, largest number that a record may have, and missing numbers that are listed.
THIN, MOST, SHOWN = 50, 100_000, 200
# Statuses, with the reasons that lead to them in the order in which they are asked.
REASONS = {
    "both": ("CONTRADICTORY_EVIDENCE", "an absence statement and numbered records"),
    "titled": ("CONTRADICTORY_EVIDENCE", "an absence statement under the title of a list"),
    "absent": ("OK", "an absence statement"),
    "thin": ("INSUFFICIENT_TEXT", "too little text"),
    "implausible": ("NUMBERING_UNRESOLVED", "implausible numbers"),
    "untitled": ("DOCUMENT_TYPE_UNCONFIRMED", "numbered records without a confirmed title"),
    "complete": ("OK", "records run from 1 without gap or repetition"),
    "broken": ("NUMBERING_UNRESOLVED", "gaps, restarts, repetitions or another order"),
    "nothing": ("NO_RECORDS_DETECTED", "no record and no absence statement"),
}


def numbers(text: Column, forms: Forms) -> Column:
    """Numbers of the records' headings in order: the form's own if there is one, else those that lines name."""
    own = T.numbers_in(text, forms.own)
    return F.when(F.size(own) > 0, own).otherwise(T.numbers_in(text, forms.named))


def absent(normal: Column, forms: Forms) -> Column:
    return normal.rlike("|".join(f"(?:{p})" for p in forms.absent))


def judge(df: DataFrame, pages: str, forms: Forms = CONSULTATIONS) -> DataFrame:
    """df with total (null unless verified), status, confidence, reason, headings, distinct, largest, missing (numbers, comma-joined) and evidence_pages (from 1, comma-joined)."""
    clean = F.transform(F.coalesce(F.col(pages), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    out = df.withColumn("_pages", clean).withColumn("_text", F.array_join("_pages", "\n"))
    out = out.withColumn("_normal", T.lower_norm(F.col("_text"))).withColumns({"_numbers": numbers(F.col("_text"), forms), "_absent": absent(F.col("_normal"), forms), "_titled": F.contains("_normal", F.lit(forms.title))})
    found, zero, titled = F.col("_numbers"), F.col("_absent"), F.col("_titled")
    n, some = F.size(found), F.size(found) > 0
    asked = {
        "both": zero & some, "titled": zero & titled, "absent": zero, "thin": F.length(T.squeeze(F.col("_text"))) < THIN,
        "implausible": some & ((n > MOST) | (F.array_max(found) > MOST)), "untitled": some & ~titled,
        "complete": some & (found == F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long"))), "broken": some, "nothing": F.lit(True),
    }
    out = out.withColumn("_why", F.coalesce(*(F.when(c, F.lit(k)) for k, c in asked.items())))
    pick = lambda i: F.coalesce(*(F.when(F.col("_why") == k, F.lit(v[i])) for k, v in REASONS.items()))
    pages_ = F.transform("_pages", lambda p, i: F.when((F.size(numbers(p, forms)) > 0) | absent(T.lower_norm(p), forms), i + 1))
    sure = F.col("_why").isin("absent", "complete")
    return out.withColumns({
        "total": F.when(F.col("_why") == "complete", n).when(F.col("_why") == "absent", 0), "status": pick(0), "confidence": F.when(sure, "HIGH").otherwise("LOW"), "reason": pick(1),
        "headings": n, "distinct": F.size(F.array_distinct(found)), "largest": F.array_max(found), "missing": F.when(some, F.coalesce(F.array_join(T.missing_numbers(found, MOST, SHOWN), ","), F.lit(""))).otherwise(""),
        "evidence_pages": F.array_join(F.array_compact(pages_), ","),
    }).drop("_pages", "_text", "_normal", "_numbers", "_absent", "_titled", "_why")
