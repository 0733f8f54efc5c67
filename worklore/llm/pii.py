"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

All expressions are Catalyst built-ins. Edge cases: null text counts as empty; empty text has no spans; null ids,
repeated rows and other columns pass through unchanged; work per row is bounded by the row's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm.common import fresh_name, joined, let, matches, table

# Possessive forms keep the engine from recursing on long runs; look-behinds start a match at the start of its run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn")

#: score without context; score gained from a context word within CONTEXT_CHARS before the span
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5)}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|address",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|master|amex|credit|debit|payment",
    "phone": r"(?i)phone|tel|call|mobile|fax",
    "iban": r"(?i)iban|account|bank|transfer",
    "ssn": r"(?i)ssn|social security|taxpayer",
}
CONTEXT_CHARS = 40


def luhn(digits: Column) -> Column:
    """Luhn's checksum over a string of ASCII digits."""
    ordered = F.reverse(F.split(digits, ""))
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x >= "5", x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)
    return F.aggregate(F.transform(F.filter(ordered, lambda x: x != ""), value), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: letters stand for 10 to 35, the first four characters move to the end, the remainder is 1."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda x: x != "")
    fold = lambda acc, x: F.when(x.between("0", "9"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(chars, F.lit(0), fold) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _confirm(kind: str, m: Column) -> Column | None:
    if kind == "ip":
        return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return None


def _proposals(text: Column, kind: str) -> Column:
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}[kind]
    guard = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "phone": F.contains(text, F.lit("+")), "ssn": F.contains(text, F.lit("-"))}.get(kind)
    return matches(text, pattern, guard)


def kind_spans(text: Column, kind: str, min_score: float) -> Column:
    """array<struct<kind,start,end,match,score>> of the confirmed spans of one kind that reach min_score."""
    plain, gain = SCORES[kind]

    def scored(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT_CHARS)).cast("int"))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.when(before.rlike(CONTEXT[kind]), plain + gain).otherwise(plain).alias("score"))

    def keep(found: Column) -> Column:
        ok = _confirm(kind, F.lit("")) is not None
        sure = F.filter(found, lambda s: _confirm(kind, s["match"])) if ok else found
        spans = F.transform(sure, scored)
        return spans if plain >= min_score else F.filter(spans, lambda s: s["score"] >= min_score)

    return let(_proposals(text, kind), keep)


def find_pii(docs: DataFrame, text_col: str = "text", min_score: float = 0.6, out: str = "pii") -> DataFrame:
    """Add `out`, array<struct<kind,start,end,match,score>>: offsets in code points, ordered by kind as in KINDS, then
    start. Kinds in BASE_KINDS are kept whatever their score; others must reach min_score. Null text gives an empty
    array. A column named `out` is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [kind_spans(text, k, 0.0 if k in BASE_KINDS else min_score) for k in KINDS]
    return docs.withColumn(out, F.concat(*parts))


def redact_pii(docs: DataFrame, text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """Replace every span found by its kind in brackets; where spans overlap, the earlier one wins."""
    spans = fresh_name(docs.columns, "spans")
    found = find_pii(docs, text_col, min_score, spans)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"))
    )
    done = F.aggregate(ordered, state, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_col, done).drop(spans)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
