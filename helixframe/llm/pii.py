"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only built-in functions: spans come from splitting a text at its matches, so that the lengths of the pieces between them give
positions in code points; Luhn and mod-97 run as folds over digits.  Narrow, no shuffle, no Python on the executors.

The patterns accept exactly what the plain ones in PLAIN accept, leftmost first, but look behind where a match can start and
advance without recursion, so that very long runs cost linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")

#: The contract's patterns of base kinds, and those of the added kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]+?(?<=[0-9])(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": PLAIN["iban"],
    "ssn": PLAIN["ssn"],
}
#: A text without this can't hold the kind.
_NEEDS = {"email": lambda t: t.contains("@"), "ip": None, "card": None, "phone": lambda t: t.contains("+"), "iban": None, "ssn": None}
#: Score of a confirmed span, and the words that raise it by CONTEXT when they stand within NEAR code points before it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|debit|pay",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social|security|tax",
}
NEAR, CONTEXT, LEAST = 40, 0.3, 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + F.lit(1), F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, blanks removed, leaves 1 modulo 97 (first four characters moved last, A = 10 .. Z = 35)."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def _small(part: Column) -> Column:
    """Whether a string of digits is a number of at most 255."""
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) > 3, False).otherwise(F.concat(F.lit("0"), F.substr(bare, F.lit(1), F.lit(3))).cast("int") <= 255)


def _confirmed(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(hit, "[.]"), _small),
        "card": lambda: F.when(n.between(16, 19), luhn(_digits(hit))).otherwise(False),
        "phone": lambda: n.between(8, 15),
        "iban": lambda: mod97(hit),
        "ssn": lambda: F.lit(True),
    }[kind]()


def _found(kind: str, text: Column) -> Column:
    """All confirmed spans of a kind, in order: array of (kind, start, end, value, score)."""
    pattern = _FAST[kind]
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["hit"], F.lit("")))
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        keep = F.coalesce(x["hit"].isNotNull() & _confirmed(kind, x["hit"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    def scored(s: Column) -> Column:
        before = F.lower(F.substr(text, F.greatest(s["start"] - NEAR, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(NEAR)).cast("int")))
        near = F.when(before.rlike(rf"\b(?:{WORDS[kind]})\b"), CONTEXT).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.least(F.lit(1.0), F.lit(SCORES[kind]) + near).alias("score"))

    out = F.transform(spans, scored)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one column for each kind added: pii_<kind>, array of (kind, start, end, value, score), by start.

    Positions count code points from 0, end exclusive.  Base kinds (BASE) hold what the contract's rules leave, whatever
    their score; added kinds need a score of LEAST.  Null text: as empty, empty arrays.
    """
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = text.rlike("[0-9]")
    out = docs
    for kind in BASE + ADDED:
        need = _NEEDS[kind](text) if _NEEDS[kind] else digit
        out = out.withColumn(f"pii_{kind}", F.when(need, _found(kind, text)).otherwise(none))
    return out


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of `detect` for each document: the columns of the op8 query."""
    found = detect(docs.select("doc_id", "text"))
    listed = lambda kinds: F.array_join(F.transform(F.concat(*[F.col(f"pii_{k}") for k in kinds]), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(BASE + ADDED).alias("spans"))
