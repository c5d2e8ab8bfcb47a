"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Kinds email, ip, card and phone are the base detectors; iban (mod-97) and ssn
(accepted on context) are added. Every proposal has a score: a base for its
kind, more when a validator confirms it, more again when a context word of the
kind stands within 48 characters. Only built-in column functions run.

The patterns are written so that each start is tried once: a look-behind stops
a second attempt inside a run that has already failed, and card digits are
bounded, so long texts stay linear and the matcher does not recurse deeply.

Defined results for odd input: a null text counts as empty and has no spans;
ids are only carried, so null or repeated ids are fine; other columns are
ignored. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_L = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length: countries of the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: A listed country's length, or a run of capitals and digits up to where a listed IBAN begins, cut back by ``iban_part``.
IBAN = rf"(?<![A-Za-z0-9])(?:{_LISTED}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?!{_LISTED})[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

THRESHOLD = 0.5
NEAR = 48
#: kind: (base score, gain when a validator confirms, context words and their gain)
SCORES = {
    "email": (0.6, 0.3, "mail|contact|write", 0.1),
    "ip": (0.5, 0.2, r"\bip\b|address|host|server", 0.3),
    "card": (0.5, 0.3, "card|visa|credit|payment", 0.2),
    "phone": (0.5, 0.2, "phone|call|tel|mobile", 0.3),
    "iban": (0.2, 0.5, "iban|account|bank", 0.3),
    "ssn": (0.2, 0.1, "ssn|social security", 0.5),
}
BASE = ("email", "ip", "card", "phone")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(number))
    places = F.sequence(F.lit(1), F.length(d))

    def add(acc: Column, i: Column) -> Column:
        v = F.substr(d, i, F.lit(1)).cast("int")
        w = F.when(i % 2 == 0, v * 2 - F.when(v > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(v)
        return acc + w

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True for an IBAN whose rearranged number leaves 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c <= 57, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def iban_part(run: Column) -> Column:
    """The longest valid IBAN that a run of words begins with, or the run itself."""
    words = F.split(run, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.concat_ws(" ", F.slice(words, F.lit(1), k)))
    good = F.filter(starts, lambda x: _valid("iban", x))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), run)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)),
        "card": n.between(16, 19) & luhn(m),
        "phone": n.between(8, 15),
        "iban": F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(m),
        "ssn": ~m.rlike("^(000|666|9)|-00-|-0000$"),
    }[kind]


_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
_GATE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}"),
    "ssn": lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"),
}
SPANS = "array<struct<kind:string,start:int,end:int,valid:boolean,score:double>>"


def _placed(text: Column, kind: str) -> Column:
    """Matches of a kind as array<struct<m, start>>; gaps and matches tile the text."""
    pattern = _PATTERN[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.lit(None).cast("array<struct<m:string,start:int>>")
    none = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.struct(F.lit("").alias("m"), F.lit(0).alias("start"))), 1, 0).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), start.alias("start")))).alias("out"))

    tiles = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    placed = F.aggregate(tiles, none, add, lambda acc: acc["out"])
    return F.when(_GATE[kind](text), placed).otherwise(empty)


def _scored(text: Column, kind: str, placed: Column) -> Column:
    base, confirmed, words, near = SCORES[kind]
    if kind == "iban":
        placed = F.transform(placed, lambda x: F.struct(iban_part(x["m"]).alias("m"), x["start"].alias("start")))

    def one(x: Column) -> Column:
        start = x["start"]
        end = start + F.length(x["m"])
        lo = F.greatest(F.lit(0), start - NEAR)
        around = F.lower(F.concat_ws(" ", F.substr(text, lo + 1, start - lo), F.substr(text, end + 1, F.lit(NEAR))))
        valid = _valid(kind, x["m"])
        score = F.lit(base) + F.when(valid, F.lit(confirmed)).otherwise(F.lit(-1.0)) + F.when(around.rlike(words), F.lit(near)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), valid.alias("valid"), F.round(score, 3).alias("score"))

    kept = F.filter(F.transform(placed, one), lambda s: s["valid"] & (s["score"] >= THRESHOLD))
    return F.coalesce(kept, F.lit(None).cast(SPANS), F.array().cast(SPANS))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and one array of scored spans per kind."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    placed = slim.select("*", *[_placed(text, k).alias(f"p_{k}") for k in _PATTERN])
    return placed.select("doc_id", "text", *[F.when(F.size(F.coalesce(f"p_{k}", F.array())) > 0, _scored(text, k, F.col(f"p_{k}"))).otherwise(F.array().cast(SPANS)).alias(k) for k in _PATTERN])


def redact(found: DataFrame, mark: str = "█") -> DataFrame:
    """doc_id and the text of ``find_pii`` with every found character replaced by ``mark``."""
    spans = F.array_sort(F.flatten(F.array(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in _PATTERN])))

    def cover(acc: Column, s: Column) -> Column:
        return F.overlay(acc, F.repeat(F.lit(mark), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"])

    return found.select("doc_id", F.aggregate(spans, F.col("text"), cover).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts per base kind, their hash, and every span."""
    joined = lambda kinds: F.concat_ws(",", F.flatten(F.array(*[F.transform(k, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds])))
    scores = F.concat_ws(",", F.flatten(F.array(*[F.transform(k, lambda s: s["score"].cast("string")) for k in _PATTERN])))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(tuple(_PATTERN)).alias("spans"), scores.alias("scores"),
    )
