"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Built from SQL functions only. The matches of a pattern and the pieces between them give
the positions: their lengths are summed along the text, so nothing is searched twice.

Edge cases: a null text is the empty text and has no spans; positions count code points
of the whole text; a span found by two kinds is reported for both; repeated rows are
repeated; further columns of the input are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans at one place are listed.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
_LOCAL = "A-Za-z0-9._%+-"
#: Characters of an IBAN by country, as the registry has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRY = "|".join(" ".join(IBAN_LENGTHS.values()).split(" "))
_IBAN = "|".join([*(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items()), rf"(?!{_COUNTRY})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])"])
#: Each pattern takes a maximal run from its first possible place (a run can also start where the last match ended), and never
#: steps back into it, so time is linear in the text. An IBAN ends after the length of its country, whatever follows a space.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # the whole is looked at ahead, as group 1, and only the country is consumed: what turns out to be none hides nothing behind it
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN}))[A-Z]{{2}}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters that a match consumes where its value is looked at ahead.
AHEAD = {"iban": 2}
#: A cheap test that a text can hold the kind at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Score with the checks passed, and words in the 40 characters before that raise it.
SCORES = {"email": 0.95, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|server|host)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
}
RAISE, NEAR, LEAST = 0.4, 40, 0.5
#: Matches walked before their spans are put aside; only the cost depends on it.
BLOCK = 256
_SPAN = "struct<start:int,end:int,value:string,before:string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits, the second from the right and each other one doubled, sum to a multiple of ten."""
    n = F.length(number)

    def part(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def matches(text: Column, pattern: str, ahead: int = 0) -> Column:
    """All matches of a pattern from the left as array<struct<start, end, value, before>>, in code points; before: the NEAR characters in front.

    With `ahead`, a match consumes that many characters and its value is group 1. Matches are walked in blocks, and what
    stands before each is carried along, so that neither many matches nor a long text are copied or searched for each one.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if ahead else 0)).alias("value"))
    last = lambda c: F.right(c, F.lit(NEAR))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(done: Column, piece: Column) -> Column:
        start = done["at"] + F.length(piece["gap"])
        before = last(F.concat(done["tail"], last(piece["gap"])))
        used = F.substring(piece["value"], 1, ahead) if ahead else piece["value"]
        span = F.struct(start.alias("start"), (start + F.length(piece["value"])).alias("end"), piece["value"].alias("value"), before.alias("before"))
        after = F.struct((start + F.length(used)).alias("at"), last(F.concat(before, used)).alias("tail"), F.concat(done["spans"], F.array(span)).alias("spans"))
        return F.when(piece["value"].isNull(), done).otherwise(after)

    zero = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("spans")))

    def walk(made: Column) -> Column:
        def block(done: Column, first: Column) -> Column:
            before = F.element_at(done, -1)
            start = F.struct(before["at"].alias("at"), before["tail"].alias("tail"), none.alias("spans"))
            return F.concat(done, F.array(F.aggregate(F.slice(made, first, F.lit(BLOCK)), start, step)))

        return F.aggregate(F.sequence(F.lit(1), F.size(made), F.lit(BLOCK)), zero, block, lambda done: F.flatten(F.transform(done, lambda b: b["spans"])))

    # the pieces are the variable of a lambda function: as an expression within one they would be made anew for each block
    return F.get(F.transform(F.array(pieces), walk), F.lit(0))


def _found(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind with scores: struct<start, no, end, kind, value, score>, which sorts as spans are listed."""
    spans = F.filter(matches(text, PATTERNS[kind], AHEAD.get(kind, 0)), lambda s: _valid(kind, s["value"]))

    def scored(s: Column) -> Column:
        score = F.when(s["before"].rlike(CONTEXT[kind]), F.lit(min(1.0, SCORES[kind] + RAISE))).otherwise(F.lit(SCORES[kind]))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), score.alias("score"))

    out = F.filter(F.transform(spans, scored), lambda s: s["score"] >= LEAST)
    may = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike(PATTERNS[kind])
    return F.when(may, out).otherwise(F.array().cast("array<struct<start:int,no:int,end:int,kind:string,value:string,score:double>>"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, and found: all confirmed spans in order as array<struct<start, no, end, kind, value, score>>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", *(_found(F.col("text"), k).alias(k) for k in KINDS))
    return rows.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base kinds and the list of all spans of each document."""
    base = KINDS[:4]
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    of_base = F.filter("found", lambda s: s["no"] < len(base))
    return found.select("doc_id", *(count(k) for k in base), F.sha2(listed(of_base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.transform("found", lambda s: s["score"]).alias("scores"))
