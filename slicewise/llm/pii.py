"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is one projection of built-in functions; no shuffle and no Python. Patterns are
written so that the regular expression engine never walks a run of characters twice: runs are
matched possessively and only from their first character, and the words around a match are kept
from the match itself, so that the work grows with the text and not with text times matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string,score:double,before:string,after:string>"

#: Fixed values. Patterns per kind; ``\\G`` is the end of the previous match of that kind.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
ACCESS_KEY = r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}"
#: A credential is a value that is assigned to one of these names.
CREDENTIAL_NAME = (r"(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)"
                   r"[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?")
CREDENTIAL = r"[A-Za-z0-9+/=_.!@#$%^*~-]{8,}"
#: Fixed values. Characters of an IBAN by country; of other countries the whole match counts.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "short_card", "access_key", "credential")

#: Fixed values. Score without context, and words that raise or lower it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "short_card": 0.35,
              "access_key": 0.6, "credential": 0.6}
RAISE = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|login|adresse|direcci",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|telefon|fax|llama",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "short_card": "card|visa|amex|credit|karte|carte|tarjeta",
    "access_key": "secret|credential|login",
    "credential": "login|server|account|private",
}
LOWER = {"ip": "version|release|build", "card": "serial|isbn|order", "short_card": "serial|isbn|order",
         "phone": "isbn|serial", "email": "example only", "iban": "serial",
         "access_key": "example|dummy|placeholder", "credential": "example|dummy|placeholder"}
CONTEXT_CHARS, CONTEXT_STEP, MIN_SCORE = 40, 0.2, 0.5
#: Matches of one text that are folded together; an append copies at most so many spans.
CHUNK = 128


def _span(kind: str, start: Column, end: Column, value: Column, before: Column, after: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"),
                    F.lit(BASE_SCORE[kind]).alias("score"), before.alias("before"), after.alias("after")).cast(SPAN)


def _fold(found: Column, carry: dict[str, Column], step: Callable[[Column, Column], Column]) -> Column:
    """The array ``out`` that ``step`` builds over ``found`` beside the fields of ``carry``, in
    chunks, as every append copies the array it extends."""
    def cut(f: Column) -> Column:
        last = F.floor(F.greatest(F.size(f) - 1, F.lit(0)) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(f, c * CHUNK + 1, F.lit(CHUNK)))

    def fields(acc: Column) -> list[Column]:
        return [acc[name].alias(name) for name in carry]

    def chunk(acc: Column, part: Column) -> Column:
        start = F.struct(*fields(acc), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(part, start, step, lambda done: F.struct(
            *fields(done), F.array_append(acc["out"], done["out"]).alias("out")))

    start = F.struct(*[c.alias(name) for name, c in carry.items()], F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    # a variable of its own, so that the matches are found once and not once a chunk
    chunks = F.flatten(F.transform(F.array(found), cut))
    return F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["out"]))


def _tail(text: Column) -> Column:
    """The last characters of a text, as many as count as context."""
    first = F.greatest(F.length(text) + 1 - CONTEXT_CHARS, F.lit(1))
    return F.substring(text, first, F.lit(CONTEXT_CHARS))


def _proposed(text: Column, pattern: str, kind: str, trigger: Column, lead: str = "") -> Column:
    """Leftmost non-overlapping matches of ``pattern`` after ``lead``, with positions in code
    points and the characters before and after. Each match is found together with the gap before
    it, so positions are running sums of lengths, and the context before a match is the end of
    its gap, if need be with the end of what came earlier."""
    spaced = F.lit(rf"(?s)\G(.*?{lead})({pattern})(?=(.{{0,{CONTEXT_CHARS}}}))")
    group = lambda n: F.regexp_extract_all(text, spaced, F.lit(n))
    found = F.arrays_zip(group(0).alias("whole"), group(2).alias("hit"), group(3).alias("after"))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        end, size = acc["pos"] + F.length(x["whole"]), F.length(x["hit"])
        joined = F.concat(acc["tail"], x["whole"])
        before = _tail(F.substring(joined, F.lit(1), F.length(joined) - size))
        span = _span(kind, end - size, end, x["hit"], before, x["after"])
        return F.struct(end.alias("pos"), _tail(joined).alias("tail"), F.array_append(acc["out"], span).alias("out"))

    return F.when(trigger, _fold(found, {"pos": F.lit(0), "tail": F.lit("")}, step)).otherwise(empty)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn checksum of a string of digits, every second from the right doubled."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def iban_ok(value: Column) -> Column:
    """Remainder 1 modulo 97 after the first four characters moved to the end, A=10 to Z=35."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return (F.length(flat).between(15, 34)
            & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1))


def _iban_part(hit: Column) -> Column:
    """The start of a match that is as long as IBANs of its country are; empty if it is shorter."""
    chars = F.create_map(*[F.lit(x) for n, names in IBAN_CHARS.items() for c in names.split() for x in (c, n)])
    n = F.get(F.map_values(F.map_filter(chars, lambda c, _: c == F.substring(hit, 1, 2))), F.lit(0))
    part = F.call_function("regexp_extract", hit, F.concat(F.lit("^(?: ?[A-Z0-9]){"), n.cast("string"), F.lit("}")), F.lit(0))
    return F.when(n.isNull(), hit).otherwise(part)


def _ibans(text: Column) -> Column:
    """IBANs that pass their checksum, leftmost first and not overlapping. Every place where one
    can begin is tried, so a match that fails takes nothing from the next one."""
    spaced = F.lit(rf"(?s)\G(.*?)(?=({IBAN}))[A-Z]")
    pairs = F.arrays_zip(F.regexp_extract_all(text, spaced, F.lit(0)).alias("whole"),
                         F.regexp_extract_all(text, spaced, F.lit(2)).alias("hit"))
    parts = F.transform(pairs, lambda x: F.struct(x["whole"].alias("whole"), _iban_part(x["hit"]).alias("hit")))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        # ``whole`` ends with the first letter of the IBAN
        pos, joined = acc["pos"] + F.length(x["whole"]), F.concat(acc["tail"], x["whole"])
        end = pos - 1 + F.length(x["hit"])
        before = _tail(F.substring(joined, F.lit(1), F.length(joined) - 1))
        span = _span("iban", pos - 1, end, x["hit"], before, F.lit(""))
        good = (pos - 1 >= acc["stop"]) & iban_ok(x["hit"])
        return F.struct(pos.alias("pos"), _tail(joined).alias("tail"),
                        F.when(good, end).otherwise(acc["stop"]).alias("stop"),
                        F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    carry = {"pos": F.lit(0), "tail": F.lit(""), "stop": F.lit(0)}
    return F.when(text.rlike("[A-Z]{2}[0-9]{2}"), _fold(parts, carry, step)).otherwise(empty)


def _ip_ok(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)


def _key_ok(s: Column) -> Column:
    """The key stands alone: no letter or digit touches it."""
    return ~s["before"].rlike(r"[A-Za-z0-9]\z") & ~s["after"].rlike("^[A-Za-z0-9]")


def _credential_ok(value: Column) -> Column:
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def _scored(spans: Column, kind: str) -> Column:
    def score(s: Column) -> Column:
        near = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))
        up = F.when(near.rlike(RAISE[kind]), CONTEXT_STEP).otherwise(0.0)
        down = F.when(near.rlike(LOWER[kind]), CONTEXT_STEP).otherwise(0.0)
        return (s.withField("score", F.round(F.least(F.lit(1.0), s["score"] + up - down), 3))
                .dropFields("before", "after"))

    return F.transform(spans, score)


def find_spans(text: Column) -> Column:
    """Spans of one text as an array, by kind in the order of the kinds, then by start.

    Positions count code points from 0, ``end`` is exclusive. Spans of the four base kinds that
    pass their checks always stay. Four kinds are added: ``iban`` (mod 97), ``short_card`` (13 to
    15 digits passing Luhn), ``access_key`` (a key id of a cloud account that no letter or digit
    touches) and ``credential`` (the value given to a name such as password or token, with a
    letter and a digit in it), kept only if their score with context is at least 0.5. A null
    text counts as empty; texts of any length are read whole.
    """
    text = F.coalesce(text, F.lit(""))
    has_digit = text.rlike("[0-9]")
    runs = _proposed(text, CARD, "card", has_digit)
    n = lambda s: F.length(digits_of(s["value"]))
    by_kind = {
        "email": _proposed(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        "ip": F.filter(_proposed(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]")),
                       lambda s: _ip_ok(s["value"])),
        "card": F.filter(runs, lambda s: n(s).between(16, 19) & luhn_ok(digits_of(s["value"]))),
        "phone": F.filter(_proposed(text, PHONE, "phone", F.contains(text, F.lit("+"))),
                          lambda s: n(s).between(8, 15)),
        "iban": _ibans(text),
        "short_card": F.transform(
            F.filter(runs, lambda s: n(s).between(13, 15) & luhn_ok(digits_of(s["value"]))),
            lambda s: s.withField("kind", F.lit("short_card"))
                       .withField("score", F.lit(BASE_SCORE["short_card"]))),
        "access_key": F.filter(_proposed(text, ACCESS_KEY, "access_key", text.rlike(ACCESS_KEY)), _key_ok),
        "credential": F.filter(_proposed(text, CREDENTIAL, "credential", text.rlike(CREDENTIAL_NAME), CREDENTIAL_NAME),
                               lambda s: _credential_ok(s["value"])),
    }
    scored = [_scored(spans, kind) for kind, spans in by_kind.items()]
    added = [F.filter(s, lambda x: x["score"] >= MIN_SCORE) for s in scored[len(BASE_KINDS):]]
    return F.concat(*scored[:len(BASE_KINDS)], *added)


def pii_spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array of spans in column ``into`` (which replaces one of that name).

    One row in, one row out: repeated rows, nulls in any column, empty tables and extra columns
    need no rule beyond that; a null text gives an empty array.
    """
    return docs.withColumn(into, find_spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets. Where spans overlap, the
    one that starts first (then the longer one) is shown and the rest of the other goes too.
    A null text stays null."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform(find_spans(F.col(text)), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        head = F.substring(whole, acc["pos"] + 1, s["start"] - acc["pos"])
        grown = F.concat(acc["out"], head, F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] >= acc["pos"], F.struct(end.alias("pos"), grown.alias("out"))
                      ).otherwise(F.struct(F.greatest(end, acc["pos"]).alias("pos"),
                                           acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(
        acc["out"], F.substring(whole, acc["pos"] + 1, F.length(whole))))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), done))


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, of all spans (``n_spans``), and digests of the positions, one row per
    row of ``docs``; null and empty texts have none, an empty table gives an empty one."""
    found = docs.select("doc_id", find_spans(F.col("text")).alias("pii"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"),
                        F.size("pii").cast("long").alias("n_spans"), shown(F.col("pii")).alias("spans"))
