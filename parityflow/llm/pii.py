"""Personal data in texts: regular expressions propose spans, checks confirm them, context scores them.

Kinds: email, ip, card, phone and iban. A proposed span is dropped when its check fails (parts
of an address up to 255, 16 to 19 digits with a right Luhn sum, 8 to 15 digits of a phone number,
as many characters as IBANs of the country have, with a remainder of 1 modulo 97). Spans of one kind are found from the
left and do not overlap; spans of different kinds may. The score of a span starts from its kind
and rises when a word that speaks of the kind stands within ``NEAR`` characters before it.

A text is split by a pattern into the pieces between its matches, so that the lengths of pieces
and matches add up to the places of the spans, in code points, with the end exclusive. Null text
counts as empty. Rows are treated alone: repeated rows repeat, an empty table gives an empty
table, extra columns pass through unless they bear the output's name. Only DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40  #: characters before a span that count as its context
CHUNK = 256  #: elements that are summed up at a time
BASE_KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Kind:
    """``start`` guards the pattern: a match begins where the last one ended, or not within a run of ``start``.

    Without it every character of a long run would be tried as a start. Possessive repeats keep
    Java from coming back to what it has read; none of these patterns can match by doing so. An
    IBAN is read as far as its country's length goes, so that words behind it stay out of it.
    """

    name: str
    start: str
    pattern: str
    hint: str  # texts without a match of it are not searched
    words: str
    score: float

    @property
    def guarded(self) -> str:
        return f"(?:\\G|(?<!{self.start})){self.pattern}" if self.start else self.pattern


#: characters of an IBAN behind the check digits, by country, as in the IBAN registry and the list of countries that use them without an entry
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA",
    19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "AO CV GW LY MZ PT ST", 22: "DZ IR IS TR",
    23: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD", 24: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 25: "BR EG PS QA UA",
    26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
_BY_COUNTRY = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, codes in IBAN_REST.items())
_CODES = "|".join(IBAN_REST.values()).replace(" ", "|")
_OTHER = rf"(?!{_CODES})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_CODES})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}}+"  # no country's IBAN: read up to one that is


KINDS = (
    Kind("email", "[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"(?i)e-?mail|contact|write to|correo|courriel|kontakt", 0.9),
    Kind("ip", "[0-9]", r"[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]", r"(?i)\bip\b|address|host|server|login", 0.6),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", r"(?i)card|visa|credit|karte|carte|tarjeta", 0.8),
    Kind("phone", "", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"(?i)phone|tel\b|tel\.|call|mobile|fax|tél|llama", 0.7),
    Kind("iban", "[A-Za-z0-9]", rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_COUNTRY}|{_OTHER})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", r"(?i)iban|account|konto|compte|cuenta|bank", 0.8),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a text of digits is divisible by ten."""
    each = F.split(F.reverse(digits), "")
    values = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: its first four characters go to the end, letters count from 10."""
    turned = F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _running_sum(lengths: Column) -> Column:
    """Sums up to each element, chunk by chunk, so that long arrays are not copied at every step."""

    def grown(values: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

    def whole(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
        return _let(F.transform(starts, lambda i: grown(F.slice(values, i, CHUNK))), join)

    def join(chunks: Column) -> Column:
        ends = grown(F.transform(chunks, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0))))
        lifted = _let(ends, lambda e: F.transform(chunks, lambda c, i: _let(F.coalesce(F.get(e, i - 1), F.lit(0)), lambda o: F.transform(c, lambda x: x + o))))
        return F.flatten(lifted)

    return _let(lengths, whole)


def _spans(text: Column, kind: Kind) -> Column:
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(kind.guarded), F.lit(0)), F.split(text, kind.guarded, -1), lambda m, b: F.struct(m.alias("match"), b.alias("between"))
    )  # behind the last match only a piece is left

    def located(p: Column) -> Column:
        return _let(_running_sum(F.transform(p, lambda x: F.length(x["between"]) + F.coalesce(F.length(x["match"]), F.lit(0)))), lambda e: spans(p, e))

    def spans(p: Column, ends: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            near = F.right(x["between"], F.lit(NEAR)).rlike(kind.words)
            score = F.lit(kind.score) + F.when(near, F.lit(1 - kind.score) / 2).otherwise(0.0)
            end = F.get(ends, i)
            return F.when(
                x["match"].isNotNull() & _confirmed(kind.name, x["match"]),
                F.struct(F.lit(kind.name).alias("kind"), (end - F.length(x["match"])).alias("start"), end.alias("end"), score.alias("score")),
            )

        return F.filter(F.transform(p, span), lambda s: s.isNotNull())

    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(text.rlike(kind.hint), _let(pairs, located)).otherwise(nothing)


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``pii``: the spans ``kind, start, end, score`` by kind as listed, then start."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn("pii", F.concat(*[_spans(whole, k) for k in kinds]))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
