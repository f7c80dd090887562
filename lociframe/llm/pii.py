"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Everything is a DataFrame expression over one row at a time: no shuffle, no Python. A proposal's
place is found without sentinels: `split` on the same pattern gives the text between the
matches, so a match starts after all earlier gaps and matches. The running sums go in chunks,
so a text with very many matches stays far from quadratic work. Patterns use possessive
quantifiers and look-behinds only where they cannot change a match; they keep Java's matcher
from recursing or rescanning long runs.

Score: a prior for the kind, plus a bonus when one of the kind's context words stands within
CONTEXT code points on either side (up to the next match of that kind). The four base kinds have
priors above the threshold once confirmed, so context never drops them; the other kinds need a
checksum (iban) or a context word (ssn, secret).

Defined results: null text is empty and has no spans; repeated rows give repeated results; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
BONUS = 0.3
CONTEXT = 40
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a row and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column) -> Column:
    """Sums of the elements before each element of an array of longs."""

    def prefix(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / CHUNK).cast("int"))
    chunks = F.transform(starts, lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    totals = lambda cs: F.transform(cs, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    return let(
        chunks,
        lambda cs: let(
            prefix(totals(cs)),
            lambda offsets: F.flatten(F.transform(cs, lambda c, k: F.transform(F.slice(prefix(c), F.lit(1), F.size(c)), lambda v: v + F.get(offsets, k)))),
        ),
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(digits)
    one = lambda i: F.substring(backwards, i + 1, F.lit(1)).try_cast("int")
    value = lambda i: F.when(i % 2 == 0, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a country code, check digits and account, without spaces, give 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    at = lambda i: F.substring(turned, i, F.lit(1))
    step = lambda a, i: F.when(at(i).rlike("[0-9]"), (a * 10 + F.ascii(at(i)) - 48) % 97).otherwise((a * 100 + F.ascii(at(i)) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


#: The length of an account number by the country that leads it.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 "
    "MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)


def _iban_pattern() -> str:
    """A proposal ends where its country's length says, so a word after it is left alone."""
    by: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by.setdefault(int(entry[2:]), []).append(entry[:2])
    each = "|".join(rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(by.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{each})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    context: str
    valid: Callable[[Column], Column] = lambda m: F.lit(True)
    #: A character without which nothing can match.
    needs: str = ""
    base: bool = True


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.6, "(?i)mail|contact|@|address", needs="@"),
    Kind(
        "ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"(?i)\bip\b|host|server|address",
        lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))), needs=".",
    ),
    Kind(
        "card", r"[0-9]++(?:[\x20-][0-9]++)*+", 0.6, "(?i)card|visa|credit|payment|account",
        lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)),
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "(?i)phone|call|tel|mobile|fax", lambda m: F.length(_digits(m)).between(9, 15), needs="+"),
    Kind("iban", _iban_pattern(), 0.5, "(?i)iban|account|bank|konto", lambda m: mod97(F.translate(m, " ", "")), base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"(?i)\bssn\b|social security|tax id", needs="-", base=False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])", 0.3, r"(?i)token|secret|passw|api.?key|credential", base=False),
)

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _proposals(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast("array<string>")) if kind.needs else found


def _score(kind: Kind, gaps: Column, i: Column) -> Column:
    near = F.concat(F.substring(F.get(gaps, i), -CONTEXT, CONTEXT), F.lit("\n"), F.substring(F.get(gaps, i + 1), 1, CONTEXT))
    return F.lit(kind.prior) + F.when(near.rlike(kind.context), BONUS).otherwise(0.0)


def _spans(text: Column, kind: Kind) -> Column:
    def placed(ms: Column, gaps: Column) -> Column:
        steps = F.transform(ms, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))

        def span(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            return F.struct(
                F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
                F.when(kind.valid(m), _score(kind, gaps, i)).otherwise(0.0).cast("double").alias("score"),
            )

        return let(running(steps), lambda before: F.filter(F.transform(ms, lambda m, i: span(m, i, before)), lambda s: s["score"] >= THRESHOLD))

    some = lambda ms: let(F.split(text, kind.pattern, -1), lambda gaps: placed(ms, gaps))
    return let(_proposals(text, kind), lambda ms: F.when(F.size(ms) > 0, some(ms)).otherwise(F.array().cast(_SPAN)))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and one array of spans (kind, start, end, score) for each kind, by start.

    Places are in code points, ends exclusive.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("key", *(_spans(F.col("text"), k).alias(k.name) for k in KINDS))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; null texts stay null.

    Kinds go one after the other, each over what the former left; masks match no pattern.
    """

    def masked(value: Column, kind: Kind) -> Column:
        def joined(ms: Column, gaps: Column) -> Column:
            new = lambda m, i: F.when(m.isNotNull() & kind.valid(m) & (_score(kind, gaps, i) >= THRESHOLD), F.lit(f"<{kind.name.upper()}>")).otherwise(m)
            return F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(new(F.get(ms, i), i), F.lit(""))))), "")

        some = lambda ms: let(F.split(value, kind.pattern, -1), lambda gaps: joined(ms, gaps))
        return let(_proposals(value, kind), lambda ms: F.when(F.size(ms) > 0, some(ms)).otherwise(value))

    columns = docs.columns
    step = "__masked_text"
    out = docs.withColumn(step, F.col(text))
    for kind in KINDS:
        out = out.withColumn(step, F.when(F.col(step).isNotNull(), masked(F.col(step), kind)))
    return out.select(*(F.col(step).alias(c) if c == text else F.col(c) for c in columns))
