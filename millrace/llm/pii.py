"""Format-preserving pseudonyms for personal values: a keyed Feistel network over each value's own format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let

ROUNDS = 10

# Longer matches come first where two kinds could start at one place. Only ASCII letters and digits bound a value.
EDGE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z_%+-][0-9A-Za-z._%+-]*+(?<!\.)@[0-9A-Za-z-]++(?:\.[0-9A-Za-z-]++)++"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"


def _any(parts: list[str]) -> str:
    return "(?:" + "|".join(parts) + ")"


# Dates with one separator throughout: year first, or year last. Two more digits after . or / are a longer number.
DOTTED, UNDOTTED = r"(?<![0-9A-Za-z./])", r"(?![0-9A-Za-z]|[./][0-9])"
_YEAR_FIRST = {s: f"[0-9]{{4}}{s}[0-9]{{1,2}}{s}[0-9]{{1,2}}" for s in ("-", "/", r"\.")}
_YEAR_LAST = {s: f"[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}[0-9]{{4}}" for s in ("-", "/", r"\.")}
ISO_DATE = _any([EDGE + _YEAR_FIRST["-"] + END, DOTTED + _any([_YEAR_FIRST["/"], _YEAR_FIRST[r"\."]]) + UNDOTTED])
DAY_DATE = _any(
    [DOTTED + _any([_YEAR_LAST["/"], _YEAR_LAST[r"\."]]) + UNDOTTED, r"(?<![0-9A-Za-z-])" + _YEAR_LAST["-"] + r"(?![0-9A-Za-z]|-[0-9])"]
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
# The groups that cards print, or no groups.
_PRINTED = _any(["[0-9]{13,19}", *(f"[0-9]{{4}}{s}" + s.join(f"[0-9]{{{n}}}" for n in g) for s in " -" for g in ((4, 4, 4), (6, 5), (6, 4), (3, 3, 3)))]) + END
# What a value of several groups doesn't run into after a blank.
_OTHER = _any([r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", *_YEAR_FIRST.values(), *_YEAR_LAST.values(), "[0-9]{3}-[0-9]{2}-[0-9]{4}", _PRINTED])
_MORE = f"(?:(?: (?!{_OTHER})|[.-])?[0-9])"  # a digit more of a phone
# International: +1 has ten digits, others 8 to 15 by validation. National: three groups of North America, or a trunk 0.
PHONE = _any(
    [
        r"(?<![0-9A-Za-z+])\+"
        + _any(
            [
                r"1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
                rf"[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\){_MORE}{{4,10}}",
                f"[0-9]{_MORE}{{7,14}}",
            ]
        ),
        r"(?<![0-9A-Za-z+.-])(?:1[ .-])?"
        + _any([r"\([2-9][0-9]{2}\)[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}", *(f"[2-9][0-9]{{2}}{s}[2-9][0-9]{{2}}{s}[0-9]{{4}}" for s in ("-", " ", r"\."))]),
        rf"(?<![0-9A-Za-z+./-])(?:\(0[1-9][0-9]{{1,3}}\) ?|0[1-9][0-9]{{1,3}}[ /-])[0-9]{_MORE}{{4,7}}",
    ]
) + r"(?![0-9A-Za-z]|[.-][0-9])"
# Groups as printed, then any others of 13 to 19 digits; validation selects.
CARD = EDGE + _any([_PRINTED, f"[0-9](?:(?:[ -](?!{_OTHER}))?[0-9]){{12,18}}" + END])


def _digits(value: Column) -> Column:
    """The digits of a value as ``array<bigint>``."""
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("bigint"))


def _radices(symbols: Column, radix: int) -> Column:
    return F.transform(symbols, lambda _: F.lit(radix).cast("bigint"))


def feistel(symbols: Column, radices: Column, key: str, tweak: str) -> Column:
    """Permute mixed-radix symbols (``array<bigint>``, each below its radix) under a key.

    The array is cut in halves; each round adds, symbol by symbol and modulo its radix, a SHA-256 of the key, the
    tweak, the round and the other half. A round can be taken back, so different values stay different. A lone
    symbol is shifted by its keyed amount.
    """
    half = F.floor(F.size(symbols) / 2).cast("int")

    def one(state: Column, number: Column) -> Column:
        even = number % 2 == 0
        moved = lambda i: F.when(even, i >= half).otherwise(i < half)
        rest = F.array_join(F.filter(state, lambda _, i: ~moved(i)), ",")
        seed = F.concat_ws("|", F.lit(key), F.lit(tweak), F.size(state), number, rest)
        return F.transform(
            state,
            lambda x, i: F.when(
                moved(i),
                (x + F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i), 256), 1, 15), 16, 10).cast("bigint"))
                % F.get(radices, i),
            ).otherwise(x),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, one)


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    pieces = F.split(shape, "[0-9]")
    return F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(digits, i).cast("string"), F.lit("")))), ""
    )


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of digits where every second one counts double, the first from the right if ``doubled_from_right`` is 0."""
    n = F.size(digits)
    shares = F.transform(
        digits,
        lambda d, i: F.when((n - 1 - i) % 2 == doubled_from_right, (2 * d) % 10 + F.floor(2 * d / 10)).otherwise(d),
    )
    return F.aggregate(shares, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _card_valid(value: Column) -> Column:
    return let(_digits(value), lambda d: (_luhn_sum(d, 1) % 10 == 0) & F.exists(d, lambda x: x != 0))


def _card(value: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = F.slice(d, F.lit(1), F.size(d) - 1)
        mixed = feistel(body, _radices(body, 10), key, "card")
        whole = lambda m: F.concat(m, F.array(F.pmod(-_luhn_sum(m, 0), F.lit(10)).cast("bigint")))
        return let(mixed, lambda m: _fill(value, whole(m)))

    return let(_digits(value), made)


def _phone_valid(value: Column) -> Column:
    return F.size(_digits(value)).between(8, 15)


def _phone(value: Column, key: str) -> Column:
    """The country code stays where a mark ends it, and a leading 0 or 1 that is dialled; the other digits are permuted."""
    code = F.regexp_extract(value, r"^(?:\+(?:[0-9]{1,3}(?=[^0-9]))?|\(?0|1(?=[^0-9]))", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return let(_digits(rest), lambda d: F.concat(code, _fill(rest, feistel(d, _radices(d, 10), key, "phone"))))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, "\\."), lambda o: o.cast("bigint"))


def _ip(value: Column, key: str) -> Column:
    return let(_octets(value), lambda o: F.array_join(feistel(o, _radices(o, 256), key, "ip"), "."))


def _ssn_valid(value: Column) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def _ssn(value: Column, key: str) -> Column:
    """Areas are 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999; the result is valid again."""
    area, group, serial = (F.split(value, "-")[i].cast("bigint") for i in range(3))
    symbols = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    mixed = feistel(symbols, F.array(*(F.lit(r).cast("bigint") for r in (898, 99, 9999))), key, "ssn")
    shown = lambda m: F.format_string("%03d-%02d-%04d", m[0] + F.when(m[0] >= 665, 2).otherwise(1), m[1] + 1, m[2] + 1)
    return let(mixed, shown)


def _iso(value: Column) -> Column:
    return F.try_to_timestamp(F.translate(value, "./", "--"), F.lit("yyyy-M-d")).cast("date")


def _day_first(value: Column) -> Column:
    return F.try_to_timestamp(F.translate(value, ".-", "//"), F.lit("d/M/yyyy")).cast("date")


def _month_first(value: Column) -> Column:
    """For values that can't have the day first, so the day is over 12."""
    return F.try_to_timestamp(F.translate(value, ".-", "//"), F.lit("M/d/yyyy")).cast("date")


# 400 Gregorian years have 146 097 = 27 * 5411 days: a date is permuted inside its own 400 years.
CYCLE, LOW, HIGH = 146_097, 27, 5_411


def _shifted(date: Column, key: str) -> Column:
    days = F.date_diff(date, F.lit("1600-01-01").cast("date")).cast("bigint")

    def made(d: Column) -> Column:
        inside = F.pmod(d, F.lit(CYCLE))
        symbols = F.array(inside % LOW, F.floor(inside / LOW).cast("bigint"))
        radices = F.array(F.lit(LOW).cast("bigint"), F.lit(HIGH).cast("bigint"))
        mixed = feistel(symbols, radices, key, "date")
        return let(mixed, lambda m: F.date_add(F.lit("1600-01-01").cast("date"), (d - inside + m[0] + LOW * m[1]).cast("int")))

    return let(days, made)


def _like(value: Column, date: Column, order: tuple[str, str, str]) -> Column:
    """``date`` with the separator and the zeros that ``value`` was written with."""
    short = ~value.rlike(r"(?:^|[^0-9])0[0-9](?:[^0-9]|$)") & value.rlike(r"(?:^|[^0-9])[0-9](?:[^0-9]|$)")
    shown = F.when(short, F.date_format(date, "/".join(order))).otherwise(F.date_format(date, "/".join(p if p == "yyyy" else 2 * p for p in order)))
    return F.replace(shown, F.lit("/"), F.regexp_extract(value, "[./-]", 0))


def _iso_date(value: Column, key: str) -> Column:
    return let(_shifted(_iso(value), key), lambda d: _like(value, d, ("yyyy", "M", "d")))


def _day_date(value: Column, key: str) -> Column:
    """In its own order and with its own separator; the same day as an ISO date gets the same pseudonym.

    A value that can only have the month first goes on to the next pseudonym until that is such a value too, as one
    that could be read both ways might be the pseudonym of another date.
    """

    def walked(date: Column) -> Column:
        step = lambda d, i: F.when((i > 0) & (F.dayofmonth(d) > 12), d).otherwise(_shifted(d, key))
        return F.aggregate(F.sequence(F.lit(0), F.lit(99)), date, step)

    return F.when(
        _day_first(value).isNotNull(), let(_shifted(_day_first(value), key), lambda d: _like(value, d, ("d", "M", "yyyy")))
    ).otherwise(let(walked(_month_first(value)), lambda d: _like(value, d, ("M", "d", "yyyy"))))


def _email(value: Column, key: str) -> Column:
    """ASCII letters and digits of the local part are permuted, each within its class; the domain stays."""
    local = F.substring_index(value, "@", 1)
    domain = F.substring(value, F.length(local) + 1, F.length(value))
    chars = F.filter(F.split(local, ""), lambda c: c != "")
    code = lambda c: F.ascii(c).cast("bigint")
    base = lambda c: F.when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).when(c.rlike("[0-9]"), 48).otherwise(0)

    def made(all_chars: Column) -> Column:
        live = F.filter(all_chars, lambda c: base(c) > 0)
        symbols = F.transform(live, lambda c: code(c) - base(c))
        radices = F.transform(live, lambda c: F.when(base(c) == 48, 10).otherwise(26).cast("bigint"))
        shape = F.regexp_replace(local, "[0-9A-Za-z]", "0")
        # The tweak holds the classes by way of the shape, as values of one permutation must share their radices.
        letters = F.zip_with(
            let(F.struct(symbols.alias("s"), radices.alias("r")), lambda v: feistel(v["s"], v["r"], key, "email")),
            live,
            lambda x, c: F.chr(x + base(c)),
        )
        return F.concat(_fill(shape, letters), domain)

    return let(chars, made)


@dataclass(frozen=True)
class Kind:
    """A format: its pattern, which matches are real, and their pseudonym."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    pseudonym: Callable[[Column, str], Column]


KINDS = (
    Kind("email", EMAIL, lambda v: F.lit(True), _email),
    Kind("ip", IPV4, lambda v: F.forall(_octets(v), lambda o: o <= 255), _ip),
    Kind("date", ISO_DATE, lambda v: _iso(v).isNotNull(), _iso_date),
    Kind("day_date", DAY_DATE, lambda v: _day_first(v).isNotNull() | _month_first(v).isNotNull(), _day_date),
    Kind("ssn", SSN, _ssn_valid, _ssn),
    Kind("phone", PHONE, _phone_valid, _phone),
    Kind("card", CARD, _card_valid, _card),
)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and ``pii_counts`` (``array<bigint>`` in order of ``kinds``).

    Candidates of all formats are found in one pass; those that fail validation (check digits, ranges, calendar)
    stay as they are. The others are permuted inside their format under ``key``: equal values give equal
    pseudonyms in every document, whatever their separators, and different ones stay different. Text between
    values is unchanged.

    A null text stays null, with counts of 0, an empty one empty. Rows are independent: repeated rows, null ids
    and extra columns are kept as they are. A column named ``pii_counts`` is replaced. No shuffle.
    """
    # At most places none of our kinds but mail addresses can start, which one look ahead tells.
    pattern = "|".join(f"(?:{k.pattern})" if k not in KINDS or k.pattern == EMAIL else f"(?=[0-9+(])(?:{k.pattern})" for k in kinds)
    value = F.col(text)

    def replaced(v: Column) -> Column:
        """The kind's number and the replacement of one match; -1 if nothing vouches for it."""
        out = F.struct(F.lit(-1).alias("kind"), v.alias("text"))
        for i, k in reversed(list(enumerate(kinds))):
            hit = v.rlike(f"^(?:{k.pattern})$") & k.valid(v)
            out = F.when(hit, F.struct(F.lit(i).alias("kind"), k.pseudonym(v, key).alias("text"))).otherwise(out)
        return out

    found = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), replaced)
    between = F.split(value, pattern)

    def woven(hits: Column) -> Column:
        pieces = F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(hits, i)["text"], F.lit(""))))
        of_kind = F.transform(F.array(*map(F.lit, range(len(kinds)))), lambda k: F.size(F.filter(hits, lambda h: h["kind"] == k)))
        whole = F.when(F.size(hits) == 0, value).otherwise(F.array_join(pieces, ""))
        return F.struct(whole.alias("text"), of_kind.cast("array<bigint>").alias("counts"))

    made = docs.withColumn("_pii", let(found, woven))
    zeros = F.array(*[F.lit(0).cast("bigint")] * len(kinds))
    counts = F.when(value.isNull(), zeros).otherwise(F.col("_pii.counts"))
    return made.withColumns({"pii_counts": counts, text: F.when(value.isNotNull(), F.col("_pii.text"))}).drop("_pii")
