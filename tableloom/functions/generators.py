"""Value generators: one column per generator name, built only from draws and literals."""

from __future__ import annotations

import math
import re
import string
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableloom.functions import vocab
from tableloom.functions.dates import iso_text, resolve_date, years_before
from tableloom.functions.draw import DistinctDraws, Draws, constant_array
from tableloom.functions.floats import float_text
from tableloom.functions.rounding import round_half_even
from tableloom.plans.spec import Constraint, Field

# Defaults of the bounded generators.
DEFAULT_INT = (0, 999_999)
DEFAULT_DECIMAL = (0.0, 999_999.99, 2)
DEFAULT_AGES = (18, 99)
DEFAULT_DATES = ("-5y", "today")
DEFAULT_FORMAT = "?????#####"
DEFAULT_TEXT_LENGTH = 100

EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Cell:
    """All a generator may look at: the field's streams, its bounds and the reference day."""

    draws: Draws
    constraint: Constraint
    as_of: date
    unique: bool = False

    def pick(self, values, k=0):
        return self.draws.pick(values, k)


_ALWAYS_UNIQUE = ("uuid4", "uuid_int")  # by the hash of the row's id
_GENERATORS: dict[str, Callable[[Cell], Column]] = {}


def generator(*names: str):
    def register(fn):
        for name in names:
            _GENERATORS[name] = fn
        return fn

    return register


def generator_names() -> list[str]:
    return sorted(_GENERATORS)


def generate(field: Field, draws: Draws, as_of: date) -> Column:
    """The field's value in its declared type, before NULL rolls and conditions."""
    choices = field.constraint.choices()
    make = _choice if choices else _GENERATORS.get(field.generator)
    if make is None:
        warnings.warn(f"unknown generator {field.generator!r} of field {field.name!r}: using word", stacklevel=2)
        make = _word
    if field.unique and (choices or field.generator not in _ALWAYS_UNIQUE):
        if field.generator == "text" and not choices:
            warnings.warn(f"texts of field {field.name!r} are not kept unique", stacklevel=2)
        else:
            first = DistinctDraws(draws)
            make(Cell(first, field.constraint, as_of, True))
            draws = first.planned()
    return to_type(make(Cell(draws, field.constraint, as_of, field.unique)), field)


def value_kind(field: Field) -> str:
    """How formulas and conditions see the field: a number kept as text still counts as a number."""
    if field.spark_type != "string" or field.constraint.values:
        return field.spark_type
    return _NUMBER_KINDS.get(field.generator, "string")


_NUMBER_KINDS = {"random_int": "bigint", "pyint": "bigint", "uuid_int": "bigint", "pydecimal": "double", "boolean": "boolean"}


def to_type(value: Column, field: Field) -> Column:
    """Cast to the declared type the way an insert into a typed table would."""
    target = field.spark_type
    if target == "string":
        if field.generator == "date_time" and not field.constraint.values:
            return iso_text(value)
        if field.generator == "pydecimal" and not field.constraint.values:
            return float_text(value)
    if target == "bigint" and field.generator == "pydecimal" and not field.constraint.values:
        return F.rint(value).cast("bigint")
    return value.cast(target)


def clamp(value: Column, constraint: Constraint) -> Column:
    """Keep a number inside min..max, after rounding to ``right_digits``."""
    if constraint.right_digits is not None:
        value = round_half_even(value, constraint.right_digits)
    if constraint.max is not None:
        value = F.least(F.lit(constraint.max), value)
    if constraint.min is not None:
        value = F.greatest(F.lit(constraint.min), value)
    return value


# --- people and companies -----------------------------------------------------------------


@generator("first_name")
def _first_name(c: Cell) -> Column:
    return c.pick(vocab.FIRST_NAMES)


@generator("last_name")
def _last_name(c: Cell) -> Column:
    return c.pick(vocab.LAST_NAMES)


@generator("name")
def _name(c: Cell) -> Column:
    return F.concat_ws(" ", c.pick(vocab.FIRST_NAMES, "first"), c.pick(vocab.LAST_NAMES, "last"))


@generator("email")
def _email(c: Cell) -> Column:
    return F.concat(
        F.lower(c.pick(vocab.FIRST_NAMES, "first")),
        c.draws.digits(4, "number"),
        F.lit("@"),
        c.pick(vocab.MAIL_DOMAINS, "domain"),
    )


@generator("phone_number")
def _phone(c: Cell) -> Column:
    digits = c.draws.digits(10)
    return F.concat(
        F.lit("+1-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4)
    )


@generator("job")
def _job(c: Cell) -> Column:
    return c.pick(vocab.JOBS)


@generator("company")
def _company(c: Cell) -> Column:
    return F.concat_ws(" ", c.pick(vocab.LAST_NAMES, "last"), c.pick(vocab.COMPANY_SUFFIXES, "suffix"))


@generator("company_suffix")
def _company_suffix(c: Cell) -> Column:
    return c.pick(vocab.COMPANY_SUFFIXES)


@generator("catch_phrase")
def _catch_phrase(c: Cell) -> Column:
    return F.concat_ws(
        " ",
        c.pick(vocab.PHRASE_ADJECTIVES, "adjective"),
        c.pick(vocab.PHRASE_QUALIFIERS, "qualifier"),
        c.pick(vocab.PHRASE_NOUNS, "noun"),
    )


# --- places and the web --------------------------------------------------------------------


@generator("domain_name")
def _domain_name(c: Cell) -> Column:
    return F.concat_ws(".", c.pick(vocab.WORDS, "word"), c.pick(vocab.TLDS, "tld"))


@generator("url")
def _url(c: Cell) -> Column:
    return F.concat(F.lit("https://www."), _domain_name(c), F.lit("/"))


@generator("uri_path")
def _uri_path(c: Cell) -> Column:
    return F.concat(F.lit("/"), c.pick(vocab.PATH_PARTS, "part"), F.lit("/"), c.pick(vocab.WORDS, "word"))


@generator("ipv4")
def _ipv4(c: Cell) -> Column:
    octets = [c.draws.below(254, f"octet{i}") + F.lit(1) for i in range(4)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


@generator("user_agent")
def _user_agent(c: Cell) -> Column:
    return F.concat(
        F.lit("Mozilla/5.0 ("),
        c.pick(vocab.AGENT_PLATFORMS, "platform"),
        F.lit(") Gecko/20100101 Firefox/"),
        (c.draws.below(40, "version") + F.lit(80)).cast("string"),
        F.lit(".0"),
    )


@generator("country")
def _country(c: Cell) -> Column:
    return c.pick(vocab.COUNTRIES)


@generator("country_code")
def _country_code(c: Cell) -> Column:
    return c.pick(vocab.COUNTRY_CODES)


@generator("city")
def _city(c: Cell) -> Column:
    return c.pick(vocab.CITIES)


@generator("street_address")
def _street_address(c: Cell) -> Column:
    return F.concat_ws(
        " ",
        (c.draws.below(9999, "number") + F.lit(1)).cast("string"),
        c.pick(vocab.LAST_NAMES, "street"),
        c.pick(vocab.STREET_SUFFIXES, "suffix"),
    )


@generator("zipcode")
def _zipcode(c: Cell) -> Column:
    return c.draws.digits(5)


# --- words ---------------------------------------------------------------------------------


@generator("word")
def _word(c: Cell) -> Column:
    return c.pick(vocab.WORDS)


@generator("text")
def _text(c: Cell) -> Column:
    """Words up to ``max`` characters (100 when absent or 0), ending in a full stop."""
    limit = int(c.constraint.max or DEFAULT_TEXT_LENGTH)
    words = max(1, limit // 6)
    count = c.draws.below(words, "count") + F.lit(1)
    base = F.shiftright(c.draws.u("words"), 1)
    every = F.transform(
        F.sequence(F.lit(1).cast("bigint"), count),
        lambda i: F.get(constant_array(vocab.WORDS), text_word_index(base + i, len(vocab.WORDS))),
    )
    body = F.substring(F.concat_ws(" ", every), 1, max(1, limit - 1))
    return F.concat(F.initcap(F.substring(body, 1, 1)), F.substring(body, 2, limit), F.lit("." if limit > 1 else ""))


def text_word_index(position: Column, size: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(position), 1) % F.lit(size)).cast("int")


def _choice(c: Cell) -> Column:
    values, weights = c.constraint.choices(), c.constraint.choice_weights()
    return c.draws.weighted(values, weights) if weights else c.pick(values)


@generator("random_element")
def _random_element(c: Cell) -> Column:
    return _word(c)


@generator("bothify")
def _bothify(c: Cell) -> Column:
    """``#`` becomes a digit, ``?`` a letter; every other character stays."""
    parts = []
    for i, run in enumerate(re.findall(r"#+|\?+|[^#?]+", c.constraint.format or DEFAULT_FORMAT)):
        if run[0] == "#":
            parts.append(c.draws.digits(len(run), f"run{i}"))
        elif run[0] == "?":
            parts.append(c.draws.letters(len(run), string.ascii_letters, f"run{i}"))
        else:
            parts.append(F.lit(run))
    return F.concat(*parts)


# --- numbers and identifiers ---------------------------------------------------------------


@generator("boolean")
def _boolean(c: Cell) -> Column:
    return c.draws.below(2) == F.lit(0)


@generator("random_int", "pyint")
def _random_int(c: Cell) -> Column:
    low = DEFAULT_INT[0] if c.constraint.min is None else int(c.constraint.min)
    high = DEFAULT_INT[1] if c.constraint.max is None else int(c.constraint.max)
    if low > high:
        raise ValueError(f"min {low} is above max {high}")
    span = high - low + 1
    return c.draws.below(span) + F.lit(low).cast("bigint")


def _decimal_bounds(bounds: Constraint) -> tuple[float, float, int]:
    low = DEFAULT_DECIMAL[0] if bounds.min is None else float(bounds.min)
    high = DEFAULT_DECIMAL[1] if bounds.max is None else float(bounds.max)
    digits = DEFAULT_DECIMAL[2] if bounds.right_digits is None else int(bounds.right_digits)
    if low > high:
        raise ValueError(f"min {low} is above max {high}")
    return low, high, digits


@generator("pydecimal")
def _pydecimal(c: Cell) -> Column:
    low, high, digits = _decimal_bounds(c.constraint)
    unit = 10**digits
    first, last = math.ceil(round(low * unit, 6)), math.floor(round(high * unit, 6))
    if first > last:  # no value with that many digits lies between the bounds
        return clamp(F.lit(low), c.constraint)
    value = (c.draws.below(last - first + 1) + F.lit(first).cast("bigint")).cast("double") / F.lit(float(unit))
    return value


@generator("uuid4")
def _uuid4(c: Cell) -> Column:
    high = c.draws.h("high").bitwiseAND(F.lit(~0xF000)).bitwiseOR(F.lit(0x4000))
    low = c.draws.h("low").bitwiseAND(F.lit(0x3FFFFFFFFFFFFFFF)).bitwiseOR(F.lit(-(1 << 63)))
    head, tail = F.lpad(F.lower(F.hex(high)), 16, "0"), F.lower(F.hex(low))
    return F.concat_ws(
        "-",
        F.substring(head, 1, 8),
        F.substring(head, 9, 4),
        F.substring(head, 13, 4),
        F.substring(tail, 1, 4),
        F.substring(tail, 5, 12),
    )


@generator("uuid_int")
def _uuid_int(c: Cell) -> Column:
    """A non-negative 63-bit integer; with ``unique`` three swap-and-mix rounds keep row numbers below 2**62 apart."""
    if not c.unique or len(c.draws.ids) != 1:
        return c.draws.u()
    low31 = (1 << 31) - 1
    row = c.draws.ids[0]
    row = F.when(row < F.lit(1 << 62), row).otherwise(F.raise_error(F.lit("unique ids need row numbers below 2**62")))
    left, right = F.shiftright(row, 31), row.bitwiseAND(F.lit(low31))
    for k in ("round0", "round1", "round2"):
        mixed = Draws((*c.draws.stream, k), [right]).u().bitwiseAND(F.lit(low31))
        left, right = right, left.bitwiseXOR(mixed)
    return F.shiftleft(left, 31).bitwiseOR(right)


# --- banking -------------------------------------------------------------------------------


@generator("currency_code")
def _currency_code(c: Cell) -> Column:
    return c.pick(vocab.CURRENCY_CODES)


@generator("swift")
def _swift(c: Cell) -> Column:
    return F.concat(
        c.draws.letters(4, string.ascii_uppercase, "bank"),
        c.pick(vocab.COUNTRY_CODES, "country"),
        c.draws.letters(2, string.ascii_uppercase + string.digits, "place"),
    )


@generator("bban")
def _bban(c: Cell) -> Column:
    return c.draws.digits(18)


@generator("iban")
def _iban(c: Cell) -> Column:
    """Country, two check digits (mod 97 of the rearranged number) and an all-digit account."""
    codes = list(vocab.IBAN_DIGITS)
    at = c.draws.below(len(codes), "country").cast("int")
    length = F.get(constant_array(vocab.IBAN_DIGITS.values(), "int"), at)
    size = F.get(constant_array([10**n for n in vocab.IBAN_DIGITS.values()], "bigint"), at)
    tail = F.get(constant_array([int("".join(str(int(ch, 36)) for ch in code) + "00") % 97 for code in codes], "bigint"), at)
    account = c.draws.u("account") % size
    rest = (account % F.lit(97) * F.lit(10**6 % 97) + tail) % F.lit(97)
    check = F.lit(98) - rest
    return F.concat(
        F.get(constant_array(codes), at),
        F.lpad(check.cast("string"), 2, "0"),
        F.lpad(account.cast("string"), length, F.lit("0")),
    )


# --- dates ---------------------------------------------------------------------------------


def _day_between(c: Cell, first: date, last: date) -> Column:
    if first > last:
        raise ValueError(f"start {first} is after end {last}")
    return F.date_add(F.lit(first), c.draws.below((last - first).days + 1).cast("int"))


@generator("date_between")
def _date_between(c: Cell) -> Column:
    first = resolve_date(c.constraint.start or DEFAULT_DATES[0], c.as_of)
    last = resolve_date(c.constraint.end or DEFAULT_DATES[1], c.as_of)
    return _day_between(c, first, last)


@generator("date_of_birth")
def _date_of_birth(c: Cell) -> Column:
    youngest = DEFAULT_AGES[0] if c.constraint.min_age is None else c.constraint.min_age
    oldest = DEFAULT_AGES[1] if c.constraint.max_age is None else c.constraint.max_age
    if youngest > oldest:
        raise ValueError(f"min_age {youngest} is above max_age {oldest}")
    return _day_between(c, years_before(c.as_of, oldest + 1) + timedelta(days=1), years_before(c.as_of, youngest))


@generator("date_time")
def _date_time(c: Cell) -> Column:
    seconds = c.draws.below(max(1, (c.as_of - EPOCH).days * 86_400))
    return F.timestamp_add("SECOND", seconds, F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"))
