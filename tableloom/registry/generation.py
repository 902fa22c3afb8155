"""Generated tables: one row per row of a test table, or as many rows as it has."""

from __future__ import annotations

import string
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions import vocab
from tableloom.functions.dates import resolve_date, years_before
from tableloom.plans.generate import Run, flat_dataset, generate, grouped_dataset
from tableloom.plans.message import SAMPLE_CHOICES, sample_rows
from tableloom.plans.spec import Constraint, DatasetSpec, Field, GroupConfig, Request, SharedKey
from tableloom.registry.sql import draws, letters, load, padded, pick, share, text
from tableloom.sources.builtin import DEMO_FIELDS

QUERIES, ORACLES = {}, {}
SEED = 42
AS_OF = date(2024, 6, 1)
RUN = Run(SEED, homogeneity=100, as_of=AS_OF)
OWN = Run(SEED, homogeneity=1, as_of=AS_OF)


def _fields(*specs) -> tuple[Field, ...]:
    return tuple(Field.from_dict(dict(zip(("name", "generator", "type", "constraint"), s))) for s in specs)


def _per_row(name: str, table: str, key: str, fields: tuple[Field, ...], values: dict[str, str], streams: dict) -> None:
    """Register a flat dataset with one row per row of ``table``, and its SQL."""
    spec = DatasetSpec(name, rows=1, fields=fields)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return flat_dataset(spark, spec, RUN, row_ids=load(spark, sf, table).select(key), keep_row_id=True)

    QUERIES[name] = run
    made = ", ".join(f'{sql} AS "{column}"' for column, sql in values.items())
    ORACLES[name] = f"SELECT row_id, {made} FROM ({draws(f'SELECT {key} AS row_id FROM {table}', ['row_id'], streams)})"


def _streams(name: str, fields: tuple[Field, ...], parts: dict[str, tuple] = {}) -> dict[str, tuple]:
    """Streams by SQL name: ``field`` for its first draw, ``field__part`` for its named ones."""
    found = {}
    for f in fields:
        stream = RUN.stream(name, f)
        for part in parts.get(f.name, (0,)):
            found[f.name if part == 0 else f"{f.name}__{part}"] = (*stream, part)
    return found


# --- numbers, choices, dates, identifiers --------------------------------------------------

_F = _fields(
    ("age", "random_int", "integer", {"min": 18, "max": 99}),
    ("plain", "pyint", "integer"),
    ("debt", "random_int", "integer", {"min": -120, "max": -30}),
    ("price", "pydecimal", "float"),
    ("latitude", "pydecimal", "float", {"min": -90, "max": 90, "right_digits": 6}),
    ("cents", "pydecimal", "string", {"min": 0.5, "max": 2.25, "right_digits": 2}),
    ("flag", "boolean", "boolean"),
    ("big", "uuid_int", "integer"),
)
_per_row(
    "gen_numbers", "orders", "o_orderkey", _F,
    {
        "age": "age % 82 + 18",
        "plain": "plain % 1000000",
        "debt": "debt % 91 - 120",
        "price": "(price % 100000000)::DOUBLE / 100",
        "latitude": "(latitude % 180000001 - 90000000)::DOUBLE / 1000000",
        "cents": "((cents % 176 + 50)::DOUBLE / 100)::VARCHAR",
        "flag": "flag % 2 = 0",
        "big": "big",
    },
    _streams("gen_numbers", _F),
)

_F = _fields(
    ("gender", "random_element", "string", {"values": "Male, Female ,Non-binary"}),
    ("status", "random_element", "integer", {"values": "200,301,404,500"}),
    ("tier", "random_element", "string", {"values": "gold,silver,bronze", "weights": "10, 20,70"}),
    ("lopsided", "random_element", "string", {"values": "a,b", "weights": "1,0"}),
    ("free", "random_element", "string"),
    ("currency", "currency_code", "string", {"values": "EUR,USD"}),
    ("surprise", "no_such_generator", "string"),
)
_per_row(
    "gen_choice", "orders", "o_orderkey", _F,
    {
        "gender": pick(["Male", "Female", "Non-binary"], "gender"),
        "status": pick([200, 301, 404, 500], "status") + "::BIGINT",
        "tier": f"CASE WHEN tier < {share(0.1)} THEN 'gold' WHEN tier < {share(0.3)} THEN 'silver' ELSE 'bronze' END",
        "lopsided": "'a'",
        "free": pick(vocab.WORDS, "free"),
        "currency": pick(["EUR", "USD"], "currency"),
        "surprise": pick(vocab.WORDS, "surprise"),
    },
    _streams("gen_choice", _F),
)

_F = _fields(
    ("device", "bothify", "string", {"format": "DEV-????-########"}),
    ("version", "bothify", "string", {"format": "#.##.##"}),
    ("code", "bothify", "string"),
)
_per_row(
    "gen_bothify", "orders", "o_orderkey", _F,
    {
        "device": f"'DEV-' || {letters('device__run1', 4, string.ascii_letters)} || '-' || {padded('device__run3', 8)}",
        "version": f"{padded('version__run0', 1)} || '.' || {padded('version__run2', 2)} || '.' || {padded('version__run4', 2)}",
        "code": f"{letters('code__run0', 5, string.ascii_letters)} || {padded('code__run1', 5)}",
    },
    _streams(
        "gen_bothify", _F,
        {"device": ("run1", "run3"), "version": ("run0", "run2", "run4"), "code": ("run0", "run1")},
    ),
)


def _days(name: str, first: date, last: date) -> str:
    return f"(DATE '{first}' + ({name} % {(last - first).days + 1})::INT)"


_F = _fields(
    ("seen", "date_between", "date"),
    ("recent", "date_between", "date", {"start": "-30d", "end": "today"}),
    ("fixed", "date_between", "string", {"start": "2020-02-01", "end": "2020-03-01"}),
    ("born", "date_of_birth", "date", {"min_age": 18, "max_age": 65}),
    ("moment", "date_time", "timestamp"),
    ("moment_text", "date_time", "string"),
    ("moment_day", "date_time", "date"),
)
_SECONDS = (AS_OF - date(1970, 1, 1)).days * 86_400
_per_row(
    "gen_dates", "orders", "o_orderkey", _F,
    {
        "seen": _days("seen", resolve_date("-5y", AS_OF), AS_OF),
        "recent": _days("recent", AS_OF - timedelta(days=30), AS_OF),
        "fixed": _days("fixed", date(2020, 2, 1), date(2020, 3, 1)) + "::VARCHAR",
        "born": _days("born", years_before(AS_OF, 66) + timedelta(days=1), years_before(AS_OF, 18)),
        "moment": f"make_timestamp((moment % {_SECONDS}) * 1000000)",
        "moment_text": f"strftime(make_timestamp((moment_text % {_SECONDS}) * 1000000), '%Y-%m-%dT%H:%M:%S')",
        "moment_day": f"make_timestamp((moment_day % {_SECONDS}) * 1000000)::DATE",
    },
    _streams("gen_dates", _F),
)

_HEX_HIGH = f"lpad(lower(to_hex((uid__high_h - uid__high_h % 65536 + 16384 + uid__high_h % 4096)::UBIGINT)), 16, '0')"
_HEX_LOW = f"lower(to_hex((uid__low_h % {1 << 62}::UHUGEINT + {1 << 63}::UHUGEINT)::UBIGINT))"
_F = _fields(("uid", "uuid4"))
_per_row(
    "gen_uuid", "lineitem", "l_orderkey * 8 + l_linenumber", _F,
    {
        "uid": f"""concat_ws('-', substr({_HEX_HIGH}, 1, 8), substr({_HEX_HIGH}, 9, 4), substr({_HEX_HIGH}, 13, 4),
            substr({_HEX_LOW}, 1, 4), substr({_HEX_LOW}, 5, 12))"""
    },
    _streams("gen_uuid", _F, {"uid": ("high", "low")}),
)


def gen_uuid(spark, sf):
    ids = load(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return flat_dataset(spark, DatasetSpec("gen_uuid", 1, _fields(("uid", "uuid4"))), RUN, row_ids=ids, keep_row_id=True)


QUERIES["gen_uuid"] = gen_uuid

_UNIQUE = (
    Field("code", "random_int", "integer", True, constraint=Constraint(min=1000, max=10_000_000)),
    Field("big", "uuid_int", "integer", True),
)


def gen_unique(spark, sf):
    ids = load(spark, sf, "orders").select("o_orderkey")
    made = flat_dataset(spark, DatasetSpec("gen_unique", 1, _UNIQUE), RUN, row_ids=ids)
    return made.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("code").alias("codes"),
        F.count_distinct("big").alias("bigs"),
        (F.min("code") >= 1000).alias("low_ok"),
        (F.max("code") <= 10_000_000).alias("high_ok"),
        (F.min("big") >= 0).alias("big_ok"),
    )


QUERIES["gen_unique"] = gen_unique
ORACLES["gen_unique"] = (
    "SELECT count(*) AS n, count(*) AS codes, count(*) AS bigs, true AS low_ok, true AS high_ok, true AS big_ok FROM orders"
)

_CODE = {"unique": True, "constraint": Constraint(format="??-###??")}


def gen_unique_fields(spark, sf):
    """Fields of several kinds marked unique, over the keys of a table and over the rows of groups: counts of their values."""
    fields = (Field("code", "bothify", **_CODE), Field("seen", "date_time", "timestamp", True), Field("address", "ipv4", unique=True))
    ids = load(spark, sf, "orders").select("o_orderkey")
    flat = flat_dataset(spark, DatasetSpec("gen_unique_fields", 1, fields), RUN, row_ids=ids)
    group = GroupConfig(40, 75, (Field("firm", "bothify", **_CODE),), (Field("tag", "bothify", **_CODE),))
    grouped = grouped_dataset(spark, DatasetSpec("gen_unique_groups", _rows(spark, sf, "orders"), group_config=group), RUN)
    counts = [F.count_distinct(c).alias(c) for c in ("code", "seen", "address")]
    one = flat.agg(F.count(F.lit(1)).alias("n"), *counts)
    parents = F.count_distinct(F.when(F.col("parent_id").isNotNull(), F.col("firm"))).alias("firms")
    other = grouped.agg(F.count(F.lit(1)).alias("grouped"), F.count_distinct("tag").alias("tags"), parents).first()
    return one.withColumns({c: F.lit(other[c]).cast("bigint") for c in ("grouped", "tags", "firms")})


QUERIES["gen_unique_fields"] = gen_unique_fields
ORACLES["gen_unique_fields"] = (
    "SELECT count(*) AS n, count(*) AS code, count(*) AS seen, count(*) AS address, count(*) AS grouped, count(*) AS tags, 40::BIGINT AS firms FROM orders"
)

# --- people, web, banking, text ------------------------------------------------------------

_F = _fields(
    ("first", "first_name"), ("last", "last_name"), ("full", "name"), ("mail", "email"), ("phone", "phone_number"),
    ("work", "job"), ("firm", "company"), ("suffix", "company_suffix"), ("phrase", "catch_phrase"), ("land", "country"),
    ("land_code", "country_code"), ("town", "city"), ("street", "street_address"), ("zip", "zipcode"),
)
_PHONE = padded("phone", 10)
_per_row(
    "gen_person", "customer", "c_custkey", _F,
    {
        "first": pick(vocab.FIRST_NAMES, "first"),
        "last": pick(vocab.LAST_NAMES, "last"),
        "full": f"{pick(vocab.FIRST_NAMES, 'full__first')} || ' ' || {pick(vocab.LAST_NAMES, 'full__last')}",
        "mail": f"lower({pick(vocab.FIRST_NAMES, 'mail__first')}) || {padded('mail__number', 4)} || '@' || {pick(vocab.MAIL_DOMAINS, 'mail__domain')}",
        "phone": f"'+1-' || substr({_PHONE}, 1, 3) || '-' || substr({_PHONE}, 4, 3) || '-' || substr({_PHONE}, 7, 4)",
        "work": pick(vocab.JOBS, "work"),
        "firm": f"{pick(vocab.LAST_NAMES, 'firm__last')} || ' ' || {pick(vocab.COMPANY_SUFFIXES, 'firm__suffix')}",
        "suffix": pick(vocab.COMPANY_SUFFIXES, "suffix"),
        "phrase": f"{pick(vocab.PHRASE_ADJECTIVES, 'phrase__adjective')} || ' ' || {pick(vocab.PHRASE_QUALIFIERS, 'phrase__qualifier')} || ' ' || {pick(vocab.PHRASE_NOUNS, 'phrase__noun')}",
        "land": pick(vocab.COUNTRIES, "land"),
        "land_code": pick(vocab.COUNTRY_CODES, "land_code"),
        "town": pick(vocab.CITIES, "town"),
        "street": f"(street__number % 9999 + 1) || ' ' || {pick(vocab.LAST_NAMES, 'street__street')} || ' ' || {pick(vocab.STREET_SUFFIXES, 'street__suffix')}",
        "zip": padded("zip", 5),
    },
    _streams(
        "gen_person", _F,
        {
            "full": ("first", "last"), "mail": ("first", "number", "domain"), "firm": ("last", "suffix"),
            "phrase": ("adjective", "qualifier", "noun"), "street": ("number", "street", "suffix"),
        },
    ),
)

_F = _fields(("domain", "domain_name"), ("link", "url"), ("path", "uri_path"), ("ip", "ipv4"), ("agent", "user_agent"), ("tag", "word"))
_per_row(
    "gen_weblog", "events", "event_id", _F,
    {
        "domain": f"{pick(vocab.WORDS, 'domain__word')} || '.' || {pick(vocab.TLDS, 'domain__tld')}",
        "link": f"'https://www.' || {pick(vocab.WORDS, 'link__word')} || '.' || {pick(vocab.TLDS, 'link__tld')} || '/'",
        "path": f"'/' || {pick(vocab.PATH_PARTS, 'path__part')} || '/' || {pick(vocab.WORDS, 'path__word')}",
        "ip": " || '.' || ".join(f"(ip__octet{i} % 254 + 1)" for i in range(4)),
        "agent": f"'Mozilla/5.0 (' || {pick(vocab.AGENT_PLATFORMS, 'agent__platform')} || ') Gecko/20100101 Firefox/' || (agent__version % 40 + 80) || '.0'",
        "tag": pick(vocab.WORDS, "tag"),
    },
    _streams(
        "gen_weblog", _F,
        {
            "domain": ("word", "tld"), "link": ("word", "tld"), "path": ("part", "word"),
            "ip": tuple(f"octet{i}" for i in range(4)), "agent": ("platform", "version"),
        },
    ),
)

_CODES = list(vocab.IBAN_DIGITS)
_SIZE = f"([{', '.join(str(10 ** d) for d in vocab.IBAN_DIGITS.values())}])[iban__country % {len(_CODES)} + 1]"
_LENGTH = f"([{', '.join(str(d) for d in vocab.IBAN_DIGITS.values())}])[iban__country % {len(_CODES)} + 1]"
_LETTERS = f"([{', '.join(repr(''.join(str(int(ch, 36)) for ch in code)) for code in _CODES)}])[iban__country % {len(_CODES)} + 1]"
_ACCOUNT = f"lpad((iban__account % {_SIZE})::VARCHAR, {_LENGTH}, '0')"
_F = _fields(("currency", "currency_code"), ("bic", "swift"), ("iban", "iban"), ("bban", "bban"))
_per_row(
    "gen_finance", "supplier", "s_suppkey", _F,
    {
        "currency": pick(vocab.CURRENCY_CODES, "currency"),
        "bic": f"{letters('bic__bank', 4, string.ascii_uppercase)} || {pick(vocab.COUNTRY_CODES, 'bic__country')} || {letters('bic__place', 2, string.ascii_uppercase + string.digits)}",
        "iban": f"""{pick(_CODES, 'iban__country')} || lpad((98 - ({_ACCOUNT} || {_LETTERS} || '00')::HUGEINT % 97)::VARCHAR, 2, '0')
            || {_ACCOUNT}""",
        "bban": padded("bban", 18),
    },
    _streams("gen_finance", _F, {"bic": ("bank", "country", "place"), "iban": ("country", "account")}),
)

_TEXT = Field("body", "text", constraint=Constraint(max=60))


def gen_text(spark, sf):
    ids = load(spark, sf, "customer").select("c_custkey")
    return flat_dataset(spark, DatasetSpec("gen_text", 1, (_TEXT,)), RUN, row_ids=ids, keep_row_id=True)


def _text_sql() -> str:
    rows = draws(
        "SELECT c_custkey AS row_id FROM customer", ["row_id"],
        {part: (*RUN.stream("gen_text", _TEXT), part) for part in ("count", "words")},
    )
    words = f"SELECT row_id, unnest(range(1, (count % 10 + 2)::BIGINT)) AS i, words >> 1 AS base FROM ({rows})"
    picked = draws(f"SELECT row_id, i, base + i AS pos FROM ({words})", ["pos"], {"w": None})
    joined = f"SELECT row_id, string_agg({pick(vocab.WORDS, 'w')}, ' ' ORDER BY i) AS t FROM ({picked}) GROUP BY row_id"
    return (
        f"SELECT row_id, upper(left(b, 1)) || substr(b, 2) || '.' AS body "
        f"FROM (SELECT row_id, substr(t, 1, 59) AS b FROM ({joined}))"
    )


QUERIES["gen_text"] = gen_text
ORACLES["gen_text"] = _text_sql()

# --- nulls, conditions, formulas -----------------------------------------------------------

_NULLS = (
    Field("age", "random_int", "integer", constraint=Constraint(min=0, max=99)),
    Field("maybe", "random_int", "integer", null_probability=0.25, constraint=Constraint(min=0, max=9)),
    Field("never", "name", null_probability=1.0),
    Field("adult", "random_int", "integer", condition="age >= 18", constraint=Constraint(min=1, max=5)),
    Field("five", "random_int", "integer", condition="maybe == 5", constraint=Constraint(min=1, max=5)),
    Field("kind", "random_element", constraint=Constraint(values="new,old")),
    Field("old_only", "random_int", "integer", condition="kind != 'new'", constraint=Constraint(min=1, max=5)),
    Field("mismatch", "random_int", "integer", condition="kind > 3", constraint=Constraint(min=1, max=5)),
    Field("open", "random_int", "integer", condition="nothing > 3", constraint=Constraint(min=1, max=5)),
    Field("rare", "random_int", "integer", null_probability=0.5, condition="age < 50", constraint=Constraint(min=1, max=5)),
)
_per_row(
    "gen_null_condition", "orders", "o_orderkey", _NULLS,
    {
        "age": "age % 100",
        "maybe": f"CASE WHEN maybe__null < {share(0.25)} THEN NULL ELSE maybe % 10 END",
        "never": "NULL::VARCHAR",
        "adult": "CASE WHEN age % 100 >= 18 THEN adult % 5 + 1 END",
        "five": f"CASE WHEN maybe__null >= {share(0.25)} AND maybe % 10 = 5 THEN five % 5 + 1 END",
        "kind": pick(["new", "old"], "kind"),
        "old_only": f"CASE WHEN {pick(['new', 'old'], 'kind')} <> 'new' THEN old_only % 5 + 1 END",
        "mismatch": "NULL::BIGINT",
        "open": "open % 5 + 1",
        "rare": f"CASE WHEN rare__null >= {share(0.5)} AND age % 100 < 50 THEN rare % 5 + 1 END",
    },
    _streams("gen_null_condition", _NULLS, {"maybe": (0, "null"), "rare": (0, "null")}),
)

_FORMULAS = (
    Field("first_name", "first_name"),
    Field("last_name", "last_name"),
    Field("price", "random_int", "integer", constraint=Constraint(min=1, max=500)),
    Field("units", "random_int", "integer", null_probability=0.1, constraint=Constraint(min=1, max=9)),
    Field("email", "formula", formula="{{ first_name|lower }}.{{ last_name|lower }}@example.com"),
    Field("site", "formula", formula="https://www.{{ last_name|lower|replace('a', '') }}.com"),
    Field("total", "formula", "integer", formula="{{ price * (2 + 1) - 1 }}"),
    Field("label", "formula", formula="{{ units }} x {{ first_name|upper ~ '/' ~ price }} {{ units|default(0, true) }} {{ missing }}!"),
    Field("chained", "formula", formula="<{{ email|length }}:{{ site|capitalize }}>"),
    Field("fixed", "formula", formula="no places"),
)
_FIRST, _LAST = pick(vocab.FIRST_NAMES, "first_name"), pick(vocab.LAST_NAMES, "last_name")
_EMAIL = f"(lower({_FIRST}) || '.' || lower({_LAST}) || '@example.com')"
_SITE = f"('https://www.' || replace(lower({_LAST}), 'a', '') || '.com')"
_UNITS = f"CASE WHEN units__null < {share(0.1)} THEN NULL ELSE units % 9 + 1 END"
_per_row(
    "gen_formula", "orders", "o_orderkey", _FORMULAS,
    {
        "first_name": _FIRST,
        "last_name": _LAST,
        "price": "price % 500 + 1",
        "units": _UNITS,
        "email": _EMAIL,
        "site": _SITE,
        "total": "(price % 500 + 1) * 3 - 1",
        "label": f"coalesce(({_UNITS})::VARCHAR, 'None') || ' x ' || upper({_FIRST}) || '/' || (price % 500 + 1) || ' ' || coalesce({_UNITS}, 0) || ' !'",
        "chained": f"'<' || length({_EMAIL}) || ':H' || substr({_SITE}, 2) || '>'",
        "fixed": "'no places'",
    },
    _streams("gen_formula", _FORMULAS[:4], {"units": (0, "null")}),
)

_RULES = (
    Field("first_name", "first_name"),
    Field("n", "random_int", "integer", null_probability=0.2, constraint=Constraint(min=0, max=20)),
    Field("rate", "pydecimal", "float", constraint=Constraint(min=0, max=9, right_digits=2)),
    Field("code", "formula", formula="{{ first_name[0]|lower }}{{ first_name[-2:] }}-{{ '%04d'|format(row) if row is defined else '0' }}"),
    Field("size", "formula", formula="{% if n is none %}unknown{% elif n > 10 %}large{% else %}small {{ n * 2 }}{% endif %}"),
    Field("share", "formula", formula="{{ 6 // n }} of {{ n }}"),
    Field("twice", "formula", "float", formula="{{ (rate * 2)|round(1) }}"),
    Field("either", "formula", formula="{{ n or 'nothing' }}{{ ', yes' if n == 7 or first_name == 'Ada' }}"),
)
_N = f"(CASE WHEN n__null < {share(0.2)} THEN NULL ELSE n % 21 END)"
_RATE = "((rate % 901)::DOUBLE / 100)"
_per_row(
    "gen_formula_rules", "orders", "o_orderkey", _RULES,
    {
        "first_name": _FIRST,
        "n": _N,
        "rate": _RATE,
        "code": f"lower(left({_FIRST}, 1)) || right({_FIRST}, 2) || '-0'",
        "size": f"CASE WHEN {_N} IS NULL THEN 'unknown' WHEN {_N} > 10 THEN 'large' ELSE 'small ' || ({_N} * 2) END",
        "share": f"CASE WHEN coalesce({_N}, 0) = 0 THEN '{{{{ 6 // n }}}} of {{{{ n }}}}' ELSE (6 // {_N}) || ' of ' || {_N} END",
        # whole hundredths times two, rounded half to even at exact ties
        "twice": "round_even((rate % 901)::DECIMAL(10,0) * 2 / 100, 1)::DOUBLE",
        "either": f"CASE WHEN coalesce({_N}, 0) = 0 THEN 'nothing' ELSE {_N}::VARCHAR END || CASE WHEN {_N} = 7 OR {_FIRST} = 'Ada' THEN ', yes' ELSE '' END",
    },
    _streams("gen_formula_rules", _RULES[:3], {"n": (0, "null")}),
)

_STEPS = "{% for i in range(n) %}{{ i * i }}{{ ',' if not loop.last }}{% else %}none{% endfor %}"
_LOOPS = (
    Field("first_name", "first_name"),
    Field("n", "random_int", "integer", null_probability=0.2, constraint=Constraint(min=0, max=9)),
    Field("steps", "formula", formula=_STEPS),
    Field("letters", "formula", formula="{% set name = first_name|lower %}{% for c in name if c != 'a' %}{{ loop.index }}{{ c }}{% endfor %}/{{ name|length }}"),
    Field("total", "formula", "integer", formula="{% set ns = namespace(sum=0) %}{% for i in range(1, 6) %}{% set ns.sum = ns.sum + i * (n or 1) %}{% endfor %}{{ ns.sum }}"),
    Field("tags", "formula", formula="{% macro tag(x, close=true) %}<{{ x }}>{{ '</' ~ x ~ '>' if close }}{% endmacro %}{% for w in ['b', first_name] %}{{ tag(w, loop.first) }}{% endfor %}"),
)
_M = f"(CASE WHEN n__null < {share(0.2)} THEN NULL ELSE n % 10 END)"
_per_row(
    "gen_formula_loops", "orders", "o_orderkey", _LOOPS,
    {
        "first_name": _FIRST,
        "n": _M,
        "steps": f"CASE WHEN {_M} IS NULL THEN {text(_STEPS)} WHEN {_M} = 0 THEN 'none' ELSE array_to_string(list_transform(range(({_M})::BIGINT), lambda i: i * i), ',') END",
        "letters": f"""array_to_string(list_transform(range(1, 1 + length(replace(lower({_FIRST}), 'a', ''))),
            lambda i: i || substr(replace(lower({_FIRST}), 'a', ''), i::BIGINT, 1)), '') || '/' || length({_FIRST})""",
        "total": f"15 * CASE WHEN coalesce({_M}, 0) = 0 THEN 1 ELSE {_M} END",
        "tags": f"'<b></b><' || {_FIRST} || '>'",
    },
    _streams("gen_formula_loops", _LOOPS[:2], {"n": (0, "null")}),
)

# --- several datasets in one run -----------------------------------------------------------

_PAIR = _fields(("age", "random_int", "integer"), ("town", "city"), ("uid", "uuid4"), ("code", "bothify"))


def _rows(spark, sf, table: str) -> int:
    return load(spark, sf, table).count()


def _same_columns(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    both = left.alias("a").join(right.alias("b"), "row_id")
    equal = [F.sum((F.col(f"a.{n}") == F.col(f"b.{n}")).cast("bigint")).alias(n) for n in names]
    return both.agg(F.count(F.lit(1)).alias("n"), *equal)


def gen_homogeneity(spark, sf):
    """At 100 same-named fields repeat their column in both datasets; identifiers never do."""
    ids = load(spark, sf, "orders").select("o_orderkey")
    one, two = (
        flat_dataset(spark, DatasetSpec(n, 1, _PAIR), RUN, row_ids=ids, keep_row_id=True) for n in ("one", "two")
    )
    return _same_columns(one, two, ["age", "town", "uid"])


QUERIES["gen_homogeneity"] = gen_homogeneity
ORACLES["gen_homogeneity"] = "SELECT count(*) AS n, count(*) AS age, count(*) AS town, 0::BIGINT AS uid FROM orders"


def gen_own_streams(spark, sf):
    """At the lowest homogeneity each dataset draws its own column."""
    ids = load(spark, sf, "orders").select("o_orderkey")
    spec = DatasetSpec("apart", 1, _fields(("age", "random_int", "integer")))
    return flat_dataset(spark, spec, OWN, row_ids=ids, keep_row_id=True)


_APART = draws("SELECT o_orderkey AS row_id FROM orders", ["row_id"], {"age": (SEED, "apart", "age", 0)})
QUERIES["gen_own_streams"] = gen_own_streams
ORACLES["gen_own_streams"] = f"SELECT row_id, age % 1000000 AS age FROM ({_APART})"


def gen_overlap(spark, sf):
    """The first k rows of both datasets share the exact field; k is half the smaller dataset."""
    sizes = {"big": _rows(spark, sf, "orders"), "small": _rows(spark, sf, "customer")}
    fields = _fields(("cust_id", "uuid4"), ("age", "random_int", "integer"))
    request = Request(
        tuple(DatasetSpec(n, rows, fields) for n, rows in sizes.items()),
        homogeneity=1, seed=SEED, overlap_ratio=0.5, exact_fields=("cust_id",),
    )
    made = generate(spark, request, AS_OF)
    big, small = made.datasets["big"], made.datasets["small"]
    shared = big.join(small.select("cust_id"), "cust_id", "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("shared"), F.lit(made.overlap_pool_size).cast("bigint").alias("pool"))


QUERIES["gen_overlap"] = gen_overlap
ORACLES["gen_overlap"] = "SELECT count(*) // 2 AS shared, count(*) // 2 AS pool FROM customer"

_FAMILY = GroupConfig(
    num_groups=1, split_pct=80,
    parent_fields=_fields(("firm", "company"), ("size", "random_int", "integer", {"min": 1, "max": 500})),
    child_fields=(*_fields(("worker", "name"), ("pay", "random_int", "integer")), Field("tag", "formula", formula="{{ firm }}:{{ worker }}")),
)


def _family_spec(spark, sf) -> DatasetSpec:
    group = GroupConfig(_rows(spark, sf, "customer"), 80, _FAMILY.parent_fields, _FAMILY.child_fields)
    return DatasetSpec("family", _rows(spark, sf, "orders"), group_config=group)


def gen_grouped(spark, sf):
    """Group sizes, and that all rows of a group repeat its parent values."""
    made = grouped_dataset(spark, _family_spec(spark, sf), RUN)
    sizes = made.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(F.col("parent_id").isNotNull(), F.min("firm") == F.max("firm")).alias("one_parent"),
        F.every(F.col("tag") == F.concat_ws(":", "firm", "worker")).alias("tagged"),
    )
    return sizes.groupBy("rows", "one_parent", "tagged").agg(F.count(F.lit(1)).alias("groups"))


_SIZES = draws(
    "SELECT unnest(range((SELECT count(*) FROM customer))) AS g", ["g"], {"w": (SEED, "family", "group_size", 0)}
)
_GROUPED = f"""WITH t AS (SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM customer) AS g),
    w AS (SELECT g, w % 65536 + 1 AS w FROM ({_SIZES})),
    s AS (SELECT w.g, ((t.n * 80 // 100 - t.g) * w.w) // (SELECT sum(w)::BIGINT FROM w) AS part, t.n, t.g AS groups FROM w, t),
    z AS (SELECT g, 1 + part + CASE WHEN g < (n * 80 // 100 - groups) - (SELECT sum(part)::BIGINT FROM s) THEN 1 ELSE 0 END AS rows FROM s)"""
QUERIES["gen_grouped"] = gen_grouped
ORACLES["gen_grouped"] = (
    f"{_GROUPED} SELECT rows, true AS one_parent, true AS tagged, count(*) AS groups FROM z GROUP BY rows "
    "UNION ALL SELECT n - n * 80 // 100, NULL, true, 1 FROM t"
)


def gen_grouped_values(spark, sf):
    """Parent and child values of all grouped rows."""
    made = grouped_dataset(spark, _family_spec(spark, sf), RUN).where(F.col("parent_id").isNotNull())
    return made.select("size", "pay")


_MEMBERS = f"{_GROUPED} SELECT g, unnest(range(rows::BIGINT)) AS c FROM z"
_PARENT = draws(_MEMBERS, ["g"], {"size": (SEED, "parent_size", "", 0)})
_CHILD = draws(f"SELECT g, c, size FROM ({_PARENT})", ["g", "c"], {"pay": (SEED, "child_pay", "", 0)})
QUERIES["gen_grouped_values"] = gen_grouped_values
ORACLES["gen_grouped_values"] = f"SELECT size % 500 + 1 AS size, pay % 1000000 AS pay FROM ({_CHILD})"


def gen_shared_key(spark, sf):
    """Orders that refer to random rows of the customer key column."""
    spec = DatasetSpec(
        "refs", 1, (Field("cust", "shared_key", "integer"),), shared_key=SharedKey("customer", "c_custkey")
    )
    ids = load(spark, sf, "orders").select("o_orderkey")
    return flat_dataset(spark, spec, RUN, {"customer": load(spark, sf, "customer")}, row_ids=ids, keep_row_id=True)


_POOL = """SELECT v, row_number() OVER (ORDER BY ('0x' || substr(md5(coalesce(v::VARCHAR, '\\N')), 1, 8))::BIGINT % 4096,
    v NULLS LAST) - 1 AS i FROM ({rows})"""


def _shared_sql(dataset: str, table: str, key: str, pool: str) -> str:
    drawn = draws(f"SELECT {key} AS row_id FROM {table}", ["row_id"], {"u": (SEED, dataset, "cust", 0)})
    return f"""WITH pool AS ({_POOL.format(rows=pool)}) SELECT row_id, v AS cust
        FROM ({drawn}) d LEFT JOIN pool ON d.u % (SELECT count(*) FROM pool) = i"""


QUERIES["gen_shared_key"] = gen_shared_key
ORACLES["gen_shared_key"] = _shared_sql("refs", "orders", "o_orderkey", "SELECT c_custkey AS v FROM customer")


def gen_shared_key_repeats(spark, sf):
    """A pool with repeats and a value that fills a third of it."""
    pool = load(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("o_custkey")).alias("k")
    )
    spec = DatasetSpec("again", 1, (Field("cust", "shared_key", "integer"),), shared_key=SharedKey("orders", "k"))
    ids = load(spark, sf, "customer").select("c_custkey")
    return flat_dataset(spark, spec, RUN, {"orders": pool}, row_ids=ids, keep_row_id=True)


QUERIES["gen_shared_key_repeats"] = gen_shared_key_repeats
ORACLES["gen_shared_key_repeats"] = _shared_sql(
    "again", "customer", "c_custkey", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS v FROM orders"
)


# --- message samples -----------------------------------------------------------------------


def gen_message_samples(spark, sf):
    """Sample values of the demo message for every supplier row."""
    fields = [(name, made, values) for name, _, made, _, _, values in DEMO_FIELDS]
    return sample_rows(spark, fields, SEED, row_ids=load(spark, sf, "supplier").select("s_suppkey"))


def _samples_sql() -> str:
    streams, values = {}, {}
    for name, _, made, _, _, choices in DEMO_FIELDS:
        column = f"d_{name}"
        streams[column] = (SEED, "sample", name, 0)
        if made == "iban":
            streams[f"{column}_check"] = (SEED, "sample", name, "check")
            streams[f"{column}_account"] = (SEED, "sample", name, "account")
            values[name] = f"'DE' || ({column}_check % 90 + 10) || '100' || ({column}_account % 9000000000 + 1000000000)"
        elif made == "random_element" and choices:
            values[name] = pick(choices, column)
        elif made in SAMPLE_CHOICES:
            values[name] = pick(SAMPLE_CHOICES[made], column)
        elif made == "pydecimal":
            values[name] = f"(({column} % 99999999 + 1)::DOUBLE / 100)::VARCHAR"
        elif made == "random_int":
            values[name] = f"({column} % 1000000)::VARCHAR"
        else:
            values[name] = f"'REF-' || ({column} % 100000)"
    drawn = draws("SELECT s_suppkey AS row_id FROM supplier", ["row_id"], streams)
    return f"SELECT row_id, {', '.join(f'{v} AS "{n}"' for n, v in values.items())} FROM ({drawn})"


QUERIES["gen_message_samples"] = gen_message_samples
ORACLES["gen_message_samples"] = _samples_sql()
