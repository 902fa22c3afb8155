from datetime import date

import pytest

from tableloom.functions.dates import resolve_date, years_before
from tableloom.functions.formula import FormulaError, compile_condition, compile_formula, condition_field, formula_fields

TYPES = {"n": "bigint", "d": "double", "s": "string", "b": "boolean", "day": "date"}


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql(
        "SELECT 4L AS n, 2.5D AS d, 'Ab cD' AS s, true AS b, DATE '2024-01-02' AS day, CAST(NULL AS STRING) AS z, CAST(NULL AS BIGINT) AS m"
    )


@pytest.mark.parametrize(
    "formula, text",
    [
        ("plain", "plain"),
        ("{% for i in range(3) %}{{ i }},{% endfor %}", "0,1,2,"),
        ("{% for i in range(1, n + 1) %}{{ loop.index }}/{{ loop.length }}{{ '' if loop.last else ' ' }}{% endfor %}", "1/4 2/4 3/4 4/4"),
        ("{% for i in range(5, 0, -2) %}{{ i }}{% endfor %}|{% for i in range(0) %}x{% else %}none{% endfor %}", "531|none"),
        ("{% for w in s.split() %}{{ loop.index0 }}{{ w|upper }}{% if not loop.last %}-{% endif %}{% endfor %}", "0AB-1CD"),
        ("{% for w in 'a,b,,c'.split(',') if w %}[{{ w }}{{ loop.revindex }}]{% endfor %}", "[a3][b2][c1]"),
        ("{% for c in s %}{{ c if c != ' ' else '_' }}{% endfor %}", "Ab_cD"),
        ("{% for i in range(2) %}{% for c in 'xy' %}{{ i }}{{ c }}{{ n }}{{ loop.first }} {% endfor %}{% endfor %}", "0x4True 0y4False 1x4True 1y4False "),
        ("{% for i in range(3) %}{{ loop.cycle('odd', 'even') }} {% endfor %}", "odd even odd "),
        ("{% for x in [1, 2, 3] -%} {{ x * n }} {%- endfor %}{{ [3, 1]|sum }}", "48124"),
        ("{% for i in range(2) %}{{ 4 / (n - 4) }}{% endfor %}", "{% for i in range(2) %}{{ 4 / (n - 4) }}{% endfor %}"),
        ("{% for i in range(3) %}{{ 6 // (i + 1) if i else 'z' }}{% endfor %}", "z32"),
        ("{% for i in range(m) %}x{% endfor %}", "{% for i in range(m) %}x{% endfor %}"),
        ("{% for x in nothing %}a{% else %}b{% endfor %}", "b"),
        ("{% set x = n * 2 %}{{ x }}{% set x = x + 1 %}-{{ x }}", "8-9"),
        ("{% set x = 1 %}{% for i in range(3) %}{% set x = 7 %}{{ x }}{% endfor %}{{ x }}", "7771"),
        ("{% if n > 3 %}{% set k = 'big' %}{% else %}{% set k = 'small' %}{% endif %}{{ k }}", "big"),
        ("{% set t %}<{{ s }}>{% endset %}{{ t|length }}{{ t }}", "7<Ab cD>"),
        ("{% set ns = namespace(total=0, text='') %}{% for i in range(4) %}{% set ns.total = ns.total + i * n %}{% set ns.text = ns.text ~ i %}"
         "{% if i == 2 %}{% set ns.total = ns.total + 100 %}{% endif %}{{ ns.total }};{% endfor %}{{ ns.total }} {{ ns.text }}", "0;4;112;124;124 0123"),
        ("{% set ns = namespace(n=0) %}{% for i in range(3) %}{% for j in range(i) %}{% set ns.n = ns.n + 1 %}{% endfor %}{% endfor %}{{ ns.n }}", "3"),
        ("{% macro tag(x, y='!') %}<{{ x }}{{ y }}>{% endmacro %}{{ tag(n) }}{{ tag(s, y=n) }}{{ tag(tag(1))|upper }}", "<4!><Ab cD4><<1!>!>"),
        ("{% macro star(k) %}{% for i in range(k) %}*{% endfor %}{% endmacro %}{% for i in range(3) %}{{ star(i) }}.{% endfor %}", ".*.**."),
        ("{{ 'b a B c'.split()|sort|join(', ') }} {{ ['b', 'a', 'B']|unique|join }} {{ s|list|join('-') }}", "a, b, B, c ba A-b- -c-D"),
        ("{{ 'a' in ['a', 'b'] }} {{ n in [1, 2] }} {{ 'x,y,z'.split(',')[1] }}{{ ['p']|first }}{{ [1, 5]|last }}{{ '-'.join(['u', 'v']) }}", "True False yp5u-v"),
        ("{{ range(4)|join(s) }} {{ range(7)|length }} {{ range(3)|reverse|join }}", "0Ab cD1Ab cD2Ab cD3 7 210"),
        ("", ""),
        ("{{ s }}", "Ab cD"),
        ("{{ s|lower|replace(' ', '') }}!", "abcd!"),
        ("{{ s|upper }}{{ s|title }}{{ s|capitalize }}", "AB CDAb CdAb cd"),
        ("{{ 'fault-tolerant (x)'|title }}", "Fault-Tolerant (X)"),
        ("{{ s|length + 1 }}", "6"),
        ("{{ n * 2 - 3 }}", "5"),
        ("{{ n / 8 }} {{ n * 1.0 }} {{ n / 0.0000001 }}", "0.5 4.0 40000000.0"),
        ("{{ n // 3 }} {{ -n // 3 }} {{ n % 3 }} {{ -n % 3 }} {{ n ** 2 }}", "1 -2 1 2 16"),
        ("{{ (n + 1) * 2 }}", "10"),
        ("{{ -n|abs }}", "4"),
        ("{{ d|round(0) }} {{ n|round }} {{ d|round(0, 'ceil') }}", "2.0 4 3.0"),
        ("{{ '7'|int + 1 }} {{ '7.9'|int }} {{ 'x'|int(3) }}", "8 7 3"),
        ("{{ s|int }}", "0"),
        ("{{ '1.5'|float + d }}", "4.0"),
        ("{{ s ~ '-' ~ n }}", "Ab cD-4"),
        ("{{ 1 + 2 ~ 3 }}", "{{ 1 + 2 ~ 3 }}"),
        ("{{ b }} {{ day }}", "True 2024-01-02"),
        ("{{ nothing }}|{{ z }}|{{ z|lower }}", "|None|none"),
        ("{{ z|default('x') }} {{ z|default('x', true) }} {{ nothing|default('y') }} {{ n|d(1) }}", "None x y 4"),
        ("{{ s|trim|string }}", "Ab cD"),
        ("{{ s[0] }}{{ s[-1] }}{{ s[9] }}{{ s[:2] }}{{ s[3:] }}{{ s[-2:] }}{{ s[1:-1] }}{{ z[0] }}", "ADAbcDcDb c"),
        ("{{ s.lower() }}{{ s.replace('b', 'x').upper() }}", "ab cdAX CD"),
        ("{{ s|first }}{{ s|last }}{{ 'abc'|reverse }} {{ s|wordcount }}", "ADcba 2"),
        ("{{ '%05d'|format(n) }} {{ '%.2f/%s'|format(d, s) }}", "00004 2.50/Ab cD"),
        ("{{ 'big' if n > 3 else 'small' }} {{ 'x' if n > 9 }}.", "big ."),
        ("{{ 'a' if n > 3 and s == 'Ab cD' else 'b' }}{{ 'a' if not b or n == 5 else 'b' }}", "ab"),
        ("{{ z or 'none' }} {{ n or 1 }} {{ b and 'yes' }}", "none 4 yes"),
        ("{{ 'Ab' in s }} {{ z is none }} {{ n is not none }} {{ q is defined }} {{ z == none }}", "True True True False True"),
        ("{{ n == 4.0 }} {{ s == 4 }} {{ s != 4 }} {{ b == 1 }}", "True False True True"),
        ("{% if n > 5 %}a{% elif n > 3 %}b{{ n }}{% else %}c{% endif %}.", "b4."),
        ("{% if z %}a{% endif %}x{# note #}y", "xy"),
        ("a  {{- n -}}  b {%- if b %} c{% endif %}", "a4b c"),
        ("{{ z + 'x' }}", "{{ z + 'x' }}"),
        ("{{ m * 2 }}", "{{ m * 2 }}"),
        ("{{ m * 2 if m is not none else 'no' }}", "no"),
        ("{% if m is none %}-{% else %}{{ m + 1 }}{% endif %}", "-"),
        ("{{ n / 0 }}", "{{ n / 0 }}"),
        ("{{ m > 3 }}", "{{ m > 3 }}"),
    ],
)
def test_formulas(row, formula, text):
    types = {**TYPES, "z": "string", "m": "bigint"}
    if "2 ~ 3" in formula:  # the joined text binds closer than the sum, which then mixes kinds
        with pytest.raises(FormulaError):
            compile_formula(formula, types)
        return
    assert row.select(compile_formula(formula, types).alias("f")).first().f == text


@pytest.mark.parametrize("formula", ["{{ s + 1 }}", "{{ s|nope }}", "{{ n ) }}", "{{ }}", "{{ s| }}", "{{ n § }}", "{{ s|replace(n) }}", "{% for x in n %}{% endfor %}", "{% for x in s %}", "{% include 's' %}", "{% macro a(x) %}{{ a(x) }}{% endmacro %}{{ a(1) }}", "{% set ns = namespace(a=1) %}{% for i in s %}{% set ns.a = s %}{% endfor %}", "{% set q.a = 1 %}", "{{ [1, 'a'] }}", "{{ lipsum(3) }}", "{% if n %}", "{{ s.split() }}", "{{ n[0] }}", "{{ n > s }}"])
def test_bad_formulas(formula):
    with pytest.raises(FormulaError):
        compile_formula(formula, TYPES)


def test_formula_fields():
    assert formula_fields("{{ a|lower }}{{ b + c|round(1) }} d") >= {"a", "b", "c"}


@pytest.mark.parametrize(
    "condition, holds",
    [
        ("n >= 4", True), ("n<=3", False), ("n == 4", True), ("n != 4", False), ("n > 3.5", True), ("n < -1", False),
        ("s == 'Ab cD'", True), ('s != "x"', True), ("s > 5", False), ("s == 5", False), ("s != 5", True), ("n == four", False),
        ("day >= '2024-01-02'", True), ("day < 2024-01-02", False), ("b == 1", True),
        ("z == 'x'", False), ("z != 'x'", False), ("z != 5", False),
    ],
)
def test_conditions(row, condition, holds):
    made = compile_condition(condition, {**TYPES, "z": "string"})
    assert row.select(made.alias("c")).first().c is holds


@pytest.mark.parametrize("condition", [None, "", "n", "n ~ 4", "unknown > 3"])
def test_conditions_that_test_nothing(condition):
    assert compile_condition(condition, TYPES) is None


def test_condition_field():
    assert condition_field(" a >= 3") == "a" and condition_field("odd") is None


@pytest.mark.parametrize(
    "text, day",
    [
        ("today", "2024-06-15"), ("now", "2024-06-15"), ("-30d", "2024-05-16"), ("+1w", "2024-06-22"), ("-1y", "2023-06-15"),
        ("-2M", "2024-04-15"), ("-6m", "2024-06-14"), ("-1d12h", "2024-06-14"), ("2020-02-03", "2020-02-03"),
        ("2020-02-03T10:00:00", "2020-02-03"),
    ],
)
def test_dates(text, day):
    assert resolve_date(text, date(2024, 6, 15)).isoformat() == day


def test_bad_date_and_leap_day():
    with pytest.raises(ValueError):
        resolve_date("soon", date(2024, 1, 1))
    assert years_before(date(2024, 2, 29), 1) == date(2023, 2, 28)


def test_floats_print_like_templates(spark):
    from pyspark.sql import functions as F

    from tableloom.functions.floats import float_text

    numbers = [0.0, 0.1, -1.5, 1e7, 123456789.25, 1e15, 1e16, 1.5e20, 1e-4, 1e-5, 2.5e-7, 1e-10, -1e22, 1 / 3, 1e100]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r.t for r in df.select(float_text(F.col("x")).alias("t")).collect()] == [repr(x) for x in numbers]
