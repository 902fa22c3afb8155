"""Formulas and conditions, compiled once on the driver to plain columns.

A formula is template text: ``{{ field | filter }}`` places and ``{% if %}``, ``{% for %}``, ``{% set %}`` and
``{% macro %}`` blocks over the fields before it. A loop becomes a higher-order function over an array, a namespace
its accumulator, an assignment a column bound to a name. Where a row would make the template fail (arithmetic on NULL,
division by zero), the row gets the formula's own text.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableloom.functions.dates import iso_text
from tableloom.functions.floats import float_text
from tableloom.functions.rounding import round_half_even

_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+\.\d+|\d+)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>\*\*|//|==|!=|<=|>=|[-+*/%~|(),<>.:=\[\]]))"
)
_WORDS = ("if", "else", "and", "or", "not", "is", "in")
_CONDITION = re.compile(r"^\s*(\w+)\s*(>=|<=|!=|==|>|<)\s*(.+)\s*$")
_COMPARE = {
    ">=": operator.ge,
    "<=": operator.le,
    ">": operator.gt,
    "<": operator.lt,
    "==": operator.eq,
    "!=": operator.ne,
}
_NUMBERS = ("bigint", "double")
_SQL_KINDS = {"undefined": "string", "null": "string"}


class FormulaError(ValueError):
    """The formula cannot be compiled against the fields before it."""


@dataclass(frozen=True)
class _Value:
    """A column with its kind; an unknown name is ``undefined``, and a literal keeps its Python value."""

    column: Column
    kind: str
    literal: object = None


_UNDEFINED = "undefined"
_LIST = "list:"  # and the kind of its elements
_LOOP, _SPACE = "loop", "namespace"  # their literal is a dictionary of values
_OPENING = {"for": "endfor", "if": "endif", "macro": "endmacro"}
_ASSIGNED = re.compile(r"\{%-?\s*set\s+(\w+)\s*\.")
MOST_ITEMS = 100_000  # of a range: a row that asks for more fails


@dataclass(frozen=True)
class _Macro:
    parameters: tuple[tuple[str, "_Value | None"], ...]
    body: list[str]
    scope: dict[str, "_Value"]


# --- formulas ------------------------------------------------------------------------------


def formula_fields(formula: str) -> set[str]:
    """Names that stand in the places and blocks of a formula."""
    inside = [part[2:-2] for part in _PART.findall(formula) if part[1] != "#"]
    return {text for part in inside for kind, text in _tokens(part.strip("-")) if kind == "name"}


def compile_formula(formula: str, types: Mapping[str, str], null_text: str = "None") -> Column:
    """Text column for ``formula``; ``types`` maps each earlier field to its kind."""
    parts = _split(formula.removesuffix("\n"))
    reader = _Reader(types, null_text)
    made, rest = _block(parts, reader)
    if rest:
        raise FormulaError(f"unexpected {rest[0]!r}")
    text = made[0] if len(made) == 1 else F.concat(*made) if made else F.lit("")
    return F.when(_any(reader.failures), F.lit(formula)).otherwise(text) if reader.failures else text


def _split(formula: str) -> list[str]:
    """Text and template parts in order; comments go, and a ``-`` mark eats the white space next to it."""
    parts = [p for p in _PART.split(formula) if p]
    for i, part in enumerate(parts):
        if _PART.fullmatch(part):
            if part[2] == "-" and i and not _PART.fullmatch(parts[i - 1]):
                parts[i - 1] = parts[i - 1].rstrip()
            if part[-3] == "-" and i + 1 < len(parts):
                parts[i + 1] = parts[i + 1].lstrip()
    return [p for p in parts if p and not p.startswith("{#")]


def _block(parts: list[str], reader: "_Reader", ends: Sequence[str] = ()) -> tuple[list[Column], list[str]]:
    """Columns up to a statement in ``ends``, and the parts from there on."""
    made: list[Column] = []
    while parts:
        part = parts[0]
        if part.startswith("{{"):
            made.append(reader.text(reader.value_of(_inside(part))))
        elif part.startswith("{%"):
            word = (_inside(part).split() or [""])[0]
            if word in ends:
                return made, parts
            if word not in _STATEMENTS:
                raise FormulaError(f"unsupported statement {part!r}")
            column, parts = _STATEMENTS[word](parts, reader)
            made += [] if column is None else [column]
            continue
        else:
            made.append(F.lit(part))
        parts = parts[1:]
    if ends:
        raise FormulaError("an if block is not closed")
    return made, []


def _if(parts: list[str], reader: "_Reader") -> tuple[Column, list[str]]:
    test = reader.truth(reader.value_of(_inside(parts[0]).split(None, 1)[-1]))
    outer, reader.failures = reader.failures, []
    scope = reader.scope
    reader.scope = dict(scope)
    then, parts = _block(parts[1:], reader, ("elif", "else", "endif"))
    then_failures, reader.failures = reader.failures, []
    then_scope, reader.scope = reader.scope, dict(scope)
    word = _inside(parts[0]).split()[0]
    if word == "elif":
        other, parts = _if(parts, reader)
        otherwise = [other]
    else:
        otherwise, parts = _block(parts[1:], reader, ("endif",)) if word == "else" else ([], parts)
        parts = parts[1:]
    reader.failures = outer + reader.guarded(test, then_failures) + reader.guarded(~test, reader.failures)
    reader.scope = reader.merged(test, then_scope, reader.scope)
    return F.when(test, F.concat(F.lit(""), *then)).otherwise(F.concat(F.lit(""), *otherwise)), parts


def _enclosed(parts: list[str], ends: Sequence[str]) -> tuple[list[str], list[str]]:
    """The parts up to the statement of this block that is in ``ends``, and those from there on."""
    depth = 0
    for at, part in enumerate(parts):
        inside = _inside(part) if part.startswith("{%") else ""
        word = (inside.split() or [""])[0]
        if word in ends and not depth:
            return parts[:at], parts[at:]
        if word in _OPENING or (word == "set" and "=" not in inside):
            depth += 1
        elif word in (*_OPENING.values(), "endset"):
            depth -= 1
    raise FormulaError(f"{' or '.join(ends)} is missing")


def _for(parts: list[str], reader: "_Reader") -> tuple[Column, list[str]]:
    """A loop: its body once per item, joined; with a namespace that it assigns to, item after item."""
    target, items, kind = reader.loop_head(_inside(parts[0]))
    body, parts = _enclosed(parts[1:], ("else", "endfor"))
    otherwise = []
    if _inside(parts[0]) == "else":
        otherwise, parts = _enclosed(parts[1:], ("endfor",))
    spaces = [n for n in dict.fromkeys(_ASSIGNED.findall("".join(body))) if n in reader.scope and reader.scope[n].kind == _SPACE]
    size = F.size(items).cast("bigint")
    made = reader.accumulated(target, items, kind, size, body, spaces) if spaces else reader.repeated(target, items, kind, size, body)
    if otherwise:
        outer, reader.failures = reader.failures, []
        empty, _ = _block(otherwise, reader)
        reader.failures = outer + reader.guarded(size == 0, reader.failures)
        made = F.when(size == 0, F.concat(F.lit(""), *empty)).otherwise(made)
    return made, parts[1:]


def _set(parts: list[str], reader: "_Reader") -> tuple[None, list[str]]:
    """``set name = value``, ``set space.name = value``, ``set name = namespace(...)``, or a block up to ``endset``."""
    inside = _inside(parts[0])
    if "=" not in inside:
        name = inside.split(None, 1)[-1].strip()
        body, rest = _enclosed(parts[1:], ("endset",))
        made, _ = _block(body, reader)
        reader.scope[name] = _Value(F.concat(F.lit(""), *made), "string")
        return None, rest[1:]
    reader.assign(inside)
    return None, parts[1:]


def _macro(parts: list[str], reader: "_Reader") -> tuple[None, list[str]]:
    body, rest = _enclosed(parts[1:], ("endmacro",))
    name, parameters = reader.macro_head(_inside(parts[0]))
    reader.macros[name] = _Macro(parameters, body, dict(reader.scope))
    return None, rest[1:]


_STATEMENTS = {"if": _if, "for": _for, "set": _set, "macro": _macro}


def _inside(part: str) -> str:
    return part[2:-2].strip("-").strip()


def _failed(failures: list[Column]) -> Column:
    return F.coalesce(_any(failures), F.lit(False)) if failures else F.lit(False)


def _any(tests: Sequence[Column]) -> Column:
    return reduce(operator.or_, tests)


def _tokens(place: str) -> list[tuple[str, str]]:
    found, at, text = [], 0, place.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:]!r} in {place!r}")
        kind = "word" if m.lastgroup == "name" and m["name"] in _WORDS else m.lastgroup
        found.append((kind, m[m.lastgroup]))
        at = m.end()
    return found


class _Reader:
    """Turns expressions into columns and remembers which rows would make the template fail."""

    def __init__(self, types: Mapping[str, str], null_text: str):
        self.types, self.null_text = types, null_text
        self.failures: list[Column] = []
        self.tokens: list[tuple[str, str]] = []
        self.at = 0
        self.scope: dict[str, _Value] = {}  # names bound by loops, assignments and parameters
        self.macros: dict[str, _Macro] = {}
        self.calls: list[str] = []

    # --- blocks -------------------------------------------------------------------------------

    def merged(self, test: Column, then: dict[str, _Value], other: dict[str, _Value]) -> dict[str, _Value]:
        """What the names stand for behind an ``if`` whose branches bound them differently."""
        out = {}
        for name in {**other, **then}:
            a, b = (scope.get(name) or self._named(name, {}) for scope in (then, other))
            if a is b:
                out[name] = a
            elif a.kind == b.kind == _SPACE:
                out[name] = _Value(F.lit(None), _SPACE, self.merged(test, a.literal, b.literal))
            else:
                out[name] = self._either(test, a, b)
        return out

    def loop_head(self, inside: str) -> tuple[str, Column, str]:
        """``for name in items [if test]``: the name, the items as an array, and their kind."""
        self.tokens, self.at = _tokens(inside), 1
        target = self._next("name")
        if not target:
            raise FormulaError(f"a loop needs a name: {inside!r}")
        self._need("word", "in")
        items, kind = self._items(self._or())
        if self._next("word", "if"):
            rest = self.at

            def tested(item: Column) -> Column:
                self.at = rest
                with self._inner({target: _Value(item, kind)}) as failures:
                    test = self.truth(self._or())
                    return F.struct(test.alias("holds"), _failed(failures()).alias("failed"))

            tests = F.transform(items, tested)
            self._fails(F.exists(tests, lambda t: t["failed"]))
            items = F.filter(items, lambda item, at: F.get(tests, at)["holds"])
        if self.at != len(self.tokens):
            raise FormulaError(f"unexpected {self.tokens[self.at][1]!r} in {inside!r}")
        return target, items, kind

    def _items(self, value: _Value) -> tuple[Column, str]:
        if value.kind.startswith(_LIST):
            return F.coalesce(value.column, F.array().cast(f"array<{value.kind.removeprefix(_LIST)}>")), value.kind.removeprefix(_LIST)
        if value.kind not in ("string", _UNDEFINED):
            raise FormulaError(f"{value.kind} has no items")
        self._fails(value.column.isNull())
        return F.filter(F.split(F.coalesce(value.column, F.lit("")), ""), lambda c: c != ""), "string"

    @contextmanager
    def _inner(self, names: dict[str, _Value]) -> Iterator[Callable[[], list[Column]]]:
        """Bind names and collect failures for a while; both are as before afterwards."""
        scope, outer = self.scope, self.failures
        self.scope, self.failures = {**scope, **names}, []
        try:
            yield lambda: self.failures
        finally:
            self.scope, self.failures = scope, outer

    @staticmethod
    def _loop(at: Column, size: Column) -> _Value:
        at = at.cast("bigint")
        numbers = {"index": at + 1, "index0": at, "revindex": size - at, "revindex0": size - at - 1, "length": size}
        known = {name: _Value(column, "bigint") for name, column in numbers.items()}
        return _Value(F.lit(None), _LOOP, known | {"first": _Value(at == 0, "boolean"), "last": _Value(at == size - 1, "boolean")})

    def repeated(self, target: str, items: Column, kind: str, size: Column, body: list[str]) -> Column:
        def once(item: Column, at: Column) -> Column:
            with self._inner({target: _Value(item, kind), "loop": self._loop(at, size)}) as failures:
                made, _ = _block(body, self)
                return F.struct(F.concat(F.lit(""), *made).alias("text"), _failed(failures()).alias("failed"))

        pieces = F.transform(items, once)
        self._fails(F.exists(pieces, lambda p: p["failed"]))
        return F.array_join(F.transform(pieces, lambda p: p["text"]), "")

    def accumulated(self, target: str, items: Column, kind: str, size: Column, body: list[str], spaces: list[str]) -> Column:
        """A loop that assigns to namespaces: they, the text and whether it failed go from item to item."""
        held = [(space, name, value) for space in spaces for name, value in self.scope[space].literal.items()]

        def known(state: Column) -> dict[str, _Value]:
            found: dict[str, dict[str, _Value]] = {space: {} for space in spaces}
            for i, (space, name, value) in enumerate(held):
                found[space][name] = _Value(state[f"v{i}"], value.kind)
            return {space: _Value(F.lit(None), _SPACE, names) for space, names in found.items()}

        def step(state: Column, item: Column) -> Column:
            with self._inner({target: _Value(item["item"], kind), "loop": self._loop(item["at"], size), **known(state)}) as failures:
                made, _ = _block(body, self)
                after = []
                for i, (space, name, value) in enumerate(held):
                    new = self.scope[space].literal[name]
                    if new.kind != value.kind:
                        raise FormulaError(f"{space}.{name} is {value.kind} before and {new.kind} behind an item")
                    after.append(new.column.alias(f"v{i}"))
                if any(len(self.scope[space].literal) != sum(h[0] == space for h in held) for space in spaces):
                    raise FormulaError("a loop cannot add names to a namespace")
                failed = state["failed"] | _failed(failures())
                return F.struct(F.concat(state["text"], *made).alias("text"), failed.alias("failed"), *after)

        start = [value.column.cast(_SQL_KINDS.get(value.kind, value.kind)).alias(f"v{i}") for i, (_, _, value) in enumerate(held)]
        zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("failed"), *start)
        numbered = F.transform(items, lambda item, at: F.struct(item.alias("item"), at.alias("at")))
        end = F.aggregate(numbered, zero, step)
        self._fails(end["failed"])
        self.scope = {**self.scope, **known(end)}
        return end["text"]

    def assign(self, inside: str) -> None:
        self.tokens, self.at = _tokens(inside), 1
        name = self._next("name")
        if not name:
            raise FormulaError(f"an assignment needs a name: {inside!r}")
        space = None
        if self._next("op", "."):
            space, name = name, self._next("name")
            if self.scope.get(space, _Value(F.lit(None), _UNDEFINED)).kind != _SPACE:
                raise FormulaError(f"{space!r} is no namespace")
        self._need("op", "=")
        if self.tokens[self.at : self.at + 2] == [("name", "namespace"), ("op", "(")]:
            self.at += 2
            value = _Value(F.lit(None), _SPACE, self._keywords())
        else:
            value = self._choice()
        if self.at != len(self.tokens) or not name:
            raise FormulaError(f"cannot read {inside!r}")
        if space:
            value, name = _Value(F.lit(None), _SPACE, {**self.scope[space].literal, name: value}), space
        self.scope[name] = value

    def _keywords(self) -> dict[str, _Value]:
        """``name=value, ...`` up to the closing bracket."""
        found = {}
        while not self._next("op", ")"):
            name = self._next("name")
            self._need("op", "=")
            found[name or ""] = self._choice()
            if not self._next("op", ","):
                self._need("op", ")")
                break
        return found

    def macro_head(self, inside: str) -> tuple[str, tuple[tuple[str, _Value | None], ...]]:
        self.tokens, self.at = _tokens(inside), 1
        name, parameters = self._next("name"), []
        self._need("op", "(")
        while not self._next("op", ")"):
            parameter = self._next("name")
            if not name or not parameter:
                raise FormulaError(f"cannot read {inside!r}")
            parameters.append((parameter, self._choice() if self._next("op", "=") else None))
            if not self._next("op", ","):
                self._need("op", ")")
                break
        return name or "", tuple(parameters)

    def _called(self, name: str) -> _Value:
        """The text of a macro's body with its parameters bound; the names around the call are not seen."""
        if name in self.calls:
            raise FormulaError(f"macro {name!r} calls itself")
        macro, args, named = self.macros[name], [], {}
        self._need("op", "(")
        while not self._next("op", ")"):
            if self.tokens[self.at + 1 : self.at + 2] == [("op", "=")]:
                key = self._next("name")
                self._need("op", "=")
                named[key] = self._choice()
            else:
                args.append(self._choice())
            if not self._next("op", ","):
                self._need("op", ")")
                break
        known = [p for p, _ in macro.parameters]
        if len(args) > len(known) or not set(named) <= set(known[len(args) :]):
            raise FormulaError(f"macro {name!r} does not take these values")
        bound = {p: default or _Value(F.lit(""), _UNDEFINED) for p, default in macro.parameters}
        bound |= dict(zip(known, args, strict=False)) | named
        tokens, at, scope = self.tokens, self.at, self.scope
        self.scope = {**macro.scope, **bound}
        self.calls.append(name)
        made, _ = _block(macro.body, self)
        self.calls.pop()
        self.tokens, self.at, self.scope = tokens, at, scope
        return _Value(F.concat(F.lit(""), *made), "string")

    def value_of(self, expression: str) -> _Value:
        self.tokens, self.at = _tokens(expression), 0
        value = self._choice()
        if self.at != len(self.tokens):
            raise FormulaError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    # --- values as text and truth -------------------------------------------------------------

    def text(self, value: _Value) -> Column:
        if value.kind.startswith(_LIST) or value.kind in (_LOOP, _SPACE):
            raise FormulaError(f"{value.kind} has no text here")
        column = value.column
        if value.kind == "boolean":
            column = F.initcap(column.cast("string"))
        elif value.kind == "double":
            column = float_text(column)
        elif value.kind == "timestamp_ntz":
            column = iso_text(column)
        return F.coalesce(column.cast("string"), F.lit(self.null_text))

    def truth(self, value: _Value) -> Column:
        column = value.column
        if value.kind.startswith(_LIST):
            column = F.size(column) > 0
        elif value.kind in ("string", _UNDEFINED):
            column = column != ""
        elif value.kind in _NUMBERS:
            column = column != 0
        elif value.kind != "boolean":
            return value.column.isNotNull()
        return F.coalesce(column, F.lit(False))

    def guarded(self, test: Column, failures: list[Column]) -> list[Column]:
        return [test & _any(failures)] if failures else []

    def _fails(self, test: Column) -> None:
        self.failures.append(F.coalesce(test, F.lit(False)))

    # --- grammar, loosest binding first -------------------------------------------------------

    def _next(self, kind: str, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and (not texts or self.tokens[self.at][1] in texts):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, kind: str, text: str) -> None:
        if not self._next(kind, text):
            raise FormulaError(f"missing {text!r}")

    def _branch(self, parse: Callable[[], _Value]) -> tuple[_Value, list[Column]]:
        outer, self.failures = self.failures, []
        value = parse()
        inner, self.failures = self.failures, outer
        return value, inner

    def _choice(self) -> _Value:
        value, failures = self._branch(self._or)
        if not self._next("word", "if"):
            self.failures += failures
            return value
        test = self.truth(self._or())
        other, other_failures = _Value(F.lit(""), _UNDEFINED), []
        if self._next("word", "else"):
            other, other_failures = self._branch(self._choice)
        self.failures += self.guarded(test, failures) + self.guarded(~test, other_failures)
        return self._either(test, value, other)

    def _either(self, test: Column, a: _Value, b: _Value) -> _Value:
        if a.kind == b.kind:
            return _Value(F.when(test, a.column).otherwise(b.column), a.kind)
        return _Value(F.when(test, self.text(a)).otherwise(self.text(b)), "string")

    def _or(self) -> _Value:
        value = self._and()
        while self._next("word", "or"):
            test = self.truth(value)
            other, failures = self._branch(self._and)
            self.failures += self.guarded(~test, failures)
            value = self._either(test, value, other)
        return value

    def _and(self) -> _Value:
        value = self._not()
        while self._next("word", "and"):
            test = self.truth(value)
            other, failures = self._branch(self._not)
            self.failures += self.guarded(test, failures)
            value = self._either(test, other, value)
        return value

    def _not(self) -> _Value:
        if self._next("word", "not"):
            return _Value(~self.truth(self._not()), "boolean")
        value = self._sum()
        while True:
            if op := self._next("op", *_COMPARE):
                value = self._compared(op, value, self._sum())
            elif self._next("word", "in"):
                value = self._contained(value, self._sum())
            else:
                break
        if self._next("word", "is"):
            negated = self._next("word", "not")
            word = (self._next("name") or "").lower()
            known = {"none": value.column.isNull(), "defined": F.lit(value.kind != _UNDEFINED)}
            if word not in known:
                raise FormulaError(f"unknown test {word!r}")
            value = _Value(~known[word] if negated else known[word], "boolean")
        return value

    def _contained(self, value: _Value, place: _Value) -> _Value:
        if place.kind.startswith(_LIST):
            if value.kind != place.kind.removeprefix(_LIST):
                raise FormulaError(f"{value.kind} cannot be looked for in {place.kind}")
            return _Value(F.coalesce(F.array_contains(place.column, value.column), F.lit(False)), "boolean")
        return _Value(self._string(place).contains(self._string(value)), "boolean")

    def _compared(self, op: str, a: _Value, b: _Value) -> _Value:
        left, right = (self._number(v).column if v.kind == "boolean" else v.column for v in (a, b))
        kinds = ["number" if v.kind in (*_NUMBERS, "boolean") else "string" if v.kind == _UNDEFINED else v.kind for v in (a, b)]
        if op in ("==", "!="):
            if "null" not in kinds and kinds[0] != kinds[1]:
                return _Value(F.lit(op == "!="), "boolean")
            equal = left.eqNullSafe(right)
            return _Value(equal if op == "==" else ~equal, "boolean")
        if kinds[0] != kinds[1]:
            raise FormulaError(f"{op!r} cannot order {a.kind} and {b.kind}")
        self._fails(left.isNull() | right.isNull())
        return _Value(_COMPARE[op](left, right), "boolean")

    def _sum(self) -> _Value:
        value = self._joined()
        while op := self._next("op", "+", "-"):
            value = self._arithmetic(op, value, self._joined())
        return value

    def _joined(self) -> _Value:
        value = self._product()
        while self._next("op", "~"):
            value = _Value(F.concat(self.text(value), self.text(self._product())), "string")
        return value

    def _product(self) -> _Value:
        value = self._power()
        while op := self._next("op", "*", "//", "/", "%"):
            value = self._arithmetic(op, value, self._power())
        return value

    def _power(self) -> _Value:
        value = self._filtered()
        while self._next("op", "**"):
            value = self._arithmetic("**", value, self._filtered())
        return value

    def _arithmetic(self, op: str, a: _Value, b: _Value) -> _Value:
        self._fails(a.column.isNull() | b.column.isNull())
        if op == "+" and a.kind == b.kind == "string":
            return _Value(F.concat(a.column, b.column), "string")
        a, b = self._number(a), self._number(b)
        kind = "double" if op == "/" or "double" in (a.kind, b.kind) else "bigint"
        if op in ("/", "//", "%"):
            self._fails(b.column == 0)
            if op == "/":
                return _Value(F.try_divide(a.column.cast("double"), b.column), kind)
            # whole quotients go down and remainders follow the divisor, as in the template language
            rest = F.try_mod(F.try_mod(a.column, b.column) + b.column, b.column)
            made = rest if op == "%" else F.try_divide((a.column - rest).cast("double"), b.column).cast(kind)
            return _Value(made, kind)
        if op == "**":
            made = F.pow(a.column, b.column)
            made = made if kind == "double" else made.try_cast(kind)
        else:
            made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.column, b.column)
        if kind == "bigint":  # a result beyond 64 bits ends as the row's text, not the job
            self._fails(made.isNull())
        return _Value(made, kind)

    def _number(self, value: _Value) -> _Value:
        if value.kind == "boolean":
            return _Value(value.column.cast("bigint"), "bigint")
        if value.kind not in _NUMBERS:
            raise FormulaError(f"a number is needed, not {value.kind}")
        return value

    def _filtered(self) -> _Value:
        if self._next("op", "-"):
            inner = self._number(self._postfixed())
            self._fails(inner.column.isNull())
            value = _Value(-inner.column, inner.kind)
        else:
            value = self._postfixed()
        while self._next("op", "|"):
            name = self._next("name")
            if not name:
                raise FormulaError("a filter name must follow '|'")
            value = self._filter(name, value, self._arguments())
        return value

    def _arguments(self) -> list[_Value]:
        args: list[_Value] = []
        if self._next("op", "("):
            while not self._next("op", ")"):
                args.append(self._choice())
                if not self._next("op", ","):
                    self._need("op", ")")
                    break
        return args

    def _postfixed(self) -> _Value:
        value = self._primary()
        while True:
            if self._next("op", "["):
                value = self._indexed(value)
            elif self._next("op", "."):
                name = self._next("name")
                if value.kind in (_LOOP, _SPACE):
                    value = self._attribute(value, name or "")
                    continue
                if name in ("split", "join") and value.kind == "string":
                    value = self._split(value, self._arguments()) if name == "split" else self._joined_by(value, self._arguments())
                    continue
                if name not in _METHODS or self.tokens[self.at : self.at + 1] != [("op", "(")]:
                    raise FormulaError(f"unknown attribute {name!r}")
                self._fails(value.column.isNull())
                value = self._filter(_METHODS[name], value, self._arguments())
            else:
                return value

    def _attribute(self, value: _Value, name: str) -> _Value:
        if name in value.literal:
            return value.literal[name]
        if value.kind == _SPACE:
            return _Value(F.lit(""), _UNDEFINED)
        if name == "cycle" and (args := self._arguments()):
            turn = value.literal["index0"].column % len(args)
            return self._one_of(args, turn)
        raise FormulaError(f"unknown attribute {name!r} of a loop")

    def _one_of(self, values: list[_Value], turn: Column) -> _Value:
        found = values[-1]
        for i in range(len(values) - 2, -1, -1):
            found = self._either(turn == i, values[i], found)
        return found

    def _split(self, value: _Value, args: list[_Value]) -> _Value:
        self._fails(value.column.isNull())
        if not args:
            words = F.split(F.regexp_replace(value.column, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
            return _Value(F.filter(words, lambda w: w != ""), f"{_LIST}string")
        if len(args) != 1 or not isinstance(args[0].literal, str) or not args[0].literal:
            raise FormulaError("text is split by literal text")
        return _Value(F.split(value.column, re.sub(r"([^\w\s])", r"\\\1", args[0].literal), -1), f"{_LIST}string")

    def _joined_by(self, sep: _Value, args: list[_Value]) -> _Value:
        if len(args) != 1:
            raise FormulaError("one list can be joined")
        return self._list_filter("join", args[0], [sep])

    def _range(self, args: list[_Value]) -> _Value:
        if not 1 <= len(args) <= 3 or any(a.kind != "bigint" for a in args):
            raise FormulaError("a range takes one to three whole numbers")
        start, stop = (F.lit(0).cast("bigint"), args[0].column) if len(args) == 1 else (args[0].column, args[1].column)
        step = args[2].column if len(args) == 3 else F.lit(1).cast("bigint")
        span = F.when(step > 0, stop - start).otherwise(start - stop)
        count = F.when(span > 0, F.ceil(F.try_divide(span, F.abs(step)))).otherwise(F.lit(0)).cast("bigint")
        self._fails(start.isNull() | stop.isNull() | F.coalesce(step == 0, F.lit(True)) | (count > MOST_ITEMS))
        numbers = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.least(count, F.lit(MOST_ITEMS)) - 1, F.lit(0)))
        made = F.when(count > 0, F.transform(numbers, lambda i: start + i * step))
        return _Value(F.coalesce(made, F.array().cast("array<bigint>")), f"{_LIST}bigint")

    def _literal_list(self) -> _Value:
        values = []
        while not self._next("op", "]"):
            values.append(self._choice())
            if not self._next("op", ","):
                self._need("op", "]")
                break
        kinds = {v.kind for v in values} or {"string"}
        if len(kinds) > 1 or kinds & {_UNDEFINED, _LOOP, _SPACE, "null"}:
            raise FormulaError("the items of a list are of one kind")
        kind = kinds.pop()
        return _Value(F.array(*[v.column for v in values]).cast(f"array<{kind}>"), f"{_LIST}{kind}")

    def _item(self, value: _Value, at: int) -> _Value:
        found = F.try_element_at(value.column, F.lit(at + 1 if at >= 0 else at))
        kind = value.kind.removeprefix(_LIST)
        if kind == "string":
            return _Value(F.coalesce(found, F.lit("")), kind)
        self._fails(found.isNull())
        return _Value(found, kind)

    def _indexed(self, value: _Value) -> _Value:
        """``text[i]`` or ``text[a:b]`` by literal positions, or an item of a list; outside there is nothing."""
        first = self._position()
        if value.kind.startswith(_LIST):
            if first is None:
                raise FormulaError("an index is missing")
            self._need("op", "]")
            return self._item(value, first)
        text, length = self._string(value), F.length(value.column)
        if self._next("op", ":"):
            last = self._position()
            start = self._from_end(0 if first is None else first, length)
            end = length if last is None else self._from_end(last, length)
            made = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
        elif first is None:
            raise FormulaError("an index is missing")
        else:
            inside = length > F.lit(first) if first >= 0 else length >= F.lit(-first)
            made = F.when(inside, F.substring(text, first + 1 if first >= 0 else first, 1))
        self._need("op", "]")
        return _Value(F.coalesce(made, F.lit("")), "string")

    def _position(self) -> int | None:
        sign = -1 if self._next("op", "-") else 1
        digits = self._next("number")
        return sign * int(digits) if digits and digits.isdigit() else None

    @staticmethod
    def _from_end(at: int, length: Column) -> Column:
        return F.lit(at) if at >= 0 else F.greatest(length + F.lit(at), F.lit(0))

    def _string(self, value: _Value) -> Column:
        if value.kind not in ("string", _UNDEFINED):
            raise FormulaError(f"text is needed, not {value.kind}")
        return value.column

    def _primary(self) -> _Value:
        if self._next("op", "("):
            value = self._choice()
            self._need("op", ")")
            return value
        if text := self._next("number"):
            if "." in text:
                return _Value(F.lit(float(text)), "double", float(text))
            return _Value(F.lit(int(text)).cast("bigint"), "bigint", int(text))
        if (text := self._next("text")) is not None:
            return _Value(F.lit(text[1:-1]), "string", text[1:-1])
        if self._next("op", "["):
            return self._literal_list()
        name = self._next("name")
        if not name:
            raise FormulaError("a value is missing")
        if self.tokens[self.at : self.at + 1] == [("op", "(")]:
            if name in self.macros:
                return self._called(name)
            if name == "range":
                return self._range(self._arguments())
            raise FormulaError(f"unknown function {name!r}")
        return self._named(name, self.scope)

    def _named(self, name: str, scope: dict[str, _Value]) -> _Value:
        if name in scope:
            return scope[name]
        if name in self.types:
            return _Value(F.col(name).cast(self.types[name]), self.types[name])
        if name.lower() in ("true", "false"):
            return _Value(F.lit(name.lower() == "true"), "boolean", name.lower() == "true")
        if name.lower() == "none":
            return _Value(F.lit(None).cast("string"), "null")
        return _Value(F.lit(""), _UNDEFINED)

    # --- filters ------------------------------------------------------------------------------

    def _list_filter(self, name: str, value: _Value, args: list[_Value]) -> _Value:
        """Filters of lists; text is a list of its characters. Text is sorted and told apart without case."""
        items, kind = self._items(value)
        listed = _Value(items, f"{_LIST}{kind}")
        texts = F.transform(items, lambda x: self.text(_Value(x, kind)))
        if name == "join" and len(args) <= 1:
            sep = self.text(args[0]) if args else F.lit("")
            parts = F.transform(texts, lambda t, at: F.when(at == 0, t).otherwise(F.concat(sep, t)))
            return _Value(F.array_join(parts, ""), "string")
        if args:
            raise FormulaError(f"filter {name!r} of a list takes no values")
        if name == "list":
            return listed
        if name in ("length", "count"):
            return _Value(F.size(items).cast("bigint"), "bigint")
        if name in ("first", "last"):
            return self._item(listed, 0 if name == "first" else -1)
        if name == "reverse":
            return _Value(F.reverse(items), listed.kind)
        fold = (lambda x: F.lower(x)) if kind == "string" else (lambda x: x)
        if name == "sort":
            keyed = F.transform(items, lambda x, at: F.struct(fold(x).alias("key"), at.alias("at"), x.alias("x")))
            return _Value(F.transform(F.array_sort(keyed), lambda k: k["x"]), listed.kind)
        if name == "unique":
            keys = F.transform(items, fold)
            return _Value(F.filter(items, lambda x, at: F.array_position(keys, fold(x)) == at + 1), listed.kind)
        if name == "sum" and kind in _NUMBERS:
            total = F.aggregate(items, F.lit(0).cast(kind), lambda a, x: F.try_add(a, x))
            self._fails(total.isNull())
            return _Value(total, kind)
        raise FormulaError(f"unknown filter {name!r} for a list")

    def _filter(self, name: str, value: _Value, args: list[_Value]) -> _Value:
        if value.kind.startswith(_LIST) and name not in ("default", "d") or (value.kind == "string" and name in ("list", "join")):
            return self._list_filter(name, value, args)
        if value.kind.startswith(_LIST):
            return value
        text, literals = self.text(value), [a.literal for a in args]
        if name in _TEXT_FILTERS and not args:
            return _Value(_TEXT_FILTERS[name](text), "string")
        if name == "replace" and len(args) == 2:
            return _Value(F.replace(text, self.text(args[0]), self.text(args[1])), "string")
        if name in ("length", "count", "wordcount"):
            if name == "wordcount":
                return _Value(F.regexp_count(text, F.lit(r"(?U)\w+")).cast("bigint"), "bigint")
            self._fails(value.column.isNull())
            return _Value(F.length(self._string(value)).cast("bigint"), "bigint")
        if name in ("default", "d") and args:
            if literals[1:] == [True]:
                return self._either(self.truth(value), value, args[0])
            return args[0] if value.kind == _UNDEFINED else value
        if name == "int":
            whole = value.column.cast("bigint") if value.kind in (*_NUMBERS, "boolean") else F.coalesce(
                value.column.try_cast("bigint"), value.column.try_cast("double").try_cast("bigint")
            )
            return _Value(F.coalesce(whole, F.lit(literals[0] if literals else 0).cast("bigint")), "bigint")
        if name == "float":
            return _Value(F.coalesce(value.column.try_cast("double"), F.lit(float(literals[0] if literals else 0))), "double")
        if name == "format" and args:
            self._fails(_any([a.column.isNull() for a in args]))
            if not isinstance(value.literal, str):
                raise FormulaError("the format must be literal text")
            return _Value(F.format_string(value.literal, *[a.column for a in args]), "string")
        if name in ("abs", "round"):
            self._fails(value.column.isNull())
            number = self._number(value)
            if name == "abs":
                return _Value(F.abs(number.column), number.kind)
            return self._rounded(number, literals)
        raise FormulaError(f"unknown filter {name!r} for {value.kind}")

    @staticmethod
    def _rounded(number: _Value, literals: list) -> _Value:
        digits = literals[0] if literals and isinstance(literals[0], int) else 0
        method = literals[-1] if literals and isinstance(literals[-1], str) else "common"
        if method == "common":
            if number.kind == "bigint":
                return number
            return _Value(round_half_even(number.column, digits), "double")
        if method not in ("floor", "ceil"):
            raise FormulaError(f"unknown rounding {method!r}")
        scale = F.lit(float(10**digits))
        whole = (F.floor if method == "floor" else F.ceil)(number.column * scale)
        return _Value(whole.cast("double") / scale, "double")


def _capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def _titled(text: Column) -> Column:
    words = F.split(text, r"(?<=[-\s(\{\[<])")
    return F.array_join(F.transform(words, _capitalized), "")


_TEXT_FILTERS = {
    "lower": F.lower,
    "upper": F.upper,
    "title": _titled,
    "capitalize": _capitalized,
    "trim": lambda text: F.regexp_replace(text, r"(?U)^\s+|\s+$", ""),
    "string": lambda text: text,
    "reverse": F.reverse,
    "first": lambda text: F.substring(text, 1, 1),
    "last": lambda text: F.substring(text, -1, 1),
}
# Methods of text that do what a filter does.
_METHODS = {"lower": "lower", "upper": "upper", "title": "title", "capitalize": "capitalize", "strip": "trim", "replace": "replace"}


# --- conditions ----------------------------------------------------------------------------


def condition_field(condition: str | None) -> str | None:
    m = _CONDITION.match(condition or "")
    return m.group(1) if m else None


def compile_condition(condition: str | None, types: Mapping[str, str], null_safe: bool = True) -> Column | None:
    """Boolean for ``field op literal``; None when nothing is to be tested.

    A missing or unreadable condition and an unknown field hold always; a NULL operand and a
    literal of another kind than the field never hold. A filter drops NULL anyway: without
    ``null_safe`` the bare comparison is returned, which reaches the file scan.
    """
    m = _CONDITION.match(condition or "")
    if not m or m.group(1) not in types:
        return None
    name, op, raw = m.group(1), m.group(2), m.group(3).strip()
    literal, kind = _literal(raw), types[name]
    if kind in ("date", "timestamp_ntz"):  # generated dates compare as ISO text
        column, kind = F.col(name).cast("string") if kind == "date" else iso_text(F.col(name)), "string"
    else:
        column = F.col(name).cast(kind)
    numeric_field, numeric_literal = kind in ("bigint", "double", "boolean"), not isinstance(literal, str)
    if numeric_field != numeric_literal:
        # equality of different kinds is decided, an order between them is not
        return F.col(name).isNotNull() if op == "!=" else F.lit(False)
    if kind == "boolean":
        column = column.cast("int")
    compared = _COMPARE[op](column, F.lit(literal))
    return F.coalesce(compared, F.lit(False)) if null_safe else compared


def _literal(raw: str) -> int | float | str:
    if re.fullmatch(r"-?\d+", raw):
        return int(raw)
    if "." in raw:
        try:
            return float(raw)
        except ValueError:
            pass
    return raw.strip('"').strip("'")
