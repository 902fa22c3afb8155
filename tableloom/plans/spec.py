"""What a user asks for: fields, datasets, groups, requests and templates.

Specs are tens of small objects on the driver; they never hold data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields as dataclass_fields, replace

# Accepted identifier forms.
COLUMN_NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
TABLE_NAME = re.compile(r"^dataset_[a-f0-9-]+$")

# Spec type name -> Spark SQL type (anything else is string).
SPARK_TYPES = {
    "integer": "bigint",
    "int": "bigint",
    "float": "double",
    "decimal": "double",
    "number": "double",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
    "timestamp": "timestamp_ntz",
}


def check_column_name(name: str) -> str:
    if not COLUMN_NAME.fullmatch(name):
        raise ValueError(f"invalid column name: {name!r}")
    return name


def check_table_name(name: str) -> str:
    if not TABLE_NAME.fullmatch(name):
        raise ValueError(f"invalid table name: {name!r}")
    return name


def _known(cls, raw: Mapping) -> dict:
    names = {f.name for f in dataclass_fields(cls)}
    return {k: v for k, v in raw.items() if k in names and v is not None}


@dataclass(frozen=True)
class Constraint:
    min: float | None = None
    max: float | None = None
    min_age: int | None = None
    max_age: int | None = None
    values: str | None = None
    weights: str | None = None
    right_digits: int | None = None
    format: str | None = None
    start: str | None = None
    end: str | None = None

    def choices(self) -> list[str]:
        return [v.strip() for v in self.values.split(",")] if self.values else []

    def choice_weights(self) -> list[float]:
        return [float(w) for w in self.weights.split(",")] if self.weights else []


@dataclass(frozen=True)
class Field:
    name: str
    generator: str
    type: str = "string"
    unique: bool = False
    formula: str | None = None
    null_probability: float | None = None
    constraint: Constraint = field(default_factory=Constraint)
    condition: str | None = None

    def __post_init__(self):
        check_column_name(self.name)
        p = self.null_probability
        if p is not None and not 0 <= p <= 1:
            raise ValueError(f"null_probability of {self.name!r} must lie in 0..1")

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES.get(self.type.lower(), "string")

    @classmethod
    def from_dict(cls, raw: Mapping) -> "Field":
        known = _known(cls, raw)
        bounds = known.pop("constraint", None)
        if isinstance(bounds, Mapping):
            bounds = Constraint(**_known(Constraint, bounds))
        return cls(**known, **({"constraint": bounds} if bounds else {}))


@dataclass(frozen=True)
class SharedKey:
    source_dataset: str
    source_field: str

    def __post_init__(self):
        check_column_name(self.source_field)


@dataclass(frozen=True)
class GroupConfig:
    num_groups: int
    split_pct: int = 100
    parent_fields: tuple[Field, ...] = ()
    child_fields: tuple[Field, ...] = ()

    def __post_init__(self):
        if self.num_groups < 1:
            raise ValueError("num_groups must be at least 1")
        if not 1 <= self.split_pct <= 100:
            raise ValueError("split_pct must lie in 1..100")
        members = [*self.parent_fields, *self.child_fields]
        _check_unique_names(members)
        if any(f.name.lower() == "parent_id" for f in members):
            raise ValueError("parent_id is added to every grouped dataset and cannot be a field")


DEFAULT_ROWS = 100  # fixed value: of a dataset read from JSON without a row count


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    rows: int
    fields: tuple[Field, ...] = ()
    template: str | None = None
    shared_key: SharedKey | None = None
    group_config: GroupConfig | None = None

    def __post_init__(self):
        if self.rows < 1:
            raise ValueError("rows must be at least 1")
        _check_unique_names(self.fields)

    @classmethod
    def from_dict(cls, raw: Mapping) -> "DatasetSpec":
        known = {"rows": DEFAULT_ROWS} | _known(cls, raw)
        known["fields"] = tuple(Field.from_dict(f) for f in known.get("fields", ()))
        if "shared_key" in known:
            known["shared_key"] = SharedKey(**_known(SharedKey, known["shared_key"]))
        if "group_config" in known:
            group = _known(GroupConfig, known["group_config"])
            for part in ("parent_fields", "child_fields"):
                group[part] = tuple(Field.from_dict(f) for f in group.get(part, ()))
            known["group_config"] = GroupConfig(**group)
        return cls(**known)


@dataclass(frozen=True)
class Request:
    datasets: tuple[DatasetSpec, ...]
    homogeneity: int = 50
    seed: int | None = None
    overlap_ratio: float = 0.0
    exact_fields: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.datasets:
            raise ValueError("a request needs at least one dataset")
        if not 1 <= self.homogeneity <= 100:
            raise ValueError("homogeneity must lie in 1..100")
        if not 0 <= self.overlap_ratio <= 1:
            raise ValueError("overlap_ratio must lie in 0..1")
        if len({d.name for d in self.datasets}) != len(self.datasets):
            raise ValueError("dataset names in one request must differ")
        if self.overlap_ratio > 0:
            self._check_overlap()

    @classmethod
    def from_dict(cls, raw: Mapping) -> "Request":
        known = _known(cls, raw)
        known["datasets"] = tuple(DatasetSpec.from_dict(d) for d in known.get("datasets", ()))
        known["exact_fields"] = tuple(known.get("exact_fields", ()))
        return cls(**known)

    def _check_overlap(self):
        if not self.exact_fields:
            raise ValueError("exact_fields must be specified to overlap datasets")
        for dataset in self.datasets:
            if dataset.group_config:
                raise ValueError(f"grouped dataset {dataset.name!r} cannot overlap others")
            by_name = {f.name: f for f in dataset.fields}
            for name in self.exact_fields:
                if name not in by_name:
                    raise ValueError(f"dataset {dataset.name!r} has no field {name!r} to keep exact")
                if by_name[name].generator in ("formula", "shared_key"):
                    raise ValueError(f"{by_name[name].generator} field {name!r} has no values of its own to keep exact")


@dataclass(frozen=True)
class Template:
    name: str = "Untitled"
    category: str = "General"
    description: str = ""
    version: str = "1.0"
    fields: tuple[Field, ...] = ()
    relationships: tuple[tuple[str, str, str | None], ...] = ()

    def datasets(self, name: str, rows: int, copies: int = 1) -> tuple[DatasetSpec, ...]:
        """Dataset specs for this template; several copies are numbered ``name_1``, ``name_2``, ..."""
        one = DatasetSpec(name=name, rows=rows, fields=self.fields, template=self.name)
        if copies == 1:
            return (one,)
        return tuple(replace(one, name=f"{name}_{i}") for i in range(1, copies + 1))


def dataset_specs_from_json(text: str) -> tuple[DatasetSpec, ...]:
    """One dataset object, or a list of them, as JSON text."""
    raw = json.loads(text)
    return tuple(DatasetSpec.from_dict(d) for d in ([raw] if isinstance(raw, dict) else raw))


def fields_from_json(text: str) -> tuple[Field, ...]:
    return tuple(Field.from_dict(f) for f in json.loads(text))


def _check_unique_names(items: Sequence[Field]) -> None:
    names = [f.name.lower() for f in items]
    if len(set(names)) != len(names):
        raise ValueError(f"field names must differ: {names}")
