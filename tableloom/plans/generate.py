"""Plans that turn dataset specs into DataFrames of generated rows."""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableloom.functions import generators
from tableloom.functions.draw import Draws, draw_key
from tableloom.functions.formula import (
    FormulaError,
    compile_condition,
    compile_formula,
    condition_field,
    formula_fields,
)
from tableloom.operators.pool import bucket_of, pick_from_pool
from tableloom.plans.spec import DatasetSpec, Field, Request

# These never repeat between datasets of a run, whatever the homogeneity.
ALWAYS_OWN = ("uuid4", "uuid_int", "shared_key")
ROW_ID = "__row_id"
RANK = "__rank"
CHUNK_ROWS = 1 << 18
ROWS_PER_TASK = 1 << 22


@dataclass(frozen=True)
class Run:
    """What all datasets of one request share."""

    seed: int
    homogeneity: int = 50
    as_of: date = field(default_factory=date.today)
    null_text: str = "None"

    def stream(self, dataset: str, field_: Field, prefix: str = "") -> tuple:
        """The draw stream of a field: shared by name between datasets, or the dataset's own."""
        name = prefix + field_.name
        roll = draw_key(self.seed, "roll", dataset, name) % 100 + 1
        if field_.generator in ALWAYS_OWN or roll > self.homogeneity:
            return (self.seed, dataset, name)
        return (self.seed, name)


@dataclass(frozen=True)
class Generated:
    seed: int
    datasets: dict[str, DataFrame]
    overlap_pool_size: int = 0


def generate(
    spark: SparkSession,
    request: Request,
    as_of: date | None = None,
    sources: Mapping[str, DataFrame] | None = None,
    null_text: str = "None",
) -> Generated:
    """All datasets of a request; ``sources`` names the tables shared keys are drawn from."""
    seed = random.randrange(2**31) if request.seed is None else request.seed
    run = Run(seed, request.homogeneity, as_of or date.today(), null_text)
    known = dict(sources or {})
    pool_size = int(min(d.rows for d in request.datasets) * request.overlap_ratio)
    pooled = {f.name: f for f in request.datasets[0].fields if f.name in request.exact_fields}
    made: dict[str, DataFrame] = {}
    for spec in request.datasets:
        if spec.group_config:
            made[spec.name] = grouped_dataset(spark, spec, run, known)
        else:
            made[spec.name] = flat_dataset(spark, spec, run, known, pooled if pool_size else {}, pool_size)
        known.setdefault(spec.name, made[spec.name])
    return Generated(seed, made, pool_size)


def flat_dataset(
    spark: SparkSession,
    spec: DatasetSpec,
    run: Run,
    sources: Mapping[str, DataFrame] | None = None,
    pooled: Mapping[str, Field] | None = None,
    pool_size: int = 0,
    row_ids: DataFrame | None = None,
    keep_row_id: bool = False,
) -> DataFrame:
    """``spec.rows`` rows, or one per row of ``row_ids`` (one integer column, a different value per row)."""
    if row_ids is None:
        base = row_numbers(spark, spec.rows).withColumnRenamed("id", ROW_ID)
    else:
        base = row_ids.toDF(ROW_ID)
        if any(f.unique for f in spec.fields):
            base = _ranked(base)
    ids = [F.col(ROW_ID)]
    rank = F.col(RANK) if RANK in base.columns else None

    def draws_of(f: Field) -> Draws:
        return Draws(run.stream(spec.name, f), ids, rank)

    keyed, shared = _join_shared(base, spec.fields, draws_of, _pool_finder(spec, sources))
    made = _add_fields(
        keyed,
        spec.fields,
        draws_of,
        run,
        shared,
        pooled={
            name: generators.generate(f, Draws((run.seed, "pool", name), ids, rank), run.as_of)
            for name, f in (pooled or {}).items()
        },
        in_pool=F.col(ROW_ID) < F.lit(pool_size),
    )
    kept = [F.col(ROW_ID).alias("row_id")] if keep_row_id else []
    return made.select(*kept, *[f.name for f in spec.fields])


def _ranked(ids: DataFrame) -> DataFrame:
    """Row ids with their place among all, ``RANK``: buckets are numbered side by side, only their totals meet."""
    bucketed = ids.withColumn("_bucket", bucket_of(F.col(ROW_ID)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(ROW_ID)).cast("bigint") - 1
    numbered = bucketed.withColumn("_inside", inside).join(F.broadcast(offsets), "_bucket")  # a row per bucket
    return numbered.select(ROW_ID, (F.col("_before") + F.col("_inside")).alias(RANK))


def _with_starts(sizes: DataFrame) -> DataFrame:
    """``group_id, size`` with the number of rows in all groups before, summed up in blocks of groups first."""
    blocked = sizes.withColumn("_block", F.shiftright("group_id", 16))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_block").agg(F.sum("size").alias("_total"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)
    started = blocked.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, "_block")
    return started.select("group_id", "size", (F.col("_before") + F.col("_inside")).alias("_start"))


def row_numbers(spark: SparkSession, rows: int) -> DataFrame:
    """``id`` 0 .. rows - 1, in tasks short enough to be repeated when an executor is lost."""
    return spark.range(0, rows, 1, _tasks(spark, rows))


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK))


def group_sizes(spark: SparkSession, spec: DatasetSpec, run: Run) -> DataFrame:
    """``(group_id, size)``: one row each, the rest shared out by random weights.

    Sizes add up to the grouped rows exactly (one per group when there are fewer rows than groups).
    """
    group = spec.group_config
    spare = max(0, grouped_rows(spec) - group.num_groups)
    weight = Draws((run.seed, spec.name, "group_size"), [F.col("id")]).below(1 << 16) + F.lit(1)
    weighted = spark.range(group.num_groups).select(F.col("id").alias("group_id"), weight.alias("_weight"))
    total = weighted.agg(F.sum("_weight")).scalar()
    share = F.call_function("div", F.lit(spare).cast("bigint") * F.col("_weight"), total)
    shared = weighted.select("group_id", share.alias("_share"))
    left = F.lit(spare).cast("bigint") - shared.agg(F.sum("_share")).scalar()
    extra = F.when(F.col("group_id") < left, 1).otherwise(0)
    return shared.select("group_id", (F.lit(1).cast("bigint") + F.col("_share") + extra).alias("size"))


def grouped_rows(spec: DatasetSpec) -> int:
    return spec.rows * spec.group_config.split_pct // 100


def grouped_dataset(
    spark: SparkSession, spec: DatasetSpec, run: Run, sources: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Parent-child rows followed by flat rows; ``parent_id`` is NULL on the flat ones.

    Parent values are computed from the group id on every child row, so no join is needed. Groups
    are unfolded in chunks that are spread over the tasks first: a group that holds most of the rows
    is written by many tasks.
    """
    group = spec.group_config
    total, pool_of = grouped_rows(spec), _pool_finder(spec, sources)
    flat = spec.rows - total
    columns = [f.name for f in (*group.parent_fields, *group.child_fields)] + ["parent_id"]
    parts = []
    if total:
        starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(CHUNK_ROWS).cast("bigint"))
        sizes = group_sizes(spark, spec, run)
        distinct = any(f.unique for f in group.child_fields)
        sizes = _with_starts(sizes) if distinct else sizes.withColumn("_start", F.lit(0).cast("bigint"))
        chunks = sizes.select("group_id", "size", "_start", F.explode_outer(starts).alias("_from"))
        chunks = chunks.repartition(_tasks(spark, max(total, group.num_groups)), "group_id", "_from")
        last = F.least(F.col("_from") + F.lit(CHUNK_ROWS), F.col("size")) - 1
        rows = chunks.select("_start", F.col("group_id").alias("__group"), F.explode_outer(F.sequence("_from", last)).alias("__child"))
        rows = rows.withColumn(RANK, F.col("_start") + F.col("__child")).drop("_start")
        ranks = (F.col("__group"), F.col(RANK))
        parts.append(_family(rows, spec, run, [F.col("__group")], [F.col("__group"), F.col("__child")], "", pool_of, ranks))
    if flat:
        rows = row_numbers(spark, flat).select(F.col("id").alias("__group"), F.lit(0).cast("bigint").alias("__child"))
        # numbered on from the groups and their rows, so no value repeats across the parts
        ranks = (F.col("__group") + F.lit(group.num_groups), F.col("__group") + F.lit(total))
        parts.append(_family(rows, spec, run, [F.col("__group")], [F.col("__group")], "flat_", pool_of, ranks))
    parts = [part.select(*columns) for part in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _family(rows, spec, run, parent_ids, child_ids, part, pool_of, ranks) -> DataFrame:
    group = spec.group_config

    def draws(kind: str, ids: Sequence[Column], rank: Column) -> Callable[[Field], Draws]:
        return lambda f: Draws((*run.stream(spec.name, f, kind), part), ids, rank, run.stream(spec.name, f, kind))

    parent_draws, child_draws = draws("parent_", parent_ids, ranks[0]), draws("child_", child_ids, ranks[1])
    keyed, shared = _join_shared(rows, group.parent_fields, parent_draws, pool_of)
    keyed, more = _join_shared(keyed, group.child_fields, child_draws, pool_of)
    made = _add_fields(keyed, group.parent_fields, parent_draws, run, shared)
    made = _add_fields(made, group.child_fields, child_draws, run, more, group.parent_fields)
    if part:
        return made.withColumn("parent_id", F.lit(None).cast("string"))
    key = Field("parent_id", "uuid4")
    return made.withColumn(
        "parent_id", generators.generate(key, Draws((run.seed, spec.name, "parent_id"), parent_ids), run.as_of)
    )


def _pool_finder(spec: DatasetSpec, sources: Mapping[str, DataFrame] | None):
    def find() -> tuple[DataFrame, str] | None:
        if spec.shared_key is None:
            return None
        name = spec.shared_key.source_dataset
        if name not in (sources or {}):
            raise ValueError(f"shared key source '{name}' not found")
        return sources[name], spec.shared_key.source_field

    return find


def _join_shared(
    df: DataFrame,
    fields: Sequence[Field],
    draws_of: Callable[[Field], Draws],
    pool_of: Callable[[], tuple[DataFrame, str] | None],
) -> tuple[DataFrame, dict[str, Column]]:
    """Draw all shared keys first: a join then shuffles row numbers and keys, not generated columns."""
    shared = {}
    for f in fields:
        if f.generator == "shared_key":
            df, shared[f.name] = _shared_value(df, f, draws_of(f), pool_of())
    return df, shared


def _add_fields(
    df: DataFrame,
    fields: Sequence[Field],
    draws_of: Callable[[Field], Draws],
    run: Run,
    shared: Mapping[str, Column],
    known: Sequence[Field] = (),
    pooled: Mapping[str, Column] | None = None,
    in_pool: Column | None = None,
) -> DataFrame:
    """Add the fields in order, as few projections deep as their references allow.

    A cell is, in this order: the pooled value, NULL by chance, NULL by condition, then the
    shared key, formula or generated value.
    """
    types = {f.name: generators.value_kind(f) for f in known}
    later = {f.name for f in fields}
    pending: dict[str, Column] = {}
    for f in fields:
        tested = condition_field(f.condition)
        if tested in later and tested not in types:
            raise ValueError(f"condition of {f.name!r} reads {tested!r}, which comes later")
        reads = _reads(f) if f.generator == "formula" else set()
        if pending and (reads & pending.keys() or tested in pending):
            df, pending = df.withColumns(pending), {}
        draws = draws_of(f)
        if f.generator == "shared_key":
            value = shared[f.name]
        elif f.generator == "formula":
            value = _formula_value(f, types, run.null_text)
        else:
            value = generators.generate(f, draws, run.as_of)
        condition = compile_condition(f.condition, types)
        if condition is not None:
            value = F.when(condition, value)
        if f.null_probability:
            value = F.when(~draws.chance(f.null_probability, "null"), value)
        if pooled and f.name in pooled:
            value = F.when(in_pool, pooled[f.name]).otherwise(value)
        pending[f.name] = value
        types[f.name] = generators.value_kind(f)
    return df.withColumns(pending) if pending else df


def _shared_value(df: DataFrame, f: Field, draws: Draws, pool) -> tuple[DataFrame, Column]:
    if pool is None:
        return df, F.lit("").cast(f.spark_type)
    picked = f"__picked_{f.name}"
    return pick_from_pool(df, pool[0], pool[1], draws.u(), picked), F.col(picked).cast(f.spark_type)


def _reads(f: Field) -> set[str]:
    try:
        return formula_fields(f.formula or "")
    except FormulaError:  # kept as text below
        return set()


def _formula_value(f: Field, types: Mapping[str, str], null_text: str) -> Column:
    text = f.formula or ""
    try:
        return compile_formula(text, types, null_text).cast(f.spark_type)
    except FormulaError as problem:
        warnings.warn(f"formula of {f.name!r} kept as text: {problem}", stacklevel=2)
        return F.lit(text).cast(f.spark_type)
