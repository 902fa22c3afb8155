import re
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableloom.functions.draw import Draws, cut_point, draw_key, permuted
from tableloom.functions.generators import generate as value_of
from tableloom.functions.generators import generator_names
from tableloom.plans import generate as plans
from tableloom.plans.generate import Run, flat_dataset, generate, group_sizes, grouped_dataset
from tableloom.plans.spec import Constraint, DatasetSpec, Field, GroupConfig, Request, SharedKey
from tableloom.registry.sql import hash_of
from tests.conftest import plan

AS_OF = date(2024, 2, 29)


def fields(*specs):
    return tuple(Field.from_dict(dict(zip(("name", "generator", "type", "constraint"), s))) for s in specs)


SIMPLE = fields(("first_name", "first_name"), ("age", "random_int", "integer"), ("is_active", "boolean", "boolean"))


def one(spark, *fs, rows=200, seed=42, **kw):
    return generate(spark, Request((DatasetSpec("d", rows, tuple(fs), **kw),), 100, seed), AS_OF).datasets["d"]


@given(st.integers(0, 2**62), st.text(max_size=5))
@settings(max_examples=20, deadline=None)
def test_draw_is_the_public_hash(spark, row, name):
    key = draw_key(7, name, 0)
    found = spark.range(1).select(Draws((7, name), [F.lit(row)]).u().alias("u")).first().u
    assert found == hash_of(row, hash_of(key, 42)) >> 1


def test_row_count_and_column_order(spark):
    made = one(spark, *SIMPLE, rows=10)
    assert made.count() == 10 and made.columns == ["first_name", "age", "is_active"]
    assert [t for _, t in made.dtypes] == ["string", "bigint", "boolean"]


def test_same_seed_repeats_on_any_partitioning(spark):
    spec = DatasetSpec("d", 1, SIMPLE)
    ids = spark.range(500)
    a, b = (flat_dataset(spark, spec, Run(42, 100), row_ids=ids.repartition(n), keep_row_id=True) for n in (1, 7))
    assert sorted(a.collect()) == sorted(b.collect())
    assert sorted(one(spark, *SIMPLE).collect()) == sorted(one(spark, *SIMPLE).collect())


def test_other_seed_differs(spark):
    assert one(spark, *SIMPLE, seed=1).collect() != one(spark, *SIMPLE, seed=2).collect()


def test_null_probability_one_and_weights(spark):
    made = one(
        spark,
        Field("none", "name", null_probability=1.0),
        Field("color", "random_element", constraint=Constraint(values="red,blue", weights="90,10")),
        rows=2000,
    )
    counts = dict(made.groupBy("color").count().collect())
    assert made.where("none IS NOT NULL").count() == 0
    assert set(counts) == {"red", "blue"} and 1700 < counts["red"] < 1900


@pytest.mark.parametrize("name", generator_names())
def test_every_generator_fills_every_row(spark, name):
    made = spark.range(300).select(value_of(Field("x", name), Draws((1, "x"), [F.col("id")]), AS_OF).alias("x"))
    assert made.where("x IS NULL OR x = ''").count() == 0
    assert made.distinct().count() > 1


SHAPES = {
    "uuid4": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}",
    "phone_number": r"\+1-\d{3}-\d{3}-\d{4}",
    "zipcode": r"\d{5}",
    "swift": r"[A-Z]{6}[A-Z0-9]{2}",
    "bothify": r"[A-Za-z]{5}\d{5}",
    "ipv4": r"\d{1,3}(\.\d{1,3}){3}",
    "date_between": r"\d{4}-\d\d-\d\d",
    "date_time": r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d",
    "email": r"[a-z]+\d{4}@example\.(com|net|org)",
    "text": r"[A-Z].{0,98}\.",
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shapes(spark, name):
    for (value,) in one(spark, Field("x", name)).collect():
        assert re.fullmatch(SHAPES[name], value), value


def test_iban_check_digits(spark):
    for (iban,) in one(spark, Field("x", "iban")).collect():
        turned = iban[4:] + iban[:4]
        assert int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


@given(st.integers(-(10**6), 10**6), st.integers(0, 10**6), st.integers(0, 4))
@settings(max_examples=15, deadline=None)
def test_bounds_hold(spark, low, width, digits):
    made = one(
        spark,
        Field("i", "random_int", "integer", constraint=Constraint(min=low, max=low + width)),
        Field("d", "pydecimal", "float", constraint=Constraint(min=low / 8, max=low / 8 + width, right_digits=digits)),
        rows=50,
    )
    for i, d in made.collect():
        assert low <= i <= low + width
        assert low / 8 - 1e-9 <= d <= low / 8 + width + 1e-9
        if width:
            assert abs(d * 10**digits - round(d * 10**digits)) < 1e-4


@pytest.mark.parametrize("limit", [1, 2, 5, 20, 400])
def test_text_length(spark, limit):
    made = one(spark, Field("x", "text", constraint=Constraint(max=limit)))
    assert made.where(F.length("x") > limit).count() == 0


def test_text_zero_means_default(spark):
    assert one(spark, Field("x", "text", constraint=Constraint(max=0))).where(F.length("x") > 20).count() > 0


def test_birth_dates_give_the_asked_ages(spark):
    made = one(spark, Field("x", "date_of_birth", "date", constraint=Constraint(min_age=18, max_age=20)), rows=2000)
    ages = [AS_OF.year - d.year - ((AS_OF.month, AS_OF.day) < (d.month, d.day)) for (d,) in made.collect()]
    assert set(ages) == {18, 19, 20}


def test_typed_values(spark):
    made = one(
        spark,
        Field("status", "random_element", "integer", constraint=Constraint(values="200,404")),
        Field("when", "date_time", "timestamp"),
        Field("day", "date_time", "date"),
        Field("rounded", "pydecimal", "integer", constraint=Constraint(min=0, max=5)),
    )
    assert [t for _, t in made.dtypes] == ["bigint", "timestamp_ntz", "date", "bigint"]
    row = made.first()
    assert row.status in (200, 404) and isinstance(row.when, datetime)


def test_unique_integers_and_too_small_a_range(spark):
    tight = Field("u", "random_int", "integer", unique=True, constraint=Constraint(min=5, max=204))
    assert sorted(r.u for r in one(spark, tight, rows=200).collect()) == list(range(5, 205))
    with pytest.raises(Exception, match="unique values"):
        one(spark, tight, rows=201).collect()


@pytest.mark.parametrize(
    "generator, constraint, space",
    [
        ("bothify", {"format": "?#"}, 520), ("bothify", {"format": "??????????##########"}, None), ("zipcode", {}, 100_000),
        ("date_between", {"start": "2024-01-01", "end": "2024-12-31"}, 366), ("date_of_birth", {"min_age": 20, "max_age": 60}, None),
        ("random_element", {"values": ",".join(f"v{i}" for i in range(300)), "weights": ",".join(["1"] * 300)}, 300), ("iban", {}, None),
        ("ipv4", {}, None), ("date_time", {}, None), ("pydecimal", {"min": 0, "max": 3, "right_digits": 2}, 301), ("email", {}, None),
        ("street_address", {}, None), ("swift", {}, None), ("bban", {}, None), ("phone_number", {}, None), ("random_int", {"min": -150, "max": 150}, 301),
    ],
)
def test_every_generator_can_be_unique(spark, generator, constraint, space):
    unique = Field("u", generator, unique=True, constraint=Constraint(**constraint))
    rows = min(space or 3000, 3000)
    found = [r.u for r in one(spark, unique, rows=rows).collect()]
    assert len(set(found)) == len(found) == rows
    if space and space <= 3000:  # all of them, and in no plain order
        assert found != sorted(found)
        with pytest.raises(Exception, match="unique values"):
            one(spark, unique, rows=space + 1).collect()


def test_sparse_row_ids_share_a_tight_range(spark):
    spec = DatasetSpec("d", 1, (Field("u", "random_int", "integer", unique=True, constraint=Constraint(min=1, max=500)),))
    ids = spark.range(500).select((F.col("id") * F.col("id") * 10**10 - 7).alias("id"))
    made = flat_dataset(spark, spec, Run(3), row_ids=ids, keep_row_id=True).collect()
    assert sorted(r.u for r in made) == list(range(1, 501)) and len({r.row_id for r in made}) == 500
    again = flat_dataset(spark, spec, Run(3), row_ids=ids.repartition(7), keep_row_id=True).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_grouped_rows_are_unique_in_both_parts(spark):
    code = {"constraint": Constraint(format="?##"), "unique": True}
    group = GroupConfig(60, 70, parent_fields=(Field("firm", "bothify", **code),), child_fields=(Field("tag", "bothify", **code),))
    made = generate(spark, Request((DatasetSpec("d", 5000, group_config=group),), seed=4), date(2024, 1, 1)).datasets["d"].collect()
    children, flat = [r for r in made if r.parent_id], [r for r in made if not r.parent_id]
    assert len({r.tag for r in made}) == 5000 == len(made)
    assert len({(r.firm, r.parent_id) for r in children}) == len({r.firm for r in children}) == 60
    assert len({r.firm for r in flat} | {r.firm for r in children}) == len(flat) + 60


def test_permutation_reaches_every_number(spark):
    for size in (1, 2, 3, 97, 1000):
        found = spark.range(size).select(permuted(F.col("id"), size, 5).alias("p")).collect()
        assert sorted(r.p for r in found) == list(range(size))


def test_unknown_generator_warns(spark):
    with pytest.warns(UserWarning, match="unknown generator"):
        one(spark, Field("x", "nope"))


def test_bad_bounds():
    with pytest.raises(ValueError):
        value_of(Field("x", "random_int", constraint=Constraint(min=5, max=1)), Draws((1,), [F.lit(1)]), AS_OF)


def test_later_condition_field_is_an_error(spark):
    with pytest.raises(ValueError, match="comes later"):
        one(spark, Field("a", "name", condition="b > 1"), Field("b", "random_int", "integer"))


def test_number_kept_as_text_still_compares(spark):
    made = one(
        spark,
        Field("n", "random_int", constraint=Constraint(min=0, max=9)),
        Field("big", "word", condition="n >= 5"),
        Field("next", "formula", formula="{{ n + 1 }}"),
    )
    for n, big, following in made.collect():
        assert (big is not None) == (int(n) >= 5) and following == str(int(n) + 1)


def test_bad_formula_stays_text(spark):
    with pytest.warns(UserWarning, match="kept as text"):
        made = one(spark, Field("n", "name"), Field("f", "formula", formula="{{ n + 1 }}!"))
    assert made.first().f == "{{ n + 1 }}!"
    with pytest.warns(UserWarning, match="kept as text"):
        assert one(spark, Field("n", "name"), Field("f", "formula", formula="{{ n § }}")).first().f == "{{ n § }}"


def test_rows_that_fail_keep_the_formula_text(spark):
    made = one(
        spark,
        Field("n", "random_int", "integer", null_probability=0.5, constraint=Constraint(min=0, max=3)),
        Field("f", "formula", formula="{{ 6 / n }}"),
        Field("g", "formula", formula="{{ 'none' if n is none else n + 1 }}"),
    )
    for n, f, g in made.collect():
        assert f == (str(6 / n) if n else "{{ 6 / n }}") and g == ("none" if n is None else str(n + 1))


# --- several datasets ----------------------------------------------------------------------

PAIR = fields(("cust_id", "uuid4"), ("age", "random_int", "integer"))


def overlap(ratio, exact, rows=(10, 10), **kw):
    return Request(tuple(DatasetSpec(f"ds{i}", n, PAIR) for i, n in enumerate(rows)), 1, 42, ratio, exact, **kw)


def test_overlap(spark):
    made = generate(spark, overlap(0.5, ("cust_id",)), AS_OF)
    a, b = ([r.cust_id for r in made.datasets[n].collect()] for n in ("ds0", "ds1"))
    assert made.overlap_pool_size == 5 and a[:5] == b[:5] and not set(a[5:]) & set(b[5:])


def test_no_overlap(spark):
    made = generate(spark, overlap(0.0, ()), AS_OF)
    assert made.datasets["ds0"].join(made.datasets["ds1"], "cust_id").count() == 0


def test_overlap_uses_the_first_specs(spark):
    first = DatasetSpec("a", 10, fields(("x", "random_int", "integer", {"min": 0, "max": 9})))
    second = DatasetSpec("b", 10, (Field("x", "random_int", "integer", null_probability=1.0),))
    made = generate(spark, Request((first, second), 50, 1, 0.5, ("x",)), AS_OF).datasets
    assert [r.x for r in made["b"].collect()][:5] == [r.x for r in made["a"].collect()][:5]
    assert [r.x for r in made["b"].collect()][5:] == [None] * 5


def test_overlap_errors():
    with pytest.raises(ValueError, match="exact_fields must be specified"):
        overlap(0.5, ())
    with pytest.raises(ValueError, match="no field 'nonexistent'"):
        overlap(0.5, ("nonexistent",))
    group = DatasetSpec("g", 10, group_config=GroupConfig(2, 50, PAIR[:1], PAIR[1:]))
    with pytest.raises(ValueError, match="grouped"):
        Request((group,), overlap_ratio=0.5, exact_fields=("age",))


def test_homogeneity_shares_columns(spark):
    for level, same in ((100, True), (1, False)):
        made = generate(spark, Request(tuple(DatasetSpec(n, 50, PAIR) for n in "ab"), level, 3), AS_OF).datasets
        a, b = ([r.age for r in made[n].collect()] for n in "ab")
        assert (a == b) == same
        assert made["a"].join(made["b"], "cust_id").count() == 0


def test_random_seed_is_reported(spark):
    made = generate(spark, Request((DatasetSpec("d", 5, SIMPLE),), 100))
    again = generate(spark, Request((DatasetSpec("d", 5, SIMPLE),), 100, made.seed))
    assert made.datasets["d"].collect() == again.datasets["d"].collect()


# --- groups --------------------------------------------------------------------------------


def family(rows, groups, split=100):
    child = fields(("pay", "random_int", "integer"))
    return DatasetSpec("g", rows, group_config=GroupConfig(groups, split, fields(("firm", "company")), child))


@given(st.integers(1, 400), st.integers(1, 60), st.integers(1, 100))
@settings(max_examples=12, deadline=None)
def test_group_sizes_add_up(spark, rows, groups, split):
    spec = family(rows, groups, split)
    total = rows * split // 100
    sizes = [r["size"] for r in group_sizes(spark, spec, Run(1)).collect()]
    assert len(sizes) == groups and min(sizes) >= 1 and sum(sizes) == max(total, groups)


def test_groups_repeat_their_parent(spark):
    made = grouped_dataset(spark, family(1000, 10, 80), Run(1))
    assert made.columns == ["firm", "pay", "parent_id"] and made.count() == 1000
    assert made.where("parent_id IS NULL").count() == 200
    per = made.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count_distinct("firm").alias("n"))
    assert per.count() == 10 and per.where("n <> 1").count() == 0


def test_one_group_is_written_by_many_tasks(spark, monkeypatch):
    whole = sorted(grouped_dataset(spark, family(1000, 1), Run(1)).collect())
    monkeypatch.setattr(plans, "CHUNK_ROWS", 50)
    split = grouped_dataset(spark, family(1000, 1), Run(1))
    assert sorted(split.collect()) == whole
    assert split.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_children_see_parent_fields(spark):
    group = GroupConfig(
        3, 50, fields(("size", "random_int", "integer", {"min": 0, "max": 1})),
        (Field("only", "word", condition="size == 1"), Field("label", "formula", formula="{{ size }}-{{ only }}")),
    )
    for row in grouped_dataset(spark, DatasetSpec("g", 100, group_config=group), Run(5)).collect():
        assert (row.only is not None) == (row.size == 1) and row.label == f"{row.size}-{row.only}"


# --- shared keys ---------------------------------------------------------------------------


def test_shared_key_draws_from_the_pool(spark):
    pool = spark.createDataFrame([(v,) for v in ("a", "b", "b", None)], "k string")
    spec = DatasetSpec("s", 2000, (Field("k", "shared_key"),), shared_key=SharedKey("pool", "k"))
    made = generate(spark, Request((spec,), 50, 1), AS_OF, {"pool": pool}).datasets["s"]
    counts = dict(made.groupBy("k").count().collect())
    assert set(counts) == {"a", "b", None} and sum(counts.values()) == 2000
    assert 900 < counts["b"] < 1100 and 400 < counts["a"] < 600


def test_shared_key_from_an_earlier_dataset_with_nulls_and_conditions(spark):
    people = DatasetSpec("people", 20, fields(("id", "uuid_int", "integer")))
    orders = DatasetSpec(
        "orders", 300,
        (
            Field("n", "random_int", "integer", constraint=Constraint(min=0, max=9)),
            Field("who", "shared_key", "integer", condition="n > 4", null_probability=0.2),
            Field("tag", "formula", formula="{{ who }}"),
        ),
        shared_key=SharedKey("people", "id"),
    )
    made = generate(spark, Request((people, orders), 50, 9), AS_OF).datasets
    known = {r.id for r in made["people"].collect()}
    rows = made["orders"].collect()
    assert {r.who for r in rows} - {None} <= known and all(r.who is None for r in rows if r.n <= 4)
    assert all(r.tag == str(r.who) for r in rows) and len(rows) == 300


def test_shared_key_of_an_empty_pool_and_without_one(spark):
    pool = spark.createDataFrame([], "k string")
    spec = DatasetSpec("s", 5, (Field("k", "shared_key"),), shared_key=SharedKey("pool", "k"))
    made = generate(spark, Request((spec,), 50, 1), AS_OF, {"pool": pool}).datasets["s"]
    assert [r.k for r in made.collect()] == [None] * 5
    bare = generate(spark, Request((DatasetSpec("s", 5, (Field("k", "shared_key"),)),), 50, 1), AS_OF).datasets["s"]
    assert [r.k for r in bare.collect()] == [""] * 5


def test_shared_key_joins_without_broadcast(spark, no_broadcast):
    pool = spark.range(1000).select((F.col("id") % 7).alias("k"))
    spec = DatasetSpec("s", 500, (Field("k", "shared_key", "integer"),), shared_key=SharedKey("pool", "k"))
    made = generate(spark, Request((spec,), 50, 1), AS_OF, {"pool": pool}).datasets["s"]
    assert made.count() == 500 and made.where("k IS NULL").count() == 0


def test_flat_generation_does_not_shuffle(spark):
    spec = DatasetSpec("d", 1000, (*SIMPLE, Field("f", "formula", formula="{{ first_name }} {{ age }}")))
    assert "Exchange" not in plan(flat_dataset(spark, spec, Run(1)))


def test_shared_key_joins_carry_row_numbers_only(spark, no_broadcast):
    pool = spark.range(1000).withColumnRenamed("id", "k")
    spec = DatasetSpec("s", 500, (Field("n", "name"), Field("k", "shared_key", "integer")), shared_key=SharedKey("pool", "k"))
    text = plan(flat_dataset(spark, spec, Run(1), {"pool": pool}))
    assert "SortMergeJoin" in text and "Exchange" not in text[: text.index("SortMergeJoin")]
    assert "concat_ws" in text[: text.index("SortMergeJoin")]  # names are made after the join


def test_cut_points_stay_in_range():
    assert cut_point(0) == 0 and cut_point(1.0) == 2**63 - 1
