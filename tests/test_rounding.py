from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableloom.functions.labels import magnitude_label
from tableloom.functions.rounding import round_half_even

NUMBERS = st.lists(
    st.one_of(
        st.floats(-1e9, 1e9, allow_subnormal=False),
        st.integers(-(10**7), 10**7).map(lambda n: n / 1000),
        st.integers(-(10**6), 10**6).map(lambda n: n / 8),
    ),
    min_size=50,
    max_size=200,
)


@given(NUMBERS, st.integers(0, 4))
@settings(max_examples=15, deadline=None)
def test_rounds_like_python(spark, numbers, digits):
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for x, made in df.select("x", round_half_even(F.col("x"), digits).alias("r")).collect():
        assert made == round(x, digits), x


def test_known_ties(spark):
    df = spark.createDataFrame([(2.675,), (1.125,), (0.5,), (-2.5,), (1e300,)], "x double")
    assert [r.r for r in df.select(round_half_even(F.col("x"), 2).alias("r")).collect()] == [2.67, 1.12, 0.5, -2.5, 1e300]


@given(NUMBERS)
@settings(max_examples=5, deadline=None)
def test_labels_use_the_exact_value(spark, numbers):
    amounts = [abs(x) + 1e6 for x in numbers]
    df = spark.createDataFrame([(x,) for x in amounts], "x double")
    for x, label in df.select("x", magnitude_label(F.col("x")).alias("l")).collect():
        bound, suffix = (1e9, "B") if x >= 1e9 else (1e6, "M")
        exact = Decimal(x / bound).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert label == f"${exact}{suffix}"


def test_small_and_missing_amounts(spark):
    df = spark.createDataFrame([(None,), (1234.5,), (0.0,), (2.5e12,)], "x double")
    assert [r.l for r in df.select(magnitude_label(F.col("x")).alias("l")).collect()] == ["—", "$1,234.50", "$0.00", "$2.50T"]
