"""Bit functions against Python integers."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopgrid.functions import bits

LONG = st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(LONG, LONG), min_size=1, max_size=40))
def test_bits(spark, pairs):
    pairs = [*pairs, (0, -1), (-(2**63), 1), (1, 0), (-1, -1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", bits.and_not(a, b), bits.any_set([a, b]), bits.popcount([a, b]), bits.trailing_zeros(a)).collect()
    for x, y, andnot, any_, pop, ctz in got:
        m = 2**64 - 1
        assert andnot & m == x & ~y & m and any_ == bool(x or y) and pop == (x & m).bit_count() + (y & m).bit_count()
        assert ctz == (64 if x == 0 else ((x & m) & -(x & m)).bit_length() - 1)


def test_single_bits(spark):
    row = spark.range(1).select(*[bits.bit(i).alias(f"b{i}") for i in range(64)]).first()
    assert [r % 2**64 for r in row] == [1 << i for i in range(64)]
    assert [bits.full_mask(n) % 2**64 for n in (0, 1, 63, 64)] == [0, 1, 2**63 - 1, 2**64 - 1]
