import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeflow.functions.tokens import MAX_TOKEN, MIN_TOKEN, murmur3_token, unit_of
from rangeflow.plans.planner import FULL_RING, PlanError, TokenRange, desired_units, owned_ranges, plan, split_range, split_ring, split_topology


def test_pinned_splits():
    assert [(r.start, r.end) for r in split_range(TokenRange(0, 100), 4)] == [(0, 25), (25, 50), (50, 75), (75, 100)]
    assert len(split_range(TokenRange(0, 3), 100)) == 3
    ring = split_ring(16)
    assert (ring[0].start, ring[-1].end, len(ring)) == (MIN_TOKEN, MAX_TOKEN, 16)
    assert desired_units(32) == 512


@given(st.integers(MIN_TOKEN, MAX_TOKEN), st.integers(MIN_TOKEN, MAX_TOKEN), st.integers(1, 300))
def test_a_split_covers_its_parent(a, b, n):
    if a == b:
        return
    parent = TokenRange(min(a, b), max(a, b))
    found = split_range(parent, n)
    assert found[0].start == parent.start and found[-1].end == parent.end and len(found) == min(n, parent.width)
    assert all(x.end == y.start for x, y in zip(found, found[1:]))


def test_topology():
    owned = owned_ranges([100, -50, 100, 7])
    assert [(r.start, r.end) for r in owned] == [(100, MAX_TOKEN), (MIN_TOKEN, -50), (-50, 7), (7, 100)]
    assert len(split_topology(owned, 10)) == 10
    assert len(split_topology(owned, 2)) == 4
    with pytest.raises(PlanError):
        owned_ranges([])


def test_rejections():
    for bad in (lambda: split_range(FULL_RING, 0), lambda: TokenRange(5, 5), lambda: plan(max_units=0), lambda: plan("other")):
        with pytest.raises(PlanError):
            bad()
    assert len(plan(units=64, max_units=3)) == 3


@pytest.mark.parametrize("parent,n", [(FULL_RING, 16), (FULL_RING, 512), (TokenRange(-1, 2**60 - 1), 16), (TokenRange(0, 7), 3), (TokenRange(-5, 100), 1)])
def test_boundary_tokens_fall_into_their_unit(spark, parent, n):
    ranges = split_range(parent, n)
    tokens = sorted({t for r in ranges for t in (r.start, r.start + 1, r.end - 1, r.end) if MIN_TOKEN <= t <= MAX_TOKEN})
    df = spark.createDataFrame([(t,) for t in tokens], "t bigint")
    for t, unit in df.select("t", unit_of("t", (parent.start, parent.end), n)).collect():
        assert unit == next((k for k, r in enumerate(ranges) if t in r), None)


def test_ring_tokens():
    as_hex = lambda text: f"{murmur3_token(text) & (2**64 - 1):016x}"
    assert as_hex(b"hello") == "cbd8a7b341bd9b02"
    assert as_hex(b"hello, world") == "342fac623a5ebc8e"
    assert murmur3_token(b"") == 0


@settings(max_examples=50)
@given(st.binary(max_size=80))
def test_ring_tokens_are_never_the_smallest(data):
    assert MIN_TOKEN < murmur3_token(data) <= MAX_TOKEN


def test_uneven_plans_by_cells(spark, monkeypatch):
    from rangeflow.operators import scan
    from rangeflow.plans import planner

    ranges = split_topology(owned_ranges([k * 2**58 + 17 for k in range(-20, 20)]), 100)
    frame = planner.frame(spark, ranges)
    df = spark.createDataFrame([(t,) for r in ranges[::7] for t in (r.start + 1, r.end)] + [(None,)], "_tok bigint")
    want = sorted((str(t), u) for t, u in scan.assign_ranges(df, frame).collect())
    monkeypatch.setattr(scan, "MAX_BROADCAST_RANGES", 10)
    assert sorted((str(t), u) for t, u in scan.assign_ranges(df, frame).collect()) == want
    assert all(u is None if t == "None" else int(t) in ranges[u] for t, u in want)


def test_ring_tokens_of_columns(spark):
    from pyspark.sql import functions as F

    from rangeflow.functions.tokens import key_bytes, ring_token

    df = spark.createDataFrame([("hello", 7), (None, 8), ("é" * 20, 9)], "a string, b int")
    one = df.select(ring_token(F.col("a").cast("binary"))).collect()
    assert [r[0] for r in one] == [murmur3_token(b"hello"), None, murmur3_token(("é" * 20).encode())]
    both = df.where("b = 7").select(key_bytes(F.col("a").cast("binary"), F.unhex(F.lit("00000007"))).alias("k")).first()
    assert bytes(both.k) == b"\x00\x05hello\x00" + b"\x00\x04\x00\x00\x00\x07\x00"


@settings(max_examples=30)
@given(st.lists(st.binary(max_size=70), max_size=20))
def test_many_ring_tokens_are_those_of_each(keys):
    from rangeflow.functions.tokens import murmur3_tokens

    assert murmur3_tokens(keys).tolist() == [murmur3_token(k) for k in keys]
