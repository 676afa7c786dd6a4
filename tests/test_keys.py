import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.operators.keys import SINGLE, All, Empty, Hash, Keys, Range, from_dict

small = st.integers(-5, 30)
ranges = st.builds(Range, small, small)
hashes = st.builds(lambda a, b, q, i: Hash.of(a, b, q, i), small, small, st.integers(1, 6), st.integers(0, 5))
lists = st.builds(lambda k: Keys.of(k), st.lists(small, max_size=8))
sets = st.one_of(ranges, hashes, lists, st.just(Empty()), st.just(All()))


@given(sets, sets)
def test_intersection_is_conjunction(a, b):
    both, other = a.intersect(b), b.intersect(a)
    for k in range(-10, 40):
        assert both.contains(k) == other.contains(k) == (a.contains(k) and b.contains(k))


@given(st.integers(0, 20), st.integers(0, 20), st.integers(1, 8))
def test_splits_cover_and_dont_overlap(first, n, parts):
    r = Range(first, first + n - 1)
    for split in (r.linear_split(parts), r.hash_split(parts)):
        assert len(split) == parts
        assert sorted(k for p in split for k in p) == list(r)


@pytest.mark.parametrize(("last", "n", "sizes"), [(9, 3, [4, 4, 2]), (3, 3, [2, 2, 0]), (4, 4, [2, 2, 1, 0])])
def test_linear_split_of_fixtures(last, n, sizes):
    assert [len(p) for p in Range(0, last).linear_split(n)] == sizes


@given(sets)
def test_round_trip(s):
    assert from_dict(s.to_dict()) == s


def test_ranges():
    assert Range(2, 8).intersect(Range(5, 12)) == Range(5, 8)
    assert list(Hash.of(0, 9, 3, 1).intersect(Range(2, 8))) == [4, 7]
    assert Range(0, 1).intersect(Range(3, 4)) == Empty()
    assert Range(0, 3).overlaps(Range(3, 9)) and not Range(0, 3).overlaps(Range(4, 9))
    assert Range(0, 1).hull(Range(8, 9)) == Range(0, 9)
    assert list(SINGLE) == [0]
    assert Keys.of([1]).add(2).intersect(All()) == Keys.of([1, 2])
    with pytest.raises(TypeError):
        len(All())


def test_columns_agree_with_contains(spark):
    df = spark.range(-10, 40)
    for s in (Range(2, 8), Hash.of(-7, 20, 4, 3), Keys.of([1, 5, 99]), Keys.of([]), All(), Empty()):
        assert {r[0] for r in df.where(s.column(F.col("id"))).collect()} == {k for k in range(-10, 40) if s.contains(k)}
