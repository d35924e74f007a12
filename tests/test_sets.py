import pytest

from driftline.operators import sets


@pytest.fixture
def num(spark):
    def make(values, payload="p"):
        return spark.createDataFrame([(v, f"{payload}{v}") for v in values], "id int, payload string")

    return make


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_minus(num):
    ten = num(range(10))
    assert ids(sets.set_minus(ten, num([]), ["id"])) == list(range(10))
    assert ids(sets.set_minus(ten, ten, ["id"])) == []
    assert ids(sets.set_minus(ten, num([0, 2, 4, 6, 8, 12]), ["id"])) == [1, 3, 5, 7, 9]
    assert ids(sets.set_minus(ten, [num([0, 1]), num([1, 2, 3])], ["id"])) == [4, 5, 6, 7, 8, 9]


def test_intersect(num):
    ten = num(range(10))
    assert ids(sets.intersect(ten, num([]), ["id"])) == []
    assert ids(sets.intersect(ten, num([8, 9, 10]), ["id"])) == [8, 9]
    assert ids(sets.intersect(ten, [num([1, 2, 3]), num([2, 3, 4])], ["id"])) == [2, 3]


def test_union_prefers_the_left(num):
    union = sets.union_by_key(num([0, 1, 2, 3], "a"), num([3, 4, 5], "b"), num([0, 4, 6], "c"), keys=["id"])
    assert sorted((r.id, r.payload) for r in union.collect()) == [
        (0, "a0"), (1, "a1"), (2, "a2"), (3, "a3"), (4, "b4"), (5, "b5"), (6, "c6")]
    assert ids(sets.union_by_key(num([1]), keys=["id"])) == [1]
    with pytest.raises(ValueError):
        sets.union_by_key(keys=["id"])


def test_union_find(num):
    sources = num([1, 2], "a"), num([2, 3], "b")
    assert [r.payload for r in sets.union_find(*sources, key={"id": 2}).collect()] == ["a2"]
    assert [r.payload for r in sets.union_find(*sources, key={"id": 3}).collect()] == ["b3"]
    assert sets.union_find(*sources, key={"id": 9}).collect() == []


def test_diff_only(num):
    changed = num([1], "a").unionByName(num([2, 3], "b"))
    assert ids(sets.diff_only(num([1, 2, 4], "a"), changed, ["id"])) == [2, 4]
    assert ids(sets.diff_only(num([1, 2, 4], "a"), [changed, num([4], "a")], ["id"])) == [2]


def test_diff_only_takes_nulls_as_values(spark):
    mine = spark.createDataFrame([(1, None), (2, None)], "id int, payload string")
    theirs = spark.createDataFrame([(1, None), (2, "x")], "id int, payload string")
    assert ids(sets.diff_only(mine, theirs, ["id"])) == [2]


def test_upsert_keeps_the_last_write(spark):
    puts = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, None)], "id int, seq int, v string")
    assert sorted((r.id, r.v) for r in sets.upsert(puts, ["id"], ["seq"]).collect()) == [(1, "b"), (2, None)]


def test_deciders_cascade(num):
    kept = sets.filter_by_lookup(
        num(range(6)), [num([1, 2, 3]), num([3])], ["id"], lambda mine, found: found.isNull() | (mine["id"] == 2))
    assert ids(kept) == [0, 2, 4, 5]
