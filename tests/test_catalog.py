from __future__ import annotations

import json

import pytest

from fieldloom.operators import catalog as C


def attr(v):
    return {"type": "attr", "info": {"value": v}}


def item(**leaves):
    return {"type": "stem", "info": leaves}


def rows(df):
    return sorted((r.category or "", r.stem or "", tuple(r.path), r.name, json.loads(r.value)) for r in df.collect())


@pytest.fixture(scope="module")
def host(spark):
    return C.flatten(spark, {"params": {"cls": attr(["a"])}, "modified": {"s0": item(cid=attr("A"), **{"0": item(bbox=attr([1, 2, 3, 4]))})}, "staged": {"s1": item(keep=attr(1))}})


def test_round_trip(spark, host):
    assert C.nested(host.collect()) == C.nested(C.flatten(spark, C.nested(host.collect())).collect())


def test_leaves(host):
    assert {tuple(r.path) for r in C.leaves(host).collect()} == {(), ("modified", "s0"), ("modified", "s0", "0"), ("staged", "s1")}


def test_move_there_and_back(spark, host):
    s = spark.createDataFrame([("s0",)], "stem string")
    there = C.move(host, s, "staged")
    assert {r.category for r in C.items(there).where("stem = 's0'").collect()} == {"staged"}
    assert rows(C.move(there, s, "modified")) == rows(host)


def test_delete_and_unknown(spark, host):
    gone = C.delete(host, spark.createDataFrame([("s0",), ("nobody",)], "stem string"))
    assert [r.stem for r in C.items(gone).collect()] == ["s1"]
    with pytest.raises(KeyError):
        C.require(host, "nobody")


def test_conflicts(spark, host):
    other = C.flatten(spark, {"modified": {"s1": item(y=attr(2)), "s2": item(z=attr(3))}})
    assert [r.stem for r in C.conflicts(host, other).collect()] == ["s1"]


def test_merge_skip_keeps_host_leaves(spark, host):
    other = C.flatten(spark, {"params": {"cls": attr(["b"]), "p": attr(1)}, "modified": {"s0": item(cid=attr("B"), new=attr(7), **{"0": item(bbox=attr([9]), k=attr(1))}), "s1": item(y=attr(2)), "s2": item(z=attr(3))}})
    got = rows(C.merge(host, other))
    assert all(r in got for r in rows(host))
    assert ("modified", "s0", (), "new", 7) in got and ("modified", "s0", ("0",), "k", 1) in got
    assert ("modified", "s2", (), "z", 3) in got and ("", "", (), "p", 1) in got
    assert not [r for r in got if r[1] == "s1" and r[3] == "y"]


def test_merge_override(spark, host):
    other = C.flatten(spark, {"modified": {"s1": item(y=attr(2))}})
    got = [r for r in rows(C.merge(host, other, override=True)) if r[1] == "s1"]
    assert got == [("modified", "s1", (), "y", 2)]


def test_leaf_does_not_hide_container(spark, host):
    other = C.flatten(spark, {"modified": {"s0": {"type": "stem", "info": {"cid": item(x=attr(1)), "0": attr(5)}}}})
    assert rows(C.merge(host, other)) == rows(host)


def test_attr(host, spark):
    got = {r.stem: r.value for r in C.attr(host, "cid", "none").collect()}
    assert got == {"s0": "A", "s1": "none"}
    assert {r.value for r in C.attr(C.set_attr(host, "s1", "cid", "C"), "cid").collect()} == {"A", "C"}


def test_gather(host):
    assert C.gather(host, ["staged"]).count() == 2
