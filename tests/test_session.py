"""Scratch tables are given back."""

import os

from contrapair.session import materialise, scratch, shared_folder


def held(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("table-")}


def test_scope_deletes_what_it_wrote_and_keeps_what_it_is_told(spark):
    outer = materialise(spark.range(3))
    before = held(spark)
    with scratch(spark) as tables:
        a = materialise(spark.range(5))
        with scratch(spark) as inner:
            materialise(spark.range(7))
            b = inner.keep(a.selectExpr("id + 1 AS id"))
            assert len(held(spark)) == len(before) + 3
        assert len(held(spark)) == len(before) + 2 and b.count() == 5
        c = tables.keep(b.where("id > 2"))
    assert len(held(spark)) == len(before) + 1
    assert sorted(r[0] for r in c.collect()) == [3, 4, 5] and outer.count() == 3


def test_scope_ends_with_an_error(spark):
    before = held(spark)
    try:
        with scratch(spark):
            materialise(spark.range(5))
            raise KeyError
    except KeyError:
        pass
    assert held(spark) == before
