"""Every SQL twin belongs to a query, and the flagship runs end to end."""

import __spark_entry__ as entry


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 208
    ids = {k.split("_")[0] for k in q}
    want = {f"{sec}{i}" for sec, n in dict(a=15, b=13, c=12, d=12, e=23, f=21, g=16, h=16, i=8, j=24, k=22, l=26).items() for i in range(1, n + 1)}
    assert want <= ids, sorted(want - ids)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.split for r in rows} <= {"train", "val", "test"} and rows
    train = next(r for r in rows if r.split == "train")
    assert train.fp == 0
