"""Lookup-table sharding: balance, little movement, equal keys together, written shards."""

import numpy as np
import pytest

from textgauge.llm import sharding


def brute_fill(names, size):
    prefs = []
    for n in names:
        offset, skip = sharding.preference(n, size)
        prefs.append([(offset + j * skip) % size for j in range(size)])
    table, nxt = [None] * size, [0] * len(names)
    while None in table:
        for i, p in enumerate(prefs):
            if None not in table:
                break
            while table[p[nxt[i]]] is not None:
                nxt[i] += 1
            table[p[nxt[i]]] = i
    return table


def test_fill():
    names = sharding.shard_names(7)
    assert sharding.fill_table(names, 101).tolist() == brute_fill(names, 101)
    table = sharding.fill_table(sharding.shard_names())
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    less = sharding.fill_table([n for n in sharding.shard_names() if n != "shard-00127"])
    stay = table < 127
    assert (table[stay] != less[stay]).mean() < 0.05
    weighted = np.bincount(sharding.fill_table(["a", "b"], 101, [3, 1]))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4
    for bad in ((names, 100), (["a", "a"], 101), ([], 101)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_place(spark, fresh):
    table = sharding.fill_table(sharding.shard_names(5), 101)
    rows = [(i % 50, "x", 7) for i in range(200)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.place(df, ["doc_id"], table).collect()
    assert len(got) == 203 and len({(r.doc_id, r.shard) for r in got}) == 51
    assert all(table[r.slot] == r.shard for r in got)
    assert sharding.place(df.where("false"), ["doc_id"], table).count() == 0
    sharding.write_shards(df, "doc_id", table, f"{fresh}/out", files_per_shard=2)
    back = spark.read.parquet(f"{fresh}/out")
    where = {r.doc_id: r.shard for r in got}
    assert back.count() == 203 and all(where[r.doc_id] == r.shard_no for r in back.collect())


def test_clashing_names(spark, fresh):
    table = sharding.fill_table(sharding.shard_names(5), 101)
    rows = [(i, i % 3, i % 7, "x", "y") for i in range(60)]
    df = spark.createDataFrame(rows, "slot bigint, shard_no int, slot_of int, Slot_No string, shard string")
    got = sharding.place(df, ["slot", "shard"], table)
    assert got.columns == ["slot", "shard", "slot_", "shard_"]
    where = {r.slot: (r.slot_, r.shard_) for r in got.collect()}
    assert set(where) == set(range(60)) and all(table[s] == n for s, n in where.values())
    sharding.write_shards(df, "slot", table, f"{fresh}/out")
    back = spark.read.parquet(f"{fresh}/out")
    assert set(back.columns) == {*df.columns, "shard_no_"}
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == rows
