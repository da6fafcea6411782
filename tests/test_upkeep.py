"""Stored tables by bucket, steps that fail on rows, and the states of patterns, each against a plain form."""

import datetime
import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from scrubline.operators import buckets, isolation, patterns

ROWS = "k long, v string, w string, n long"


def files(path):
    return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_few_changes_rewrite_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = buckets.Stored(spark, path, ("k",), 32).create(spark.createDataFrame([(i, f"v{i}", "old", 0) for i in range(400)], ROWS))
    before = files(path)
    rows = spark.createDataFrame([(7, "a", "new", 1), (7, "b", "new", 2), (1000, "c", "new", 1), (None, "d", "new", 1)], ROWS)
    touched = table.upsert(rows, ["v"], "n")
    assert 1 <= len(touched) <= 3
    moved = {f for f in before if f not in files(path)}
    assert moved and all(f.split("bucket=")[1].split("/")[0] in map(str, touched) for f in moved | set(files(path)) - set(before))
    got = {r.k: (r.v, r.w) for r in table.read().collect()}
    assert got[7] == ("b", "old") and got[1000] == ("c", "new") and got[None] == ("d", "new") and len(got) == 402 and got[8] == ("v8", "old")
    once = files(path)
    assert table.upsert(rows.limit(0), ["v"], "n") == [] and files(path) == once
    table.upsert(rows, ["v"], "n")
    assert {r.k: (r.v, r.w) for r in table.read().collect()} == got
    table.delete(spark.createDataFrame([(i,) for i in range(400)], "k long"))
    assert sorted(r.k or 0 for r in table.read().collect()) == [0, 1000]
    table.insert_ignore(spark.createDataFrame([(1000, "no", "x", 1), (5, "yes", "x", 1)], ROWS), "n")
    assert {r.k: r.v for r in table.read().collect()} == {None: "d", 1000: "c", 5: "yes"}


def test_updates_of_stored_rows(spark, tmp_path):
    table = buckets.Stored(spark, str(tmp_path / "t"), ("id",), 8).create(spark.createDataFrame([(i, 30, "x") for i in range(50)], "id long, age int, city string"))
    refused = table.update_fields(spark.createDataFrame([(3, 40, None), (4, 400, "y"), (99, 1, "z")], "id long, age int, city string"), ["age", "city"], F.when(~F.col("age").between(1, 120), F.array(F.lit("age"))).otherwise(F.array().cast("array<string>")))
    assert [(r.id, r.reasons) for r in refused.collect()] == [(4, ["age"])]
    assert {r.id: (r.age, r.city) for r in table.read().where("id IN (3, 4, 5)").collect()} == {3: (40, "x"), 4: (30, "x"), 5: (30, "x")}


def test_a_poisoned_row_stands_alone(spark):
    calls = []

    def step(batch):
        calls.append(batch.num_rows)
        return {"y": [10 // x for x in batch.column(0).to_pylist()]}

    values, errors = isolation.bisected(pa.RecordBatch.from_pydict({"x": [1] * 500 + [0] + [2] * 523}), step, ["y"])
    assert values["y"] == [10] * 500 + [None] + [5] * 523 and [i for i, e in enumerate(errors) if e] == [500] and len(calls) <= 25
    assert isolation.bisected(pa.RecordBatch.from_pydict({"x": pa.array([], pa.int64())}), lambda b: {"y": []}, ["y"]) == ({"y": []}, [])

    def divide(batch):
        return {"y": [10 // x for x in batch.column(batch.schema.names.index("x")).to_pylist()]}

    df = spark.createDataFrame([(1, 5, None), (2, 0, None), (3, 2, "before"), (4, None, None)], "id long, x long, error string").repartition(1)
    got = {r.id: r for r in isolation.isolated(df, "divide", divide, "y long").collect()}
    assert {i: r.y for i, r in got.items()} == {1: 2, 2: None, 3: None, 4: None}
    assert got[2].error.startswith("ZeroDivisionError") and got[3].error == "before" and got[4].error.startswith("TypeError") and got[1].error is None
    assert {i: [a.skill for a in r.audit] for i, r in got.items()} == {1: [], 2: ["divide"], 3: [], 4: ["divide"]}


def test_states_equal_a_loop_over_uses(spark):
    rng = random.Random(12)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for p in range(12):
        good = 0.9
        for d in range(40):
            good = rng.choice((0.95, 0.95, 0.3)) if d % 10 == 0 else good
            for _ in range(rng.choice((0, 0, 1, 4))):
                rows.append((len(rows), f"p{p}", start + datetime.timedelta(days=d, seconds=rng.randrange(86_400)), f"s{rng.randrange(5)}", rng.random() < good))
    want = {}
    for p in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == p), key=lambda r: (r[2], r[0]))
        state = "candidate"
        for day in sorted({r[2].date() for r in own}):
            done = [r for r in own if r[2].date() <= day]
            rate, recent = (sum(r[4] for r in x) / len(x) for x in (done, done[-10:]))
            if state == "promoted":
                state = "demoted" if rate - recent > 0.15 else "promoted"
            elif len(done) >= 5 and len({r[3] for r in done}) >= 3 and rate >= 0.75 and recent >= 0.75:
                state = "promoted"
            want[p, day] = (len(done), state)
    got = {(r.p, r.day): (r.uses, r.state) for r in patterns.pattern_states(spark.createDataFrame(rows, "i long, p string, ts timestamp, source string, success boolean").repartition(5), ["p"], "i").collect()}
    assert got == want and {s for _, s in want.values()} == {"candidate", "promoted", "demoted"}
    assert any(want[k][1] == "promoted" and any(q == k[0] and d < k[1] and s == "demoted" for (q, d), (_, s) in want.items()) for k in want)


def test_upsert_takes_every_order_and_new_keys(spark):
    """Every customer is there, with its last order if it has one, and every supplier is added."""
    from scrubline.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    want = {("customer", k): (v, "old") for k, v in read("customer", "c_custkey", "c_name")}
    for o, k in sorted(read("orders", "o_orderkey", "o_custkey")):
        want["customer", k] = (f"order {o}", want.get(("customer", k), ("", "new"))[1])
    want |= {("supplier", k): (v, "new") for k, v in read("supplier", "s_suppkey", "s_name")}
    rows = QUERIES["upsert"](spark, sf).collect()
    assert len(rows) == len(want) and {(r.kind, r.k): (r.v, r.w) for r in rows} == want
