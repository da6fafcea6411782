"""Streams that are stopped, started again, run twice and fed late, against the batch forms."""

import datetime
import os
import random
import shutil

import pytest

from scrubline.operators import lookups, tables
from scrubline.streaming import feeds

START = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, domain string, url_host string, success boolean"


def events(n, seed=1, hosts=3, begin=0):
    rng = random.Random(seed)
    return [(begin + i, START + datetime.timedelta(seconds=(begin + i) * 20 + rng.randrange(15)), "d", rng.choice(["a.org", "a.org", "b.org"][:hosts]), rng.random() < 0.4) for i in range(n)]


def feed(spark, folder, rows, kinds=EVENTS):
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(folder)


def plain(rows, until=None):
    out = {}
    for _, ts, _, host, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        if until is None or ts < until:
            out[host] = min(max(out.get(host, 0.5) + (0.02 if ok else -0.01), 0.0), 1.0)
    return {h: round(s, 6) for h, s in out.items()}


def scores(frame):
    return {r["url_host"]: round(r["score"], 6) for r in frame.collect()}


def ended(rows, late=10):
    """The end of the last minute behind the watermark."""
    mark = max(r[1] for r in rows) - datetime.timedelta(minutes=late)
    return mark.replace(second=0, microsecond=0)


def test_scores_survive_restarts_and_batches_run_twice(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "state")
    rows = events(400)
    feed(spark, folder, rows)
    read = lambda: feeds.read_feed(spark, folder, spark.createDataFrame([], EVENTS), files=1)
    run = lambda: feeds.run_trust(read(), ["ts", "event_id"], place)[0]
    first = scores(run())
    assert first == plain(rows, ended(rows))
    assert scores(run()) == first  # nothing new
    more = events(300, seed=2, begin=400)
    feed(spark, folder, more)
    second = scores(run())
    assert second == plain(rows + more, ended(rows + more))
    # the last batch's commit is lost: it runs again
    commits = sorted((int(f) for f in os.listdir(f"{place}/checkpoint/commits") if f.isdigit()))
    os.remove(f"{place}/checkpoint/commits/{commits[-1]}")
    crc = f"{place}/checkpoint/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert scores(run()) == second
    whole = feeds.with_open_minutes(run(), spark.createDataFrame(rows + more, EVENTS), ["ts", "event_id"])
    batch = lookups.source_trust(spark.createDataFrame(rows + more, EVENTS), ["ts", "event_id"])
    assert sorted(whole.collect()) == sorted(batch.select(*whole.columns).collect())


def test_late_outcomes_count_within_the_delay_only(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "state")
    rows = events(300)
    held = [r for r in rows if 200 <= r[0] < 300 and r[0] % 7 == 0]  # late, but within ten minutes
    held = [r for r in held if r[1] > ended([x for x in rows if x not in held])]
    feed(spark, folder, [r for r in rows if r not in held])
    place_of = lambda: feeds.run_trust(feeds.read_feed(spark, folder, spark.createDataFrame([], EVENTS), files=1), ["ts", "event_id"], place)[0]
    place_of()
    too_late = (9999, START, "d", "a.org", True)
    feed(spark, folder, [*held, too_late])
    more = events(200, seed=3, begin=300)
    feed(spark, folder, more)
    assert held and scores(place_of()) == plain(rows + more, ended(rows + more))


def test_idle_hosts_begin_anew(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "state")
    day = datetime.timedelta(days=1)
    one = lambda i, host, at: (i, at, "d", host, True)
    run = lambda: {r["url_host"]: round(r["score"], 6) for r in feeds.run_trust(feeds.read_feed(spark, folder, spark.createDataFrame([], EVENTS), files=1), ["ts", "event_id"], place, idle_days=5)[0].collect()}
    feed(spark, folder, [one(i, "idle.org", START) for i in range(5)] + [one(10, "busy.org", START)])
    for n in range(1, 7):
        feed(spark, folder, [one(10 + n, "busy.org", START + 3 * n * day)])
        run()
    feed(spark, folder, [one(50, "idle.org", START + 20 * day), one(51, "busy.org", START + 20 * day)])
    run()
    feed(spark, folder, [one(60, "busy.org", START + 21 * day)])
    assert run() == {"idle.org": 0.52, "busy.org": 0.66}


ROWS = "k long, v string, o long"


@pytest.mark.parametrize("dies_at", [0, 1, 2])
def test_a_stored_table_takes_each_key_once(spark, tmp_path, dies_at):
    rng = random.Random(dies_at)
    folder, path = str(tmp_path / "in"), str(tmp_path / "table")
    batches = [[(rng.randrange(30), f"{b}-{i}", 100 * b + i) for i in range(40)] for b in range(3)]
    for n, rows in enumerate(batches):
        feed(spark, folder, rows, ROWS)
        os.utime(next(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part") and not os.path.exists(f"{tmp_path}/{f}")), (1_700_000_000 + n, 1_700_000_000 + n))
        for f in os.listdir(folder):
            open(f"{tmp_path}/{f}", "a").close()
    read = lambda: feeds.read_feed(spark, folder, spark.createDataFrame([], ROWS), files=1)
    with pytest.raises(Exception, match="stopped before the ledger"):
        feeds.run_insert_ignore(read(), ["k"], "o", path, fail_after=dies_at)
    got = sorted(feeds.run_insert_ignore(read(), ["k"], "o", path).collect())
    every = spark.createDataFrame([r for b in batches for r in b], ROWS)
    assert got == sorted(tables.new_rows(every.limit(0), every, ["k"], "o").collect())
    assert sorted(feeds.run_insert_ignore(read(), ["k"], "o", path).collect()) == got
    # the ledger has the batch, the checkpoint doesn't: it runs again and adds nothing
    last = max(int(f) for f in os.listdir(f"{path}/checkpoint/commits") if f.isdigit())
    os.remove(f"{path}/checkpoint/commits/{last}")
    if os.path.exists(f"{path}/checkpoint/commits/.{last}.crc"):
        os.remove(f"{path}/checkpoint/commits/.{last}.crc")
    assert sorted(feeds.run_insert_ignore(read(), ["k"], "o", path).collect()) == got
    shutil.rmtree(path)


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with feeds.settings(spark, {"spark.sql.streaming.stateStore.providerClass": "x", "spark.some.own": "1"}):
        assert spark.conf.get("spark.some.own") == "1"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before and spark.conf.get("spark.some.own", None) is None
