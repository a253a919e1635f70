"""The ledger held in state: any order, repeats, restarts and late events come to what the batch operator says of the same records."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import references as R
from ledgerloom.streaming import ledger


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledger.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def records(rng: random.Random) -> list[dict]:
    events = [{"event_id": f"e{i}", "ts": f"2026-01-{rng.randint(1, 28):02}T00:00:{n:02}Z", "level": rng.choice(["significant", "minor"]), "acknowledged": rng.random() < 0.1} for i in range(30) for n in range(rng.randint(1, 3))]
    acks = [{"event_id": f"e{rng.randint(0, 35)}", "ts": "2026-02-01T00:00:00Z", "record_type": "acknowledgement"} for _ in range(15)]
    return events + acks + rng.sample(events, 20)


def test_any_order_and_restarts_equal_the_batch(spark, store, tmp_path) -> None:
    rng = random.Random(9)
    rows = records(rng)
    for run in range(2):
        rng.shuffle(rows)
        src, out = tmp_path / f"in{run}", str(tmp_path / f"out{run}")
        src.mkdir()
        for part in range(2):  # started again for each part
            (src / f"{part}.jsonl").write_text("\n".join(map(json.dumps, rows[part::2])) + "\n{bad")
            ledger.follow(ledger.read_events(spark, str(src)), out, str(tmp_path / f"cp{run}"), hold=3600).awaitTermination(120)
        got = {tuple(r)[:4] for r in ledger.current(spark, out).collect()}
        whole = spark.read.schema("event_id string, ts timestamp, level string, acknowledged boolean, record_type string").json(str(src)).where("event_id IS NOT NULL")
        want = R.ledger_state(whole.where("record_type IS NULL").drop("record_type"), whole.where("record_type IS NOT NULL"))
        assert got == {(r["event_id"], r["ts"], r["level"], r["acknowledged"]) for r in want.collect()}
        told = spark.read.parquet(out)
        assert told.groupBy("event_id", "version").count().where("count > 1").isEmpty()  # each change once
        assert told.where("change = 'opened'").count() == len(got)


def test_open_events_become_overdue_once(spark, store, tmp_path) -> None:
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    line = '{{"event_id":"{}","ts":"2020-01-01T00:00:00Z","level":"significant"{}}}\n'
    (src / "1.jsonl").write_text(line.format("a", "") + line.format("b", "") + line.format("c", ',"acknowledged":true'))
    ack = '{"event_id":"b","ts":"2026-01-01T00:00:00Z","record_type":"acknowledgement"}\n'
    for n, text in ((2, ack), (3, line.format("d", "")), (4, line.format("a", ""))):
        ledger.follow(ledger.read_events(spark, str(src)), out, cp, hold=0).awaitTermination(120)
        (src / f"{n}.jsonl").write_text(text)
    ledger.follow(ledger.read_events(spark, str(src)), out, cp, hold=0).awaitTermination(120)
    state = {r["event_id"]: (r["acknowledged"], r["overdue"]) for r in ledger.current(spark, out).collect()}
    assert state["a"] == (False, True) and state["b"] == (True, False) and state["c"] == (True, False)
    assert spark.read.parquet(out).where("event_id = 'a' AND change = 'overdue'").count() == 1
    assert spark.read.parquet(out).agg(F.max("version")).first()[0] <= 3
