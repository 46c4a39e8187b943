from __future__ import annotations

import random
from datetime import datetime, timedelta

from lendgrain.operators import bank
from lendgrain.streaming import statements

TXN = "applicant_id long, seq long, ts timestamp_ntz, date_str string, description string, debit double, " \
      "credit double, balance double, party string"


def transactions(n, seed):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(r.randrange(3), i, start + timedelta(minutes=r.randrange(60 * 24 * 40)), "", "", r.choice((0.0, 20_000.0, 5.0)),
             r.choice((0.0, 30_000.0)), r.choice((0.0, 10.0)), r.choice(("A", "B", None))) for i in range(n)]


def pairs(rows):
    found = set()
    for d in rows:
        for c in rows:
            if d[0] == c[0] and d[8] is not None and d[8] == c[8] and d[5] > 10_000 and c[6] > 10_000 and abs((d[2] - c[2]).days) <= 7:
                found.add((d[1], c[1], abs((d[2] - c[2]).days)))
    return found


def stream_of(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, TXN).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_round_trips_of_any_order_of_batches_after_a_restart(spark, tmp_path):
    rows = transactions(240, 1)
    where = [str(tmp_path / name) for name in ("in", "out", "state")]
    for part in (rows[:80], rows[80:160], rows[160:]):  # one run per batch: each goes on from the state before
        stream = stream_of(spark, where[0], [part])
        statements.write_round_trips(statements.round_trips(stream, delay="90 days"), where[1], where[2]).awaitTermination()
    got = [(r.debit_seq, r.credit_seq, r.days_gap) for r in spark.read.parquet(where[1]).collect()]
    assert set(got) == pairs(rows) and len(got) == len(set(got))


def test_rows_older_than_the_watermark_are_counted(spark, tmp_path):
    at = datetime(2024, 3, 1)
    new = [(1, i, at + timedelta(days=10 * i), "", "", 20_000.0, 0.0, 0.0, "A") for i in range(3)]
    late = [(1, 10, at - timedelta(days=200), "", "", 0.0, 30_000.0, 0.0, "A"), (1, 11, at + timedelta(days=20), "", "", 0.0, 30_000.0, 0.0, "A")]
    stream = stream_of(spark, str(tmp_path / "in"), [new])
    where = str(tmp_path / "out"), str(tmp_path / "state")
    statements.write_round_trips(statements.round_trips(stream, delay="1 day"), *where).awaitTermination()
    stream = stream_of(spark, str(tmp_path / "in"), [late])
    query = statements.write_round_trips(statements.round_trips(stream, delay="1 day"), *where)
    query.awaitTermination()
    assert [(r.debit_seq, r.credit_seq) for r in spark.read.parquet(where[0]).collect()] == [(2, 11)]
    assert statements.late_rows(query) == 1


def test_totals_equal_the_batch_and_count_a_repeated_batch_once(spark, tmp_path):
    rows = transactions(300, 2)
    stream = stream_of(spark, str(tmp_path / "in"), [rows[:100], rows[100:250], rows[250:]])
    statements.write_totals(statements.statement_totals(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out" / "batch=2"))
    last.write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=2"))
    got = statements.with_average(statements.latest_totals(spark, str(tmp_path / "out"), ["applicant_id"]))
    want = bank.statement_summary(spark.createDataFrame(rows, TXN))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_volumes_equal_the_batch(spark, tmp_path):
    rows = transactions(300, 3)
    stream = stream_of(spark, str(tmp_path / "in"), [rows[:10], rows[10:]])
    statements.write_totals(statements.counterparty_totals(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = bank.counterparty_volumes(spark.createDataFrame(rows, TXN)).drop("total_volume")
    got = statements.latest_totals(spark, str(tmp_path / "out"), ["applicant_id", "party"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
