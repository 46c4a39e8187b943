from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lendgrain.functions.cumulative import running_sum
from lendgrain.functions.party import with_party
from lendgrain.operators import bank
from lendgrain.sources import statements

TXN = "applicant_id long, seq long, ts timestamp_ntz, date_str string, description string, debit double, " \
      "credit double, balance double, party string"


def frame(spark, rows):
    return spark.createDataFrame(rows, TXN)


def test_typed_csv_with_camel_case_headers(spark, tmp_path):
    path = tmp_path / "7_typed.csv"
    path.write_text(
        "type,mode,amount,currentBalance,transactionTimestamp,txnId,narration\n"
        "CREDIT,UPI,2500.50,12500.50,10/03/2024 10:30:00,TXN1,UPI/P2P/FRIEND\n"
        "CREDIT,CARD,500.00,13000.50,11-03-2024 15:00:00,TXN2,COFFEE\n,,,,,,\n")
    rows = statements.read_statements(spark, str(path)).orderBy("seq").collect()
    assert len(rows) == 2 and sum(r.credit for r in rows) == 3000.50
    assert rows[0].ts == datetime(2024, 3, 10, 10, 30) and rows[0].txn_id == "TXN1" and rows[0].applicant_id == 7


def test_five_column_csv_round_trip(spark, tmp_path):
    rows = [(5, n, datetime(2024, 1, n + 1), "", f"NEFT Dr-1-I-P{n}--", 10.0 * n, 5.0, 1.0, None) for n in range(4)]
    statements.write_statements(frame(spark, rows), str(tmp_path / "out"))
    back = statements.parse_statements(
        spark.read.option("header", True).csv(str(tmp_path / "out")).withColumn("seq", F.col("seq").cast("long")))
    got = {r.seq: r for r in back.collect()}
    assert len(got) == 4 and got[2].debit == 20.0 and got[0].debit == 0.0 and got[3].ts == datetime(2024, 1, 4)


def test_typed_row_without_date_is_kept_and_marked(spark):
    raw = spark.createDataFrame([(1, 1, "Debit", "1,200", "??"), (1, 2, "", "5", "??")], [
        "applicant_id", "seq", "Type", "Amount", "Date"])
    rows = statements.parse_statements(raw).collect()
    assert [(r.seq, r.debit, r.ts, r.date_missing) for r in rows] == [(1, 1200.0, None, True)]


def test_statement_json(spark, tmp_path):
    path = tmp_path / "9.json"
    path.write_text(json.dumps({"opening_balance": 100.0, "transactions": [
        {"date": "2024-01-02", "description": "a", "debit": None, "credit": 5.0, "balance": 1.0, "failed": False}]}))
    row = statements.read_statement_json(spark, str(path)).first()
    assert (row.applicant_id, row.opening_balance, row.debit, row.credit) == (9, 100.0, 0.0, 5.0)


def test_party_layouts(spark):
    cases = {
        "UPI/DR/12/ACME LTD/x": "ACME LTD", "NEFT Cr-99-ICIC-CLOTHING INDUSTRIES LTD--": "CLOTHING INDUSTRIES LTD",
        "RTGS Dr-1-2-BIPLAB-/NONE": "BIPLAB", "NEFT/HDFC/NONE": None, "IMPS Dr-6-SHREYA": "SHREYA",
        "Chq Paid-MICR Inward-KAUSHIK-HDFC": "KAUSHIK", "CASH DEP SELF": None, "ATM WDL-1-2-3": None, "RENT": None,
        "By Clg:1, AB": None, "Dividend Cr-INFY-EQUITY": "INFY",
    }
    rows = with_party(spark.createDataFrame([(d,) for d in cases], ["description"])).collect()
    assert {r.description: r.party for r in rows} == cases


def hot_account(seed=1, n=400):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for seq in range(n):
        # Two thirds of all rows fall to one account and party; exact day multiples hit the edges.
        ts = start + (timedelta(days=rng.randrange(30)) if seq % 3 else timedelta(minutes=rng.randrange(40_000)))
        debit = rng.choice([0.0, 10_000.0, 25_000.0])
        rows.append((rng.choice([1, 1, 2]), seq, ts, str(ts), "", debit, 0.0 if debit else 30_000.0, 0.0,
                     rng.choice(["P", "P", "Q"])))
    return rows


def brute_pairs(rows):
    return [
        (d[0], d[8], d[1], c[1], abs((d[2] - c[2]).days))
        for d in rows for c in rows
        if d[0] == c[0] and d[8] == c[8] and d[5] > 10_000 and c[6] > 10_000 and abs((d[2] - c[2]).days) <= 7]


def test_round_trips_equal_brute_force(spark):
    rows = hot_account()
    txns, pairs = frame(spark, rows), brute_pairs(rows)
    counted = {(r.applicant_id, r.party): r.round_trips for r in bank.round_trip_counts(txns).collect()}
    expected = {}
    for a, p, *_ in pairs:
        expected[(a, p)] = expected.get((a, p), 0) + 1
    assert counted == expected
    first = {}
    for r in rows:
        if r[5] > 0:
            first.setdefault((r[0], r[8]), r[1])
    order = {a: sorted((first[(x, p)], d, c, g) for x, p, d, c, g in pairs if x == a)[:10] for a in (1, 2)}
    got = bank.round_trips(txns).orderBy("applicant_id", "rank").collect()
    assert {a: [r.days_gap for r in got if r.applicant_id == a] for a in (1, 2)} == {
        a: [g for *_, g in v] for a, v in order.items()}


def test_day_gap_is_floored_before_its_sign_drops(spark):
    at = datetime(2024, 1, 10, 12)
    rows = [
        (1, 0, at, "", "", 20_000.0, 0.0, 0.0, "P"), (1, 1, at + timedelta(hours=6), "", "", 0.0, 20_000.0, 0.0, "P"),
        (1, 2, at + timedelta(days=7), "", "", 0.0, 20_000.0, 0.0, "P"),
        (1, 3, at + timedelta(days=7, seconds=1), "", "", 0.0, 20_000.0, 0.0, "P"),
        (1, 4, at - timedelta(days=8) + timedelta(seconds=1), "", "", 0.0, 20_000.0, 0.0, "P"),
        (1, 5, at - timedelta(days=8), "", "", 0.0, 20_000.0, 0.0, "P")]
    got = bank.round_trips(frame(spark, rows)).orderBy("rank").collect()
    assert [r.days_gap for r in got] == [1, 7, 7]


def test_upper_median_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(n % 5, n, None, "", "", 0.0, round(rng.lognormvariate(9, 3), 2) if n % 4 else 0.0, 0.0, None)
            for n in range(300)]
    got = {r.applicant_id: r.median_credit for r in bank.spike_threshold(frame(spark, rows)).collect()}
    for a in range(5):
        credits = sorted(r[6] for r in rows if r[0] == a and r[6] > 0)
        assert got[a] == credits[len(credits) // 2]


def test_cash_spikes_look_backward_only(spark):
    rows = [(1, n, datetime(2024, 5, day), f"d{day}", "cash deposit", 0.0, 400_000.0 if day in (1, 2, 8, 12, 17, 21) else 1.0,
             0.0, None) for n, day in enumerate([1, 2, 8, 12, 17, 21] + [5] * 9)]
    got = {r.date_str: r.days_before_filing for r in bank.cash_spikes(frame(spark, rows)).collect()}
    assert got == {"d1": 0, "d8": 3, "d17": 3}


def test_running_sum_is_independent_of_chunks_and_partitions(spark):
    rows = spark.range(500).select(
        (F.col("id") % 2).alias("k"), (F.col("id") * 977 % 101).alias("at"), F.col("id").alias("seq"), F.col("id").alias("v"))
    runs = [
        sorted(map(tuple, running_sum(rows.repartition(n), ["k"], "at", ["seq"], "v", "s", chunk).collect()))
        for n, chunk in [(1, 10**9), (7, 10), (3, 1)]]
    assert runs[0] == runs[1] == runs[2]


def test_each_path_keeps_its_own_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "3_x.csv").write_text("Date,Description,Debit,Credit,Balance\n05-01-2024,one,7,,1\n")
    (tmp_path / "b" / "3_y.csv").write_text("Narration,Deposit,ValueDate\ntwo,9,2024-01-06\n")
    rows = statements.read_statements(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("seq").collect()
    assert [(r.applicant_id, r.description, r.debit, r.credit) for r in rows] == [(3, "one", 7.0, 0.0), (3, "two", 0.0, 9.0)]


def test_many_statement_paths_are_read_in_order(spark, tmp_path):
    paths = []
    for n in range(40):
        paths.append(f"{tmp_path}/{n % 3:05d}_bank{n:02d}.csv")
        with open(paths[-1], "w") as out:
            out.write(f"Date,Description,Debit,Credit,Balance\n01-01-2024,first {n},1,,5\n02-01-2024,second {n},,2,7\n")
    rows = statements.read_statements(spark, *paths).orderBy("seq").collect()
    assert [r.description for r in rows] == [f"{w} {n}" for n in range(40) for w in ("first", "second")]


def test_running_sum_spreads_rows_of_one_instant(spark):
    r = random.Random(8)
    rows = [(1, 5, n, float(r.randrange(-9, 9))) for n in range(4000)] + [(1, 3, n, 1.0) for n in range(5)]
    rows += [(k, r.randrange(20), n, float(r.randrange(9))) for k in (2, 3) for n in range(50)]
    frame_of = spark.createDataFrame(rows, "key long, at long, seq long, value double").repartition(3)
    want, total = {}, {}
    for key, at, seq, value in sorted(rows):
        total[key] = total.get(key, 0) + value
        want[key, at, seq] = total[key]
    for limit in (100, 10**6):
        got = running_sum(frame_of, ["key"], "at", ["seq"], "value", "sum", chunk_rows=limit)
        assert {(x.key, x.at, x.seq): x["sum"] for x in got.collect()} == want and got.columns == ["key", "at", "seq", "value", "sum"]
    hot = running_sum(frame_of, ["key"], "at", ["seq"], "value", "sum", chunk_rows=100)
    parts = hot.filter("key = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 3000


def test_many_credits_of_one_instant_count_once_each(spark):
    at = datetime(2024, 3, 10, 12)
    rows = [(1, n, at, "", "", 0.0, 20_000.0, 0.0, "P") for n in range(3000)]
    rows += [(1, 5000 + n, at + timedelta(days=n - 20), "", "", 30_000.0, 0.0, 0.0, "P") for n in range(40)]
    near = [n for n in range(40) if abs((timedelta(days=n - 20)).days) <= 7]
    counts = bank.round_trip_counts(frame(spark, rows)).collect()
    assert [(c.round_trips, c.matched_debits) for c in counts] == [(3000 * len(near), len(near))]
    trips = bank.round_trips(frame(spark, rows)).collect()
    assert [(t["rank"], t.days_gap) for t in sorted(trips, key=lambda t: t["rank"])] == [(k, 7) for k in range(1, 11)]


def test_whole_names_keep_parties_apart(spark):
    name = "A VERY LONG NAME OF A COMPANY THAT DOES NOT END SOON"
    rows = [(1, n, datetime(2024, 1, 1), "", f"UPI/DR/1/{name} {n}/x", 1.0, 0.0, 0.0) for n in range(2)]
    txns = spark.createDataFrame(rows, TXN.rpartition(",")[0])
    assert {r.party for r in with_party(txns).collect()} == {name[:40]}
    assert {r.party for r in with_party(txns, keep=None).collect()} == {f"{name} 0", f"{name} 1"}
