"""JSON invoice files, forecast files and the streaming daily refresh."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidecast.operators import daily
from tidecast.sources import forecasts, invoices, json_array
from tidecast.streaming.daily_refresh import invoice_stream, start_daily_refresh


def test_read_invoice_json_array(spark):
    d = tempfile.mkdtemp(prefix="tidecast-json-")
    recs = [
        {"invoice_number": "1", "invoice_date": "2024-01-02", "customer_no": "C1", "account_number": "A1", "customer_name": "Ann", "amount": "12.5", "invoice_type": "IN", "source": "s"},
        {"invoice_number": "2", "invoice_date": "2024-01-02", "customer_no": "C2", "account_number": "A2", "customer_name": "Bo", "amount": "x", "invoice_type": "IN", "source": "s"},
        {"invoice_number": "3", "invoice_date": "2024-01-03", "customer_no": "C1", "account_number": "A1", "customer_name": "Ann", "amount": "5", "invoice_type": "CM", "source": "s"},
    ]
    with open(f"{d}/inv.json", "w") as fh:
        json.dump(recs, fh)
    inv = invoices.filter_invoices(invoices.clean(invoices.read_invoices(spark, f"{d}/inv.json")))
    got = daily.daily_sales(inv).collect()
    assert len(got) == 1 and got[0].sales == 12.5 and got[0].invoice_count == 2 and got[0].customer_count == 2


def _awkward_records(rng, n):
    pieces = ['"', "\\", "}", "{", "[", "]", ",", ":", "é", "\n", "a", "\\\\", '{"', '"}', "漢"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        out.append({"invoice_number": str(i), "customer_name": text, "amount": rng.choice([1, 2.5, None, "x"]), "extra": {"deep": {"k}": [text, {}]}}})
    return out


def test_json_array_by_byte_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(21)
    want = []
    for f, (n, ascii_) in enumerate([(120, True), (80, False), (1, True), (0, True)]):
        recs = _awkward_records(rng, n)
        want += [json.dumps(r, sort_keys=True) for r in recs]
        with open(tmp_path / f"f{f}.json", "w", encoding="utf-8") as fh:
            json.dump(recs, fh, ensure_ascii=ascii_, indent=f or None)
    (tmp_path / "empty.json").write_text("")
    want.sort()
    # Range and chunk borders at every kind of byte, escapes included.
    for range_bytes in (997, 4099, 1 << 20):
        records = json_array.array_records(spark, str(tmp_path), range_bytes)
        got = [json.dumps(json.loads(r.record), sort_keys=True) for r in records.collect()]
        assert sorted(got) == want, range_bytes
    file = str(tmp_path / "f0.json")
    whole = open(file, "rb").read()
    monkeypatch.setattr(json_array, "CHUNK_BYTES", 7)
    for step in (1, 2, 3, 5, 61):
        inside, depth, got = 0, 0, []
        for start in range(0, 3000, step):
            end = min(start + step, 3000)
            with open(file, "rb") as fh:
                got += list(json_array._range_records(fh, start, end, inside, depth))
                change = [0, 0]
                quotes = 0
                for _, body in json_array._chunks(fh, start, end):
                    _, sign, within, quotes = json_array._braces(body, quotes)
                    for side in (0, 1):
                        change[side] += int(sign[within == side].sum())
            depth += change[inside]
            inside = (inside + quotes) % 2
        texts = [json.loads(g) for g in got]
        assert texts == json.loads(whole)[: len(texts)] and whole.find(b'"invoice_number": "%d"' % len(texts)) >= 3000


def test_one_large_array_file_is_many_tasks(spark, tmp_path):
    recs = [{"invoice_number": str(i), "invoice_date": "2024-01-02", "customer_no": f"C{i % 7}", "amount": i, "invoice_type": "IN", "series_key": "ALL"} for i in range(20_000)]
    (tmp_path / "all.json").write_text(json.dumps(recs))
    inv = invoices.read_invoices(spark, str(tmp_path), series_col="series_key", range_bytes=100_000)
    per_task = [r["count"] for r in inv.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 20_000 and len(per_task) >= 20 and max(per_task) < 2_000
    plain = spark.read.schema(inv.schema).option("multiLine", "true").json(str(tmp_path))
    assert inv.exceptAll(plain).isEmpty() and plain.exceptAll(inv).isEmpty()


def test_json_array_defined_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text('\ufeff[1, "x{", null, {"invoice_number": "1"}, [{"invoice_number": "2"}], {"invoice_number": "3", "amount": "4')
    rows = invoices.read_invoices(spark, str(tmp_path / "a.json")).select("invoice_number", "amount", "series_key").collect()
    assert len(rows) == 3 and sorted(r.invoice_number for r in rows if r.invoice_number)[:2] == ["1", "2"]
    (tmp_path / "b.json").write_text("[]")
    assert invoices.read_invoices(spark, str(tmp_path / "b.json")).count() == 0
    (tmp_path / "c.json.gz").write_bytes(b"x")
    with pytest.raises(ValueError, match="compressed"):
        invoices.read_invoices(spark, str(tmp_path / "c.json.gz"))
    json_array.write_arrays(spark.range(5).selectExpr("to_json(struct(id))").repartition(3), str(tmp_path / "out"))
    assert json_array.array_records(spark, str(tmp_path / "out")).count() == 5


def test_forecast_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tidecast-fc-")
    fc = spark.createDataFrame([("ALL", "m1", "2024-01-01", 1.0, 0.5, 1.5), ("ALL", "m2", "2024-01-01", 2.0, None, None)],
                               "series_key string, model string, date string, yhat double, lower double, upper double").withColumn("date", F.to_date("date"))
    forecasts.write_table(fc, f"{d}/pq")
    forecasts.write_table(fc, f"{d}/csv", fmt="csv")
    a = forecasts.load_forecasts(spark, f"{d}/pq", models=["m2"]).collect()
    b = forecasts.load_forecasts(spark, f"{d}/csv", fmt="csv").collect()
    assert len(a) == 1 and a[0].yhat == 2.0
    assert len(b) == 2


def test_streaming_daily_refresh_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="tidecast-stream-")
    src_dir, store, out, ck = f"{base}/in", f"{base}/store", f"{base}/daily", f"{base}/ck"
    recs = [
        {"invoice_number": str(i), "invoice_date": f"2024-01-0{1 + i % 3}", "customer_no": f"C{i % 4}", "customer_name": "n",
         "amount": "10.00", "invoice_type": "IN", "source": "s", "account_number": "a", "series_key": "ALL"}
        for i in range(12)
    ]
    import os

    os.makedirs(src_dir)
    for part in range(3):
        with open(f"{src_dir}/p{part}.json", "w") as fh:
            for r in recs[part * 4 : part * 4 + 4]:
                fh.write(json.dumps(r) + "\n")
    q = start_daily_refresh(invoice_stream(spark, src_dir), store, out, ck, trigger_once=True)
    q.awaitTermination(120)
    got = {r.date: (r.sales, r.invoice_count, r.customer_count) for r in spark.read.parquet(out).collect()}
    assert got and all(v == (40.0, 4, 4) for v in got.values())
