"""Stored tables survive a death between write and switch and replayed batches; session bars come complete."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.streaming import bars as stream
from barloom.streaming.store import VersionedTable, newest, route_stream, unseen, upsert_stream

SCHEMA = "symbol string, datetime timestamp, close double"


def batch_of(spark, *rows):
    return spark.createDataFrame([(s, datetime(2025, m, d), c) for s, m, d, c in rows], SCHEMA)


def table(spark, root):
    return VersionedTable(spark, str(root), SCHEMA, F.date_format("datetime", "yyyy-MM"))


def rows_of(t):
    return sorted((r.symbol, r.datetime.month, r.datetime.day, r.close) for r in t.read().collect())


def test_upsert_once_and_only_touched_partitions(spark, tmp_path):
    t, merge = table(spark, tmp_path / "t"), newest(["symbol", "datetime"])
    assert rows_of(t) == [] and t.apply(batch_of(spark, ("A", 1, 5, 1.0), ("A", 2, 5, 2.0)), 0, "s", merge)
    january = t.pointer()["parts"]["2025-01"]
    assert t.apply(batch_of(spark, ("A", 2, 5, 3.0), ("B", 2, 6, 4.0)), 1, "s", merge)
    assert rows_of(t) == [("A", 1, 5, 1.0), ("A", 2, 5, 3.0), ("B", 2, 6, 4.0)] and t.pointer()["parts"]["2025-01"] == january
    assert not t.apply(batch_of(spark, ("A", 2, 5, 9.0)), 1, "s", merge) and not t.apply(batch_of(spark, ("A", 2, 5, 9.0)), 0, "s", merge)
    assert t.apply(batch_of(spark, ("A", 2, 5, 5.0)), 0, "another", merge) and ("A", 2, 5, 5.0) in rows_of(t)
    before = rows_of(t)
    assert t.apply(batch_of(spark), 2, "s", merge) and t.vacuum() > 0 and rows_of(t) == before


def test_death_between_write_and_switch(spark, tmp_path):
    """Files come one a batch; the second batch dies after its data is written, and once more after the switch."""
    batches = [batch_of(spark, ("A", 1, d, float(d)), ("B", 1 + d % 3, d, 0.5)) for d in range(1, 6)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    t, merge, died = table(spark, tmp_path / "t"), newest(["symbol", "datetime"]), []
    switch = t._switch

    def failing(pointer):
        if pointer["version"] == 2 and len(died) < 2:
            died.append(1)
            if len(died) == 2:
                switch(pointer)  # the batch is applied, but its query does not hear of it
            raise RuntimeError("killed")
        switch(pointer)

    t._switch = failing
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            upsert_stream(source(), t, merge, f"{tmp_path}/c")
        assert len(rows_of(t)) == 2 * len(t.pointer()["batches"]) * (t.pointer()["version"])
    upsert_stream(source(), t, merge, f"{tmp_path}/c")
    want = sorted((r.symbol, r.datetime.month, r.datetime.day, r.close) for b in batches for r in b.collect())
    assert rows_of(t) == want and len(died) == 2 and t.pointer()["version"] == 5
    upsert_stream(source(), t, merge, f"{tmp_path}/c")
    assert rows_of(t) == want and t.pointer()["version"] == 5


def test_append_unseen(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "log"), "event_id string, at string")
    log = lambda *r: spark.createDataFrame(list(r), "event_id string, at string")
    t.apply(log(("e1", "b"), ("e1", "a")), 0, "s", unseen(["event_id"]))
    t.apply(log(("e1", "c"), ("e2", "c")), 1, "s", unseen(["event_id"]))
    assert sorted(tuple(r) for r in t.read().collect()) == [("e1", "a"), ("e2", "c")]


def test_session_bars_of_a_stream(spark, tmp_path):
    """Ends belong to the bucket they close; a bucket without a tick in one half, or outside sessions, gives no bar."""
    day = datetime(2025, 1, 2)
    at = lambda h, m, s=0: day + timedelta(hours=h, minutes=m, seconds=s)
    ticks = [("X", at(9, 30), 1.0), ("X", at(9, 30, 1), 2.0), ("X", at(10, 0), 5.0), ("X", at(10, 0, 1), 3.0), ("X", at(10, 30), 4.0), ("X", at(10, 30, 1), 6.0), ("X", at(11, 0), 6.0), ("X", at(13, 10), 7.0), ("X", at(13, 50), 8.0), ("Y", at(14, 59), 1.0), ("Y", at(15, 0, 1), 1.0)]
    spark.createDataFrame([(*t, 1) for t in ticks], "symbol string, ts timestamp, price double, qty long").coalesce(1).write.parquet(f"{tmp_path}/ticks")
    source = spark.readStream.schema("symbol string, ts timestamp, price double, qty long").parquet(f"{tmp_path}/ticks")
    stream.run_once(stream.stream_sessions(source, 60, 30, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("X", "60m", at(10, 30), 2.0, 5.0, 2.0, 4.0, 4), ("X", "60m", at(14, 0), 7.0, 8.0, 7.0, 8.0, 2)]


def test_records_and_broken_lines(spark, tmp_path):
    """Records fall back to their defaults; a file with broken lines gives its whole ones, and the broken as text."""
    from barloom.sources import tables as src

    trades = spark.createDataFrame([("A", 10.0, None, None), ("B, the \"second\"", 9.5, "bull", "")], "ts_code string, entry_price double, regime string, strategy_name string")
    rows = src.trade_records(trades, "r1")
    assert rows.columns == src.TRADE_COLUMNS and len(rows.columns) == 15
    by_code = {r.ts_code[0]: r for r in rows.collect()}
    assert (by_code["A"].regime, by_code["A"].side, by_code["A"].shares, by_code["A"].entry_reason) == ("unknown", "LONG", 0, "") and by_code["B"].regime == "bull" and by_code["B"].strategy_name == "unknown"
    for fmt, broken in (("csv", "r1,Z,2025,2025,LONG,not a price,1.0,5,1,0.0,0.0,bull,s,a,b"), ("json", '{"run_id": "r1", "ts_code": ')):
        src.write_report(rows.coalesce(1), f"{tmp_path}/{fmt}", fmt)
        (tmp_path / fmt / f"part-broken.{fmt}").write_text((",".join(src.TRADE_COLUMNS) + "\n" if fmt == "csv" else "") + broken + "\n")
        back = src.read_table(spark, f"{tmp_path}/{fmt}", src.TRADES, fmt).cache()
        assert [r._corrupt for r in back.filter("_corrupt is not null").collect()] == [broken]
        whole = sorted(tuple(x or "" for x in r) for r in back.filter("_corrupt is null").drop("_corrupt").collect())
        assert whole == sorted(tuple(x or "" for x in r) for r in rows.collect())


def test_only_touched_partitions(spark, tmp_path):
    from barloom.sources import tables as src

    frame = lambda *r: spark.createDataFrame(list(r), "run string, month string, x int")
    path, by = f"{tmp_path}/report", ("run", "month")
    src.write_report(frame(("r1", "2025-01", 1), ("r1", "2025-02", 2)), path, by=by)
    kept = sorted(p.name for p in (tmp_path / "report/run=r1/month=2025-01").glob("*.parquet"))
    src.write_report(frame(("r1", "2025-02", 3), ("r2", "2025-01", 4)), path, by=by, only_touched=True)
    assert sorted((r.run, r.month, r.x) for r in spark.read.parquet(path).collect()) == [("r1", "2025-01", 1), ("r1", "2025-02", 3), ("r2", "2025-01", 4)]
    assert sorted(p.name for p in (tmp_path / "report/run=r1/month=2025-01").glob("*.parquet")) == kept


def test_stale_rows_go_aside(spark, tmp_path):
    """The stream dies between its two tables; the rerun fills the second and leaves the first as it is."""
    batch_of(spark, ("A", 1, 5, 1.0), ("A", 2, 5, 2.0), ("B", 2, 6, 3.0)).coalesce(1).write.parquet(f"{tmp_path}/in")
    current, stale = table(spark, tmp_path / "current"), table(spark, tmp_path / "stale")
    late, merge = F.col("datetime") < "2025-02-01", newest(["symbol", "datetime"])
    run = lambda: route_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), [(current, ~late, merge), (stale, late, merge)], f"{tmp_path}/c")
    switch, stale._switch = stale._switch, lambda pointer: 1 / 0
    with pytest.raises(Exception, match="division by zero"):
        run()
    assert len(rows_of(current)) == 2 and rows_of(stale) == []
    stale._switch = switch
    run()
    assert rows_of(current) == [("A", 2, 5, 2.0), ("B", 2, 6, 3.0)] and rows_of(stale) == [("A", 1, 5, 1.0)] and current.pointer()["version"] == 1
