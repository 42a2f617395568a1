import datetime as dt

from pyspark.sql import functions as F
from test_market import DAY, frame

from barloom.operators import cleaning as C
from barloom.operators import stats as T
from barloom.operators import tracking as R
from barloom.streaming import jobs as J

BAR = "symbol string, ts timestamp, close double, volume double"


def run(spark, tmp_path, name, job, *frames):
    """Write each frame's parts as files, stream them through the job, and read all that it has sent out so far (a further call goes on from the checkpoint)."""
    streams = []
    for k, f in enumerate(frames):
        at = str(tmp_path / f"{name}{k}")
        for part in f:
            part.coalesce(1).write.mode("append").parquet(at)
        streams.append(spark.readStream.schema(f[0].schema).option("maxFilesPerTrigger", 1).parquet(at))
    out = str(tmp_path / f"o{name}")
    q = job(*streams).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(out)


def ends(spark):
    return spark.createDataFrame([("END", DAY + dt.timedelta(days=400), 1.0, 1.0)], BAR)


def parts(df):
    cut = DAY + dt.timedelta(days=12)
    df = df.select("symbol", "ts", "close", "volume")
    return [df.where(df.ts < cut), df.where(df.ts >= cut), ends(df.sparkSession)]


def shuffled(df, late_days=3):
    """Three files; bars are out of order in each, and some come a file late."""
    df = df.select("symbol", "ts", "close", "volume").withColumn("d", F.datediff("ts", F.lit(DAY)))
    file = F.floor((F.col("d") + F.when(F.col("d") % 5 == 4, late_days).otherwise(0)) / 14)
    df = df.withColumn("f", file).orderBy(F.hash("ts"))
    return [df.where(df.f == k).drop("d", "f") for k in range(4)] + [ends(df.sparkSession)]


def test_bad_prints_as_in_batch_when_bars_come_out_of_order(spark, tmp_path):
    b = frame(spark, [100.0 + i + (i * i % 7) for i in range(40)] + [200.0, 141.0], [1000.0] * 42)
    got = run(spark, tmp_path, "prints", lambda s: J.stream_bad_prints(s, delay="8 days"), shuffled(b)).where("symbol <> 'END'")
    want = C.flag_bad_prints(b)
    assert sorted(map(tuple, got.select("ts", "rejected").collect())) == sorted(map(tuple, want.select("ts", "rejected").collect()))
    assert want.where("rejected").count() > 0


def test_reconcile_as_in_batch(spark, tmp_path):
    p, b = frame(spark, [100.0 + i for i in range(20)]), frame(spark, [100.0 + i * 1.001 for i in range(15)])
    got = run(spark, tmp_path, "reconciled", J.stream_reconcile, parts(p), parts(b)).where("symbol <> 'END'")
    want = C.reconcile_streams(p, b)
    assert sorted(map(tuple, got.select("ts", "close", "anomaly").collect())) == sorted(map(tuple, want.select("ts", "close", "anomaly").collect()))


def test_dedupe_and_windows(spark, tmp_path):
    q = frame(spark, [1.0, 3.0, 2.0])
    twice = q.unionByName(q)
    got = run(spark, tmp_path, "once", J.stream_quotes_dedupe, parts(twice)).where("symbol <> 'END'")
    assert got.count() == 3
    bars = run(spark, tmp_path, "windows", lambda s: J.stream_quote_bars(s, "7 days"), parts(q)).where("symbol <> 'END'")
    assert bars.agg({"volume": "sum"}).first()[0] == 300_000.0 and bars.agg({"high": "max"}).first()[0] == 3.0


def test_kalman_goes_on_after_a_restart(spark, tmp_path):
    b = frame(spark, [100.0 + (i * 37 % 11) for i in range(40)], [1.0 + i % 3 for i in range(40)])
    files = shuffled(b)
    job = lambda s: J.stream_kalman(s, delay="8 days")
    first = run(spark, tmp_path, "tracked", job, files[:2]).count()  # the source's folder, the sink and the checkpoint stay
    got = {r.ts: r for r in run(spark, tmp_path, "tracked", job, files[2:]).where("symbol <> 'END'").collect()}
    want = T.kalman_track(b).collect()
    assert 0 < first < 40 and len(got) == len(want) == 40
    assert all(abs(got[w.ts].filtered - w.filtered) < 1e-9 and abs(got[w.ts].noise - w.noise) < 1e-12 for w in want)


def test_resolve_as_in_batch(spark, tmp_path):
    b = frame(spark, [100.0 + i for i in range(20)]).where("day(ts) <> 24 and day(ts) <> 25")
    day = lambda i: DAY + dt.timedelta(days=i)
    rows = [("a", "A", day(1), day(5), 100.0, 0.1, 90.0, 120.0), ("b", "A", day(2), day(10), 100.0, 0.1, 90.0, 105.0), ("c", "A", day(3), day(100), 100.0, 0.1, 90.0, 120.0)]
    p = spark.createDataFrame(rows, J.PENDING)
    end = spark.createDataFrame([("END", "END", day(400), day(500), 1.0, 0.0, 0.0, 1.0)], J.PENDING)
    bars = [*parts(b)[:2], parts(b)[0].where("day(ts) = 20").limit(0), ends(spark)]
    got = run(spark, tmp_path, "resolved", J.stream_resolve, [p, p.limit(0), end], bars).where("symbol <> 'END'")
    want = R.resolve_outcomes(p.withColumn("status", F.lit("PENDING")), b, F.lit(day(400)).cast("timestamp"))
    assert sorted((x.id, x.status, x.actual_price or 0) for x in got.collect()) == sorted((x.id, x.status, x.actual_price or 0) for x in want.collect())
