import time

from pyspark.sql import functions as F

from vialens.operators import processor
from vialens.operators.processor import STATE
from vialens.plans import fixture, matching
from vialens.streaming import live
from vialens.streaming.keyed import KeyedTable

SF = "/root/testdata/sf0.001"
COLUMNS = ["vehicle", "vendor", "t", "seen_at", "lat", "lon", "service", "heading", "dir"]


def run(stream, sink, mode, tmp_path):
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    rows = matching.reports(spark, SF).where("vehicle in ('V000', 'V005', 'V034')").select(*COLUMNS)
    cut = rows.agg(F.expr("percentile_disc(0.5) within group (order by seen_at)")).first()[0]
    for k, part in enumerate((rows.where(F.col("seen_at") <= cut), rows.where(F.col("seen_at") > cut))):
        part.coalesce(1).write.parquet(str(tmp_path / f"all/{k}"))
        time.sleep(1.1)
    net, fleet = matching.fleet_network(spark), KeyedTable(spark, f"file://{tmp_path}/fleet", ["vehicle"], STATE)
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    run(live.track(stream, net), lambda df, k: fleet.merge(df, k), "update", tmp_path)
    want = {r["vehicle"]: r for r in processor.replay(rows, net, "states").collect()}
    states = {r["vehicle"]: r for r in fleet.read().collect()}
    assert set(states) == set(want)
    for v, r in want.items():
        assert (states[v]["t"], states[v]["accepted"], states[v]["shape_id"]) == (r["t"], r["accepted"], r["shape_id"])


def test_stream_drops_repeats(spark, tmp_path):
    fx = fixture.repeated_fixes(fixture.fixes(spark, SF)).select("vehicle", "vendor", "t", "seen_at")
    fx.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    run(live.deduplicated(spark.readStream.schema(fx.schema).parquet(str(tmp_path / "in"))), lambda df, _: seen.append(df.count()), "append", tmp_path)
    assert sum(seen) == fx.select("vehicle", "vendor", "t").distinct().count()
