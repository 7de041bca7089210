"""Streams give what one aggregation over all rows gives."""

import datetime

from pyspark.sql import functions as F

from phaseframe.operators.pileup import pileup
from phaseframe.streaming.pileup import running_pileup, windowed_pileup

SCHEMA = "contig string, site int, allele int, weight double, at timestamp"


def test_streamed_pileups(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("c" + str(k % 2), k % 5, k % 3, 0.5, start + datetime.timedelta(minutes=k)) for k in range(120)]
    late = ("c0", 0, 0, 0.5, start)
    folder = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30] + [late] * (k == 3), SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run(make, mode, name):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return spark.table(name)

    whole = spark.read.schema(SCHEMA).parquet(folder)
    key = lambda frame: sorted((r["contig"], r["site"], r["allele"], r["n"], round(r["weight"], 6)) for r in frame.collect())
    assert key(run(lambda x: running_pileup(x, "contig"), "complete", "running")) == key(pileup(whole, "contig"))
    # a row that comes after its window has been closed is left out; windows that the watermark hasn't passed wait
    found = run(lambda x: windowed_pileup(x, "at", "20 minutes", "10 minutes", "contig"), "append", "windowed")
    closed = whole.where(F.col("at") < F.lit(start + datetime.timedelta(minutes=100)))
    total = found.agg(F.sum("n")).first()[0]
    assert total == closed.count() - 1 and found.where("n < 1").count() == 0


def test_additions_and_removals(spark, tmp_path):
    """After any batches, the last state of each allele is the pileup of what is left; what has gone is reported once, with 0."""
    import random

    from phaseframe.streaming.pileup import changing_pileup

    rng = random.Random(4)
    schema = "contig string, site int, allele int, weight double, added boolean"
    live, batches = [], []
    for k in range(6):
        batch = []
        for _ in range(60):
            if live and rng.random() < (0.8 if k > 3 else 0.3):
                batch.append((*live.pop(rng.randrange(len(live))), False))
            else:
                own = (rng.choice("ab"), rng.randrange(6), rng.randrange(3), round(0.5 + rng.random() / 2, 3))
                live.append(own)
                batch.append((*own, True))
        batches.append(batch)
    batches[-1] += [("z", 1, 0, 0.7, True), ("z", 1, 0, 0.7, False), ("never", 1, 1, 0.5, False)]
    folder = str(tmp_path / "in")
    seen: dict = {}
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)

        def note(frame, _):
            for r in frame.collect():
                seen[r["contig"], r["site"], r["allele"]] = (round(r["weight"], 6), r["n"])

        stream = changing_pileup(spark.readStream.schema(schema).parquet(folder), "contig")
        query = stream.writeStream.foreachBatch(note).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    expected: dict = {}
    for contig, site, allele, weight in live:
        w, n = expected.get((contig, site, allele), (0, 0))
        expected[contig, site, allele] = (w + weight, n + 1)
    assert {k: v for k, v in seen.items() if v[1]} == {k: (round(w, 6), n) for k, (w, n) in expected.items()}
    assert seen["z", 1, 0] == (0.0, 0) and not any(k[0] == "never" for k in seen) and any(v == (0.0, 0) for k, v in seen.items() if k[0] != "z")
