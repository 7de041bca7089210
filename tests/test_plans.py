"""Plans that must not depend on what a file's size says about what is made of it."""

from pyspark.sql import functions as F

from phaseframe.sources import files as S


def lines(spark, n=200):
    rows = [(k, "\t".join([f"r{k}", "0", "c", str(k * 200 + 1), "60", "10M", "*", "0", "0", "ACGTACGTAC", "ABCDEFGHIJ"])) for k in range(n)]
    return spark.createDataFrame(rows, "line_no long, value string")


def test_aligned_bases_are_not_broadcast(spark):
    sites = spark.createDataFrame([("c", 1, 1001, ["A", "C"])], "contig string, site int, pos long, alleles array<string>")
    calls = S.allele_calls(S.parse_sam(lines(spark)), sites)
    assert [tuple(r) for r in calls.select("qname", "allele", "read_pos").collect()] == [("r5", 1, 1)]
    assert "Broadcast" not in calls._jdf.queryExecution().executedPlan().toString()


def test_alignments_are_dealt_before_they_are_laid_out(spark):
    one = S.parse_sam(lines(spark).coalesce(1))
    bases = S.aligned_bases(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(bases) > 1 and sum(r["count"] for r in bases) == 2000


def sizes(frame):
    """Rows of each partition that has any."""
    return [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]


def test_read_distances_lie_in_partitions_of_few_rows(spark, monkeypatch):
    """Whatever the number of partitions of shuffles, what a task sorts and sums up does not grow with the reads."""
    from phaseframe.operators.distances import read_haplotype_distance
    from phaseframe.operators.pileup import pileup
    from phaseframe.plans import storage

    monkeypatch.setattr(storage, "MOST", 100, raising=False)
    obs = spark.range(2000).selectExpr("cast(id div 1000 AS int) AS contig", "id div 4 AS frag_id", "cast(id % 4 + (id div 400) * 4 AS int) AS site", "cast(id % 2 AS int) AS allele", "1.0D AS weight", "cast(id div 4 % 2 AS int) AS part")
    found = read_haplotype_distance(obs.drop("part"), pileup(obs, "contig", "part"), ["contig"], "part")
    assert found.count() == 1000 and {(r["same"], r["diff"]) for r in found.collect()} == {(4, 0)}
    assert len(sizes(found)) > 10 and max(sizes(found)) < 200


def test_reads_with_and_without_sites_are_dealt_by_their_number(spark, monkeypatch):
    from phaseframe.operators.filters import split_by_sites
    from phaseframe.plans import storage

    monkeypatch.setattr(storage, "MOST", 100, raising=False)
    names = spark.range(1000).withColumnRenamed("id", "k")
    having, without = split_by_sites(names, names.where("k % 4 = 0").union(names.where("k % 8 = 0")).hint("merge"), "k")
    assert having.count() == 250 and without.count() == 750 and without.where("k % 4 = 0").isEmpty()
    assert len(sizes(without)) > 8 and max(sizes(without)) < 150


def test_observations_of_lines_are_dealt_by_their_number(spark, monkeypatch):
    from phaseframe.plans import storage
    from phaseframe.sources import bindings

    monkeypatch.setattr(storage, "MOST", 500, raising=False)
    obs = bindings.obs_from_lineitem(spark, "/root/testdata/sf0.001")
    assert len(sizes(obs)) > 8 and max(sizes(obs)) < 1000


def test_paths_come_from_observations_made_once(spark, monkeypatch):
    from phaseframe import queries

    made = []
    real = queries.B.obs_from_events
    monkeypatch.setattr(queries.B, "obs_from_events", lambda *args: made.append(args) or real(*args))
    for name in ("disjoint_paths", "path_flow"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert len(made) == 1, name
        made.clear()
    edges = queries.block_edges(spark, "/root/testdata/sf0.001")
    assert not any("events.parquet" in file for file in edges.inputFiles())


def test_cigars_of_columns_are_read_once(spark):
    """A span's end is worked out once a read, and bases at columns come from one pass over a CIGAR."""
    from phaseframe.operators import columns as CO

    rows = S.parse_sam(lines(spark))
    plan = CO.primary_spans(rows).select("contig", "pos", "end")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    found = CO.column_bases(CO.primary_spans(rows), spark.createDataFrame([("c", 1003)], "contig string, ref_pos long"))
    assert [tuple(r) for r in found.collect()] == [("c", 1003, "T", 10)]
    assert "concat" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_places_in_reads_by_brute_force(spark):
    from phaseframe.sources.files import read_places

    cigars = ["4H3S10M5D20M2I5M", "10M1000N10M", "3=1X2P2I4M6S", "5S", "0M3M"]
    for cigar in cigars:
        expected, ref, read = {}, 0, 0
        for n, op in __import__("re").findall("([0-9]+)([MIDNSHP=X])", cigar):
            for _ in range(int(n)):
                if op in "M=X":
                    expected[ref] = read
                ref, read = ref + (op in "MDN=X"), read + (op in "MIS=X")
        rows = spark.range(-2, ref + 2).select("id", F.lit(cigar).alias("cigar")).select("id", read_places("cigar", F.col("id")).alias("p")).collect()
        assert {r["id"]: r["p"][0] for r in rows if r["p"]} == expected


def test_made_reads_are_not_made_for_each_test_of_them(spark):
    from phaseframe import queries
    from phaseframe.operators import columns as CO

    spans = CO.primary_spans(queries._deep(spark, "/root/testdata/sf0.001"))
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("overlay") < 10
