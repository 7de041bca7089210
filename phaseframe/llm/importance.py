"""Target-distribution importance resampling (operator 11): hashed word and word-pair features, gains, Gumbel draws.

Every text becomes an array of bucket numbers by higher-order functions, written once. A first aggregation counts
buckets over all documents and all target texts; its partial sums are at most `buckets` rows a task. The gains
of all buckets, a constant of `buckets` numbers, then go into the plan as a literal array, and a document's weight
is aggregate(buckets, ... element_at(gains, bucket)): nothing is exploded or joined, and no row of a document
moves.

Drawing without replacement is by the largest score = weight + Gumbel noise from a hash of the id. Ranks are
counted by score: the number of documents with a greater score from a table of scores (integers in a narrow
range, summed up in two levels), then the place among those of the same score.

Defined results: a null or empty text has no features and weight 0; documents under `least_words` words, drawn or
not, have a weight and a score but never a rank; a null id counts as the empty text in the hash, and comes after
all others among equal scores; repeated rows are documents of their own and tie in any order; with no document or
no target text the formula holds as it stands (all counts 0). Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.llm.common import materialize, release

BUCKETS = 10_000

#: What stands between words: all ASCII characters but letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Scores whose counts are summed up together in the first of two levels.
_STEP = 256


def words(text: str) -> Column:
    """The words of a column of texts, lower-cased in A-Z only."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER), BETWEEN), lambda w: w != "")


def features(w: str, longest: int = 2) -> Column:
    """Runs of 1 to `longest` consecutive words of an array column, joined by one space."""
    runs, out = F.col(w), F.col(w)
    for k in range(1, longest):
        # one word longer than before: as many runs less one, each with the word that follows it
        longer = F.zip_with(F.slice(runs, F.lit(1), F.greatest(F.size(w) - k, F.lit(0))), F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        runs, out = longer, F.concat(out, longer)
    return out


def hashed(texts: DataFrame, text_col: str, keep: list[Column], longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """keep, n_words, and the bucket of each feature."""
    split = texts.select(*keep, words(text_col).alias("w"))
    return split.select(*(c for c in split.columns if c != "w"), F.size("w").alias("n_words"), F.transform(features("w", longest), lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int")).alias("buckets"))


def counts(rows: DataFrame) -> DataFrame:
    """bucket, count of features."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("count"))


def gains(spark, raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * ln(target share / raw share)) of each bucket, one more than counted in each; doubles throughout."""
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = counts(raw).select("bucket", F.col("count").alias("s"), F.lit(0).cast("long").alias("t")).union(counts(target).select("bucket", F.lit(0).cast("long"), "count"))
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = {r["bucket"]: (r["s"], r["t"]) for r in each.collect()}  # at most `buckets` rows
    total_s, total_t = (float(sum(x[k] for x in found.values())) for k in (0, 1))
    table = spark.createDataFrame([(b, float(s), float(t)) for b, (s, t) in found.items()], "bucket int, s double, t double")
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (F.lit(total_s) + buckets) / ((F.col("s") + 1) * (F.lit(total_t) + buckets))))
    filled = every.join(table, "bucket", "left").na.fill(0.0, ["s", "t"])
    return [r["gain"] for r in filled.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: int = 25) -> DataFrame:
    """scored(id, eligible, score, ...) with rank: 1, 2, 3... for the share (in %, rounded down) of eligible rows with the
    highest scores, ties to smaller ids; null for the others."""
    by_score = scored.where("eligible").groupBy("score").agg(F.count("*").alias("times")).withColumn("step", F.floor(F.col("score") / _STEP))
    steps = by_score.groupBy("step").agg(F.sum("times").alias("times"))
    # the steps are as many as the range of scores (logarithms) allows, whatever the rows
    over = steps.select("step", F.coalesce(F.sum("times").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above_step"), F.sum("times").over(Window.partitionBy()).alias("n"))
    within = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = by_score.withColumn("above", F.coalesce(F.sum("times").over(within), F.lit(0))).join(over, "step").select("score", (F.col("above") + F.col("above_step")).alias("above"), F.floor(F.col("n") * share / 100).alias("draws"))
    place = F.row_number().over(Window.partitionBy("score", "eligible").orderBy(F.col("id").asc_nulls_last()))
    placed = scored.withColumn("place", place).join(above, "score", "left")
    rank = F.col("above") + F.col("place")
    return placed.withColumn("rank", F.when(F.col("eligible") & (rank <= F.col("draws")), rank)).drop("place", "above", "draws")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    spark = docs.sparkSession
    rows = materialize(hashed(docs, text_col, [F.col(id_col).alias("id")], longest, buckets))
    found = gains(spark, rows, hashed(target, target_col, [], longest, buckets), buckets)
    literal = F.expr("array(" + ", ".join(f"{g}L" for g in found) + ")")
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.element_at(literal, b + 1))
    weight = F.when(n == 0, 0).otherwise(F.floor(total / n)).cast("long")
    weighed = rows.select("id", n.alias("n_features"), (F.col("n_words") >= least_words).alias("eligible"), weight.alias("weight"))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise("id", seed)))
    release(rows)
    return ranked(scored, share).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def selected(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The drawn documents with their own columns. Ids must tell documents apart; null ids are never drawn here."""
    drawn = resample(docs, target, id_col=id_col, **parameters).where("rank is not null and doc_id is not null")
    return docs.join(drawn.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(*docs.columns)
