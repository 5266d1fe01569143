"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

A source with ``n`` rows and the share ``w`` of ``total`` rows gets the mean
repetition rate ``total * w / n``.  Every document draws its number of copies
from the Poisson distribution of that mean: a number in [0, 1) that a hash of
seed and id gives is inverted through the cumulative distribution.  The draw is
repeatable and needs no other row.  Copies are then dealt out and sorted by a
hash of their own, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.common import cut, fresh, table

#: A larger mean is drawn as the sum of this many times smaller ones, which is the same distribution.
LARGEST_MEAN = 64.0
#: Sources whose rates may be broadcast; with more, the join is by shuffle.
BROADCAST_SOURCES = 10_000
DIGITS = 15  # hexadecimal digits of a hash that become one number


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    digest = F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, DIGITS)
    return F.conv(digest, 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson distribution, until nothing is left of a double."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    grow = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.array_append(acc["sums"], F.element_at(acc["sums"], -1) + acc["p"] * mean / k).alias("sums"))
    return F.aggregate(steps, start, grow)["sums"]


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, by: str = "source") -> DataFrame:
    """``source, n, rate`` for every source of the documents.

    Without weights every source that occurs has the same share.  A source
    without a weight has rate zero.  Null is a source like any other.
    """
    counts = docs.groupBy(F.col(by).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.lit(1.0) / F.col("sources")
    else:
        all_of = float(sum(weights.values()))
        if not weights or min(weights.values()) < 0 or all_of <= 0:
            raise ValueError("weights must not be negative, and some must be positive")
        share = F.lit(0.0)
        for source, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(w / all_of)).otherwise(share)
    sums = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("sources"))  # one row
    wanted = F.col("rows") if total is None else F.lit(total)
    return counts.join(F.broadcast(sums)).select("source", "n", (wanted * share / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 7, by: str = "source") -> DataFrame:
    """All columns of the documents, each row as often as its draw says, in a globally random order.

    Two columns are added, under names that do not clash: ``copy`` counts a
    document's copies from 1, ``shuffle_key`` is what the order follows.  Rows
    that share an id draw the same number; a null id draws as the text "null".
    A document may draw zero copies; that is the method.  No rows give no rows,
    and a very long text is only carried along.
    """
    rate, parts, sums, copies, copy, key, source, number = fresh(docs, "rate", "parts", "sums", "copies", "copy", "shuffle_key", "rate_source", "rate_n")
    found = rates(docs, weights, total, by).where("rate > 0").toDF(source, number, rate)
    found = found.withColumn(parts, F.greatest(F.lit(1), F.ceil(F.col(rate) / LARGEST_MEAN)).cast("int"))
    found = cut(found.select(source, parts, cumulative(F.col(rate) / F.col(parts)).alias(sums)))
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    # each draw is made once, then found among the sums
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(F.lit(seed), F.col("doc_id"), j))
    one = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(sums), lambda p: p <= u)))
    drawn = docs.join(found, docs[by].eqNullSafe(F.col(source))).withColumn(copies, one).where(F.col(copies) > 0)
    each = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(rate, parts, sums, copies, source)
    each = each.withColumn(key, F.xxhash64(F.lit(seed), "doc_id", copy))
    return each.repartition(F.col(key)).sortWithinPartitions(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", F.col("copy").cast("int").alias("copy"))


ORACLE_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, (SELECT sum(n) FROM counts) * (1.0::DOUBLE / (SELECT count(*) FROM counts)) / n AS rate FROM counts
), parted AS (
  SELECT source, greatest(1, ceil(rate / 64.0::DOUBLE))::INT AS parts, rate / greatest(1, ceil(rate / 64.0::DOUBLE))::INT AS mean FROM rates
), steps AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps
  WHERE k < ceil(mean + 12 * sqrt(mean) + 30)
), sums AS (
  SELECT source, list(c ORDER BY k) AS c FROM steps GROUP BY source
), draws AS (
  SELECT d.*, s.c, ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(j AS VARCHAR)), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
  FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source
  JOIN sums s ON d.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j)
), drawn AS (
  SELECT doc_id, source, lang, n_chars, text, sum(len(list_filter(c, lambda x: x <= u))) AS copies
  FROM draws GROUP BY ALL
)
SELECT doc_id, source, lang, n_chars, text, CAST(unnest(range(1, copies::BIGINT + 1)) AS INT) AS copy FROM drawn
"""
