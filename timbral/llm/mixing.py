"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Every document is repeated Poisson(rate) times, rate being its source's target
share over its share of the corpus, so that each source's expected size meets
its target.  The Poisson variable is read from its distribution function at a
uniform number that a hash of (seed, doc_id) gives: the same document has the
same count in every run, on any number of machines, and no state is kept.  The
copies are then dealt into one global random order by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import shuffle_width

#: Up to so many sources their rates are broadcast (a distribution of some 60 to 120 numbers each); beyond, they are joined by a shuffle.
MOST_BROADCAST = 20_000
#: A mean is split into parts of this size at most, so that exp(-mean) can't vanish.
MEAN = 16.0


def uniform(seed: str, key: str, part: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 over the seed, the key's text and the part's number."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), part.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def distribution(mean: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as an array, up to the k after which it no longer grows in double precision."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["cdf"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """source, size (UTF-8 bytes), weight and rate: one map-side aggregation over all documents.

    weights: the target share of each source, in any unit; None gives all
    sources an equal share.  A source that weights does not name gets none.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    given = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    total = given.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.try_divide(F.col("weight") * F.col("all_size"), F.col("all_weight") * F.col("size"))
    return given.crossJoin(F.broadcast(total)).select("source", "size", "weight", F.coalesce(share, F.lit(0.0)).alias("rate"))


def poisson_count(seed: str, key: str = "doc_id") -> Column:
    """Copies of a row that has columns parts (how often the mean is split) and cdf: the sum of independent draws, one for each part."""
    draw = lambda i: F.size(F.filter(F.col("cdf"), lambda p: p <= uniform(seed, key, i)))
    draws = F.transform(F.sequence(F.lit(1), F.greatest("parts", F.lit(1))), draw)
    return F.when(F.col("parts") > 0, F.aggregate(draws, F.lit(0), lambda a, b: a + b)).otherwise(0)


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = "mix") -> DataFrame:
    """All columns of docs, once for each copy, with copy (1, 2, ...) and shuffle_key; rows come in the order of shuffle_key.

    docs: doc_id, text, source.  The size of a source is its UTF-8 bytes; a
    source without bytes, and a null text in it, gets no copies.  A null source
    is a source like any other.  A null doc_id draws as an empty one.  Rows that
    repeat a doc_id have the same count.  No documents give no rows.  Columns of
    docs called copy or shuffle_key are replaced.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights)
    parts = F.ceil(F.col("rate") / MEAN).cast("int")
    plans = rates.where("rate > 0").select(F.col("source").alias("_source"), parts.alias("parts"), distribution(F.col("rate") / parts).alias("cdf"))
    if rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        plans = F.broadcast(plans)
    held = F.struct(*docs.columns).alias("row")
    joined = docs.select(F.col("doc_id"), F.col("source"), held).join(plans, F.col("source").eqNullSafe(F.col("_source")))
    copies = joined.withColumn("n", poisson_count(seed)).where("n > 0").select("doc_id", "row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary")), 1, 16)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    mixed = copies.select(*kept, "copy", key.alias("shuffle_key"))
    # keys are uniform: their first digits tell the range, without a sample that would read everything twice
    width = shuffle_width(spark)
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * width / F.lit(float(1 << 32))).cast("int")
    return mixed.repartitionById(width, part).sortWithinPartitions("shuffle_key")
