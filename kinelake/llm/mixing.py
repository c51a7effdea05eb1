"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source that should fill a third of the total but holds a tenth of it has a repetition rate of 3.3: each of
its documents is drawn a Poisson number of times with that mean. The uniform number that is inverted comes
from a hash of seed and id, so a rerun draws the same copies wherever the rows lie. Copies are then dealt
over the cluster by a hash and sorted by it, which shuffles the whole uniformly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.frames import settled, unused

#: Hexadecimal digits of a hash that become a number: 52 bits, exact in double precision.
DIGITS = 13

#: Up to this many sources (about a kilobyte each), their rates are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000

#: Larger rates are drawn as a sum of equal parts of at most this rate, each inverted by itself.
PART_RATE = 64.0


def hashed(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("long")


def held_by_source(documents: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, held): code points of each source; null texts hold nothing."""
    size = F.sum(F.coalesce(F.char_length(text), F.lit(0)))
    return documents.groupBy(F.col(source).alias("source")).agg(size.cast("double").alias("held"))


def tempered_weights(held: DataFrame, power: float = 0.5) -> DataFrame:
    """(source, weight): target weights proportional to ``held ** power``. 1 keeps the shares, 0 makes them equal."""
    return held.where("held > 0").select("source", F.pow("held", F.lit(power)).alias("weight"))


def repetition_rates(held: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """(source, rate): mean copies of a document, such that sources reach their share of ``total`` code points
    (by default what there is now). A source without weight or text has rate 0."""
    w = weights.select(F.col("source").alias("named"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    both = held.join(w, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sums = both.agg(F.sum("held").alias("all_held"), F.sum("weight").alias("all_weight"))  # one row
    want = F.col("all_held") if total is None else F.lit(float(total))
    rate = F.when((F.col("held") > 0) & (F.col("all_weight") > 0), want * F.col("weight") / F.col("all_weight") / F.col("held"))
    return both.join(F.broadcast(sums)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _steps(rate: Column) -> Column:
    """(parts, cdf): how many equal parts the rate is drawn in, and the distribution function of one part.

    The function is listed until it exceeds every 52-bit number below 1, by a margin of many deviations.
    """
    parts = F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")
    own = rate / parts
    first = F.struct(F.exp(-own).alias("p"), F.array(F.exp(-own)).alias("cdf"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * own / k
        return F.struct(p.alias("p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + p).alias("cdf"))

    last = (own + 9.0 * F.sqrt(own) + 24.0).cast("int")
    return F.struct(parts.alias("parts"), F.aggregate(F.sequence(F.lit(1), last), first, add, lambda s: s["cdf"]).alias("cdf"))


def replicate(documents: DataFrame, weights: DataFrame | None = None, seed: int = 7, total: float | None = None, power: float = 0.5, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each document as often as its Poisson draw says, in a uniformly shuffled order.

    Adds ``rate``, ``copy`` (1, 2, ..) and ``order_key`` (rows are dealt and sorted by it); columns of those
    names are replaced, others stay. ``weights`` is (source, weight) in any unit, by default
    ``tempered_weights``. A null source is a source; a source missing from ``weights`` has rate 0; null and
    empty texts are drawn like others of their source but hold nothing; rows of equal id are drawn alike; an
    empty table gives an empty result.
    """
    base = documents.drop("rate", "copy", "order_key")
    held = held_by_source(documents, source, text)
    rates = repetition_rates(held, tempered_weights(held, power) if weights is None else weights, total)
    named, steps, count = unused(base, "named", "steps", "count")
    rates = settled(rates.select(F.col("source").alias(named), "rate", _steps(F.col("rate")).alias(steps)), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))

    def part(total_: Column, i: Column) -> Column:
        u = hashed(F.lit(seed), own, i) / F.lit(float(16**DIGITS))
        return total_ + F.size(F.filter(F.col(f"{steps}.cdf"), lambda c: c <= u))

    drawn = base.join(rates, F.col(source).eqNullSafe(F.col(named))).withColumn(
        count, F.aggregate(F.sequence(F.lit(1), F.col(f"{steps}.parts")), F.lit(0), part)
    )
    copies = drawn.where(F.col(count) > 0).select(*base.columns, "rate", F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy"))
    keyed = copies.withColumn("order_key", hashed(F.lit(seed), F.lit("order"), own, F.col("copy")))
    return keyed.repartition("order_key").sortWithinPartitions("order_key", doc_id, "copy")
