"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words from its weight, at most ``max_copies``
times what it holds, the excess being reshared.  A document's expected copies
are its own weight times its source's rate, at most ``max_copies``; the rate is
such that the words expected add up to the target.  The whole part is certain;
the fraction is its inclusion probability p for one more copy.  Documents are
ranked by u/(1-u) over p/(1-p), u being a number drawn from the document's id
and text, and taken in that order until the source's remaining words are
filled: a fixed-size sample of unequal probabilities whose size is counted in
words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import delete_path, materialize
from .steps import row_hash

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
#: Ranks are counted in this many bins before the last bin is ordered exactly.
BINS = 4096
#: Weights of documents count in this many steps to the doubling.
STEPS = 8
#: Sources (of some hundred bytes each) whose facts are broadcast.
BROADCAST_SOURCES = 50_000
_WORD = r"[^\x20\x09-\x0D]+"
_ODD = 1e-9
#: The order in which a source's documents are taken; all equal only for equal rows.
_RANK = ("pareto", "key", "size", "hash")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def length_preference(size: Column) -> Column:
    """Texts of under 64 words weigh half, of 512 and more double."""
    return F.when(size < 64, 0.5).when(size < 512, 1.0).otherwise(2.0)


def draw(key: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the key and the text alone."""
    named = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(" "), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(named), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES
) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Weights repeat along the sources in code point order, null last.  With
    caps sorted by cap over weight, the level at which all words are shared
    out is the largest of the levels reached after capping the first k.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    weighed = sizes.select(
        "source", "source_size",
        F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).alias("weight"),
        (F.col("source_size") * max_copies).cast("double").alias("cap"),
    )
    ratio = F.col("cap") / F.col("weight")
    rising = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    asked = F.sum("source_size").over(everyone) * share
    level = (asked - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = weighed.withColumn("level", level)
    target = F.least(F.col("cap"), F.max("level").over(everyone) * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights=WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    key: str = "doc_id",
    weight: Column | None = None,
) -> DataFrame:
    """Every row of ``docs`` as ``row``, with size, source_size, target and copies.

    ``weight`` prefers documents inside their source, by steps of 2^(1/8);
    null and what is not a positive number count as 1.  Null text has size 0.
    Rows that are equal in all columns share their draw and stand together in
    the order; where a sample ends among them, as many are taken as it has room
    for.  Rows of one key with different texts have draws of their own.  A
    source of no words, and an empty table, take nothing beyond certain copies.
    Extra columns travel inside ``row`` and cannot clash.

    Only (source, bin) sums and the documents of one bin per source are
    shuffled; a source that holds a third of all rows is spread over ``BINS``
    bins, with map-side sums, and equal rows are counted before they are ordered.
    """
    spark = docs.sparkSession
    facts = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("source"),
        F.col(f"`{key}`").alias("key"),
        word_count(F.col("text")).alias("size"),
        _stepped(F.lit(None) if weight is None else weight).alias("preference"),
        draw(F.col(f"`{key}`"), F.col("text")).alias("u"),
    ).withColumn("hash", row_hash(docs))
    # Counting words is the dear part, and the counts are needed three times.
    slim, slim_path = materialize(facts.drop("row"), "mix")
    rates, rates_path = materialize(_rates(slim, weights, share, max_copies), "rates")
    bounds, _ = materialize(_bounds(_ranked(slim, _per_source(rates), max_copies)), "bounds")
    for path in (slim_path, rates_path):
        delete_path(spark, path)
    taken = _ranked(facts, _per_source(bounds), max_copies)
    sooner = (F.col("bin") < F.col("last_bin")) | (
        (F.col("bin") == F.col("last_bin")) & (F.struct(*_RANK) < F.col("last")))
    tied = F.coalesce(F.struct(*_RANK) == F.col("last"), F.lit(False))
    more = F.coalesce(sooner, F.lit(False))
    if not bounds.filter(F.col("room") < F.col("tied")).limit(1).count():
        return _copied(taken, more | tied)
    ends, _ = materialize(taken.filter(tied).sortWithinPartitions("source").withColumn(
        "slot", F.monotonically_increasing_id()), "ties")
    return _copied(taken.filter(~tied), more).unionByName(_copied(_numbered_ties(ends), F.col("place") < F.col("room")))


def _copied(taken: DataFrame, more: Column) -> DataFrame:
    copies = F.col("certain") + more.cast("long")
    return taken.select("row", "size", "source_size", "target", copies.alias("copies"))


def _stepped(weight: Column) -> Column:
    exponent = F.round(F.log2(weight.cast("double")) * STEPS) / STEPS
    return F.coalesce(F.when((weight > 0) & (weight < float("inf")), F.pow(F.lit(2.0), exponent)), F.lit(1.0))


def _numbered_ties(ends: DataFrame) -> DataFrame:
    """``place`` counts the equal rows at the end of each source's sample from 0, task by task."""
    task = F.shiftright("slot", 33)
    runs = ends.groupBy(F.col("source").alias("_s"), task.alias("_t")).agg(
        F.min("slot").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    placed = ends.join(runs, F.col("source").eqNullSafe(F.col("_s")) & (task == F.col("_t")))
    return placed.withColumn("place", F.col("_before") + F.col("slot") - F.col("_first"))


def _rates(slim: DataFrame, weights, share, max_copies) -> DataFrame:
    """Targets, and copies per weight: documents at ``max_copies`` leave their excess to the others.

    With weights from the highest down, the rate is the largest of those
    reached after the first k are at their limit, as for the targets.
    """
    levels = slim.groupBy("source", "preference").agg(F.sum("size").alias("words"))
    targets = source_targets(
        levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_copies)
    named = levels.withColumnRenamed("source", "_s")
    joined = targets.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    falling = Window.partitionBy("source").orderBy(F.desc("preference"))
    capped = F.sum(F.col("words") * float(max_copies)).over(falling.rowsBetween(Window.unboundedPreceding, -1))
    preferred = F.sum(F.col("words") * F.col("preference")).over(
        falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = F.when(preferred > 0, (F.col("target") - F.coalesce(capped, F.lit(0.0))) / preferred)
    return joined.withColumn("rate", rate).groupBy("source", "source_size", "target").agg(
        F.coalesce(F.max("rate"), F.lit(0.0)).alias("rate"))


def _per_source(facts: DataFrame) -> DataFrame:
    """One row per source; broadcast when counted to be few, so that no text is shuffled by source.

    Beyond that sources are joined by shuffle, where adaptive execution splits
    a large one.
    """
    return F.broadcast(facts) if facts.count() <= BROADCAST_SOURCES else facts


def _ranked(slim: DataFrame, rates: DataFrame, max_copies: int) -> DataFrame:
    """Certain copies, Pareto rank and its bin, for what each source's rate says."""
    rates = rates.withColumnRenamed("source", "_s")
    expected = F.least(F.col("rate") * F.col("preference"), F.lit(float(max_copies)))
    chance = F.greatest(F.lit(_ODD), F.least(F.lit(1 - _ODD), F.col("expected") - F.col("certain")))
    odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    held = F.col("pareto") / (1 + F.col("pareto"))
    return (
        slim.join(rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("expected", expected)
        .withColumn("certain", F.floor("expected"))
        # A document at its limit has no further copy to draw.
        .withColumn("pareto", F.when(F.col("certain") < max_copies, odds))
        .withColumn("bin", F.least(F.floor(held * BINS), F.lit(BINS - 1)))
    )


def _bounds(ranked: DataFrame) -> DataFrame:
    """Per source: its rate, the bin in which its words are filled, the last rank taken and how many of its rows."""
    per_bin = ranked.groupBy("source", "source_size", "target", "rate", "bin").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("certain")).alias("surely"))
    source = Window.partitionBy("source")
    # A null bin holds the documents at their limit; they come last and are not drawn.
    words = F.when(F.col("bin").isNotNull(), F.col("words")).otherwise(0)
    filled = F.sum(words).over(source.orderBy(F.col("bin").asc_nulls_last()))
    cut = per_bin.select(
        "*", filled.alias("filled"), (F.col("target") - F.sum("surely").over(source)).alias("rest"),
        words.alias("drawn"))
    short = (F.col("filled") < F.col("rest")) & F.col("bin").isNotNull()
    bounds = cut.groupBy("source", "source_size", "target", "rate").agg(
        F.max("rest").alias("rest"),
        F.coalesce(F.max(F.when(short, F.col("bin"))) + 1, F.lit(0)).alias("next_bin"),
        F.min(F.when(~short & F.col("bin").isNotNull(), F.col("bin"))).alias("cut_bin"),
        F.coalesce(F.max(F.when(short, F.col("filled"))), F.lit(0)).alias("before"),
    ).withColumn("last_bin", F.coalesce("cut_bin", "next_bin"))
    edge = bounds.select(F.col("source").alias("_e"), F.col("last_bin").alias("_b"), "rest", "before")
    close = ranked.select("source", "bin", *_RANK).join(
        edge, F.col("source").eqNullSafe(F.col("_e")) & (F.col("bin") == F.col("_b")))
    equal = close.groupBy("source", "rest", "before", *_RANK).agg(F.count("*").alias("tied"))
    sooner = Window.partitionBy("source").orderBy(*_RANK).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("tied")).over(sooner), F.lit(0))
    # A row is taken if at least half of it fits.
    fitting = F.when(F.col("size") > 0, F.ceil(F.col("left") / F.col("size") + 0.5) - 1).otherwise(F.col("tied"))
    near = equal.withColumn("left", left).filter(F.col("size") / 2 < F.col("left"))
    last = near.groupBy(F.col("source").alias("_e")).agg(F.max(F.struct(
        F.struct(*_RANK).alias("last"), F.least(fitting, F.col("tied")).alias("room"), "tied")).alias("end"))
    return bounds.join(last, F.col("source").eqNullSafe(F.col("_e")), "left").select(
        "source", "source_size", "target", "rate", "last_bin", "end.last", "end.room", "end.tied")


def expand_copies(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it is taken."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return mixed.select("row", times).select("row.*")
