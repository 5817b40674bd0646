"""Mixing sources to target weights by Pareto order sampling.

Each mix wants ``size_ratio`` of the tokens of all documents, split over its sources in proportion to
their weights. Within a source a document's expected number of uses grows with the square root of its
tokens (``power``), scaled so that the expected tokens meet the source's share and capped by
``max_repeats``. The whole part of that number is certain; the rest is drawn: documents are ranked by their
random odds divided by their inclusion odds, and the first of this order are taken as long as they fit into the
share. The document at which this ends may be far too long for what is left, so the order is gone on with among the documents
that aren't longer than the gap, a bin at a time, and what is left then is filled with the one document whose size is nearest to it, if that
brings the share nearer.

The random number of a document is a hash of seed, mix and document, so a task that runs again draws the
same. No source is sorted in one task, nor are documents shuffled: the order is cut into 4,096 bins whose tokens are
summed, the bin in which the share is met is cut into 4,096 bins again, and only the documents of one of these, one in some 16 million of the
source's, are sorted. What is found is one row for each target, which the documents meet in a join of the size of the targets.

Defined results: documents of null, empty or uncounted text have no tokens and are used 0 times (they are
not in the result); null weights, sizes and sources, negative and zero weights take no part; a null
``max_repeats`` means once, less than one means never; of repeated ``doc_id`` the row of most tokens counts;
repeated target rows count once (highest weight); a source that can't supply its share gives all it
may and the shortfall is reported, the other sources keep their own shares of the wanted size. Sources without documents are
reported with actual share 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.tokens import count_column
from millrace.plans.session import materialize, ship

BINS = 4096
#: Targets that are broadcast at most, and parts into which a source's documents are spread where they meet more of them.
TARGETS, SALTS = 50_000, 32
#: Steps per doubling of a document's tokens in the summary from which the scale is worked out.
STEPS = 16


def token_sizes(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, source, tokens`` of every document that has tokens, one row per id."""
    ship(documents.sparkSession)
    sized = documents.select("doc_id", "source", count_column(F.col("text"), path).cast("bigint").alias("tokens"))
    return (
        sized.filter("doc_id is not null and tokens > 0")
        .groupBy("doc_id")
        .agg(F.max(F.struct("tokens", "source")).alias("d"))
        .select("doc_id", "d.source", "d.tokens")
    )


def _targets(targets: DataFrame) -> DataFrame:
    clean = (
        targets.filter("mix_name is not null and source is not null and target_weight > 0 and size_ratio > 0")
        .groupBy("mix_name", "source")
        .agg(F.max("target_weight").alias("weight"), F.max(F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0))).alias("most"), F.max("size_ratio").alias("ratio"))
    )
    mix = W.partitionBy("mix_name")
    return clean.select("mix_name", "source", "most", F.max("ratio").over(mix).alias("ratio"), (F.col("weight") / F.sum("weight").over(mix)).alias("share"))


def _scales(sizes: DataFrame, targets: DataFrame, power: float) -> DataFrame:
    """Adds ``scale`` to each (mix, source): expected uses of a document are ``scale * tokens ** power``, capped.

    Documents are summarised by size class (a sixteenth of a doubling), so the search for the scale runs over a few
    hundred rows a source. Over the classes in falling order of size, capped ones first, it is closed form.
    """
    size_class = F.floor(F.log2("tokens") * STEPS)
    classes = sizes.groupBy("source", size_class.alias("class")).agg(F.sum("tokens").alias("tokens"), F.sum(F.pow("tokens", F.lit(power)) * F.col("tokens")).alias("mass"), F.max(F.pow("tokens", F.lit(power))).alias("peak"))
    both = targets.join(classes, "source")
    cell = W.partitionBy("mix_name", "source")
    order = cell.orderBy(F.desc("class"))
    capped = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    free = F.sum("mass").over(order.rowsBetween(0, W.unboundedFollowing))
    # the scale if exactly the larger classes are capped; the right one is the first that leaves its own class uncapped
    tried = both.withColumn("try", (F.col("want") - F.col("most") * capped) / free).withColumn("fits", (F.col("try") > 0) & (F.col("try") * F.col("peak") <= F.col("most")))
    return tried.groupBy("mix_name", "source", "most", "want").agg(
        F.max_by("try", F.when(F.col("fits"), F.col("class"))).alias("scale"), F.sum("tokens").alias("stock")
    )


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _wanted(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    total = sizes.agg(F.sum("tokens").alias("corpus"))
    # one row, joined as a broadcast of one number
    return _targets(targets).join(F.broadcast(total)).withColumn("want", F.col("share") * F.col("ratio") * F.coalesce("corpus", F.lit(0)))


def _at_targets(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the rows of the targets that want their source.

    ``found``, a written table with a row for each target, is broadcast up to ``TARGETS`` rows. Beyond that the join is salted, as a source may hold any part of the documents.
    """
    if found.count() <= TARGETS:
        return sizes.join(F.broadcast(found), "source")
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, ["source", "salt"]).drop("salt")


def _drawn(sizes: DataFrame, found: DataFrame, seed: int, power: float) -> DataFrame:
    """Documents at their targets with ``whole``, the certain uses, and ``rank, bin, fine``, their place in the order; null for those that aren't drawn."""
    most = F.col("most").cast("double")
    expected = F.least(F.coalesce(F.col("scale") * F.pow("tokens", F.lit(power)), most), most)
    unit = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    drawn = _at_targets(sizes, found).withColumn("expected", expected).withColumns({"whole": F.floor("expected"), "part": F.col("expected") - F.floor("expected")})
    drawn = drawn.withColumn("rank", F.when(F.col("part") > 0, _odds(unit) / _odds(F.col("part"))))
    # odds to (0, 1), so that the order can be binned
    place = F.col("rank") / (1 + F.col("rank")) * BINS
    cut = lambda at: F.when(F.col("rank").isNotNull(), F.least(F.floor(at), F.lit(BINS - 1)))
    return drawn.withColumns({"bin": cut(place), "fine": cut((place - F.floor(place)) * BINS)}).drop("expected", "part")


_CELL = ["mix_name", "source"]


def _met_in(cells: DataFrame, place: str) -> DataFrame:
    """Of each target's bins (``place, tokens, rest``) the first that doesn't fit into the rest, and what is left of the rest before it; no row if all fit."""
    line = W.partitionBy(*_CELL).orderBy(place)
    before = cells.withColumn("before", F.sum("tokens").over(line) - F.col("tokens"))
    beyond = before.filter(F.col("before") + F.col("tokens") > F.col("rest"))
    return beyond.groupBy(*_CELL).agg(F.min(F.struct(place, (F.col("rest") - F.col("before")).alias("left"))).alias("m")).select(*_CELL, f"m.{place}", "m.left")


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17, power: float = 0.5) -> DataFrame:
    """``mix_name, source, doc_id, tokens, uses``: the documents of each mix with their number of uses.

    ``sizes`` has one row per document (``token_sizes``).
    """
    scaled = materialize(_scales(sizes, _wanted(sizes, targets), power), "scaled")
    bins = _drawn(sizes, scaled, seed, power).groupBy(*_CELL, "want", "bin").agg(F.sum(F.col("whole") * F.col("tokens")).alias("sure"), F.sum("tokens").alias("tokens"))
    bins = bins.withColumn("rest", F.col("want") - F.sum("sure").over(W.partitionBy(*_CELL))).filter("bin is not null")
    # where the share is met, one row for each target: its bin, the bin within that, the document
    edge = _met_in(bins, "bin").withColumnRenamed("bin", "edge_bin")
    found = materialize(scaled.join(edge, _CELL, "left"), "edge")
    within = materialize(_drawn(sizes, found, seed, power).filter(F.col("bin") == F.col("edge_bin")).select(*_CELL, "fine", "rank", "doc_id", "tokens", F.col("left").alias("rest")), "within")
    fine = _met_in(within.groupBy(*_CELL, "fine").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest")), "fine")
    inmost = within.drop("rest").join(fine.withColumnRenamed("left", "rest"), [*_CELL, "fine"]).select(*_CELL, F.struct("fine", "rank", "doc_id").alias("doc"), "tokens", "rest")
    last = _met_in(inmost, "doc").withColumnRenamed("doc", "edge_doc")
    found = materialize(found.drop("left").join(last, _CELL, "left"), "edge")
    # before the edge all are taken; without an edge all there are
    at, end = F.struct("fine", "rank", "doc_id"), F.col("edge_doc")
    ahead = (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (at < end))
    taken = F.coalesce(ahead, F.col("bin").isNotNull())
    after = _drawn(sizes, found, seed, power).filter(F.col("bin").isNotNull() & ~taken)
    short = after.filter(F.col("tokens") <= F.col("left")).groupBy(*_CELL, "bin").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("rest"))
    more = _met_in(short, "bin").select(*_CELL, F.col("bin").alias("more_bin"), F.col("left").alias("more_left"))
    whole = short.groupBy(*_CELL).agg(F.max("rest").alias("gap"), F.sum("tokens").alias("stocked"))
    found = found.join(whole, _CELL, "left").join(more, _CELL, "left")
    # all that aren't too long fit where no bin is the first that doesn't
    found = materialize(found.withColumn("more_left", F.coalesce("more_left", F.col("gap") - F.col("stocked"), "left")).drop("gap", "stocked"), "edge")
    filled = F.coalesce(F.col("bin").isNotNull() & ~taken & (F.col("tokens") <= F.col("left")) & (F.col("more_bin").isNull() | (F.col("bin") < F.col("more_bin"))), F.lit(False))
    off = F.abs(F.col("tokens") - F.col("more_left"))
    rest = _drawn(sizes, found, seed, power).filter(F.col("bin").isNotNull() & ~taken & ~filled & (off < F.col("more_left")))
    filler = rest.groupBy(*_CELL).agg(F.min(F.struct(off.alias("off"), "rank", "doc_id")).alias("f")).select(*_CELL, F.col("f.doc_id").alias("filler"))
    found = materialize(found.join(filler, _CELL, "left"), "edge")
    extra = F.when(taken | filled | F.coalesce(F.col("doc_id") == F.col("filler"), F.lit(False)), 1).otherwise(0)
    uses = (F.col("whole") + extra).cast("int")
    return _drawn(sizes, found, seed, power).select("mix_name", "source", "doc_id", "tokens", uses.alias("uses")).filter("uses > 0")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: wanted and actual tokens and shares, documents, uses, the most uses of one document, shortfall.

    Both shares are of the wanted size of the mix, ``actual_share_of_mix`` is of what was reached.
    """
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("uses") * F.col("tokens")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses")
    )
    whole = W.partitionBy("mix_name")
    both = _wanted(sizes, targets).join(got, ["mix_name", "source"], "left")
    actual = F.coalesce("actual_tokens", F.lit(0))
    size = F.col("ratio") * F.coalesce("corpus", F.lit(0))
    return both.select(
        "mix_name",
        "source",
        F.col("share").alias("wanted_share"),
        F.col("want").alias("wanted_tokens"),
        actual.alias("actual_tokens"),
        F.coalesce(actual / F.nullif(size, F.lit(0.0)), F.lit(0.0)).alias("actual_share"),
        F.coalesce(actual / F.nullif(F.sum(actual).over(whole), F.lit(0)), F.lit(0.0)).alias("actual_share_of_mix"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.greatest(F.col("want") - actual, F.lit(0.0)).alias("shortfall_tokens"),
    )


def sized_table(documents: DataFrame, path: str) -> DataFrame:
    """``token_sizes`` written once, since a mix reads it several times."""
    return materialize(token_sizes(documents, path), "sizes")
