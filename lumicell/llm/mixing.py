"""Mixing sources to target weights.

Every document gets a hash-random key.  Keys are range-sorted within their source by cutting the key
space into equal ranges (the key is uniform, so ranges are even and a source that holds most rows is
spread over many of them); a prefix sum of word counts over a range starts from the sum of all ranges
before it.  A document is taken once for every whole epoch its source's budget allows, and the last
epoch is cut at the exact word where the budget ends.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lumicell.functions.rank import distributed_rank
from lumicell.llm.shared import any_names, cut, free_name, power_of_two

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows wanted in one range of keys, and the most ranges of one source (they meet in one small window).
RANGE_ROWS, MOST_RANGES = 256, 1 << 16


def word_count(text) -> F.Column:
    """Number of maximal runs of characters other than the six ASCII spaces; 0 for null."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.translate(words, " \t\n\u000b\f\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Rows ``(source, source_size, target)`` from rows ``(source, source_size)``, one for each source.

    Sources by code point, null last, take the weights in turn; the targets share the total.  A target
    stops at ``epochs`` times its source and the excess goes to the others by weight.  The common level
    (words for one unit of weight) is the largest of the levels that result when the first 0, 1, 2, ...
    sources by room for each unit of weight are full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight.cast("long")).withColumn("most", epochs * F.col("source_size"))
    fullest = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = capped.withColumn("level_here", left / share).withColumn("level", F.max("level_here").over(everything))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(documents: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Rows ``(doc_id, source, tie, size, source_size, target, taken)``, one for each document; ``tie`` is the text's hash.

    ``taken`` is how many of the document's words the mix takes, repeats counted: its size for every
    whole epoch, and in the last epoch what is left of the budget when its turn comes (so one document of
    a source may be taken in part, and a source's ``taken`` adds up to its target, rounded down).

    Null or wordless text: size 0, taken 0.  A null source is a source of its own.  Order within a source
    follows the key, then ``doc_id``, then the text's hash; rows equal in all three are interchangeable.
    An empty table gives no rows; other columns are ignored.  The number of sources is taken as small
    (their totals meet in one window); rows, and rows of one source, are not.
    """
    spark = documents.sparkSession
    rows = cut(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("key"),
            F.xxhash64("text").alias("tie"),
        )
    )
    ranges = power_of_two(-(-rows.count() // RANGE_ROWS), MOST_RANGES)
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(first * ranges / (1 << 32)).cast("int"))

    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))  # joins need a key that is never null
    by_range = rows.groupBy(named.alias("part"), "source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = cut(by_range.withColumn("base", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))))
    targets = source_targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, epochs)
    starts = by_range.select("part", "range", "base").join(targets.select(named.alias("part"), "source_size", "target"), "part")

    within = Window.partitionBy("part", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("part", named).withColumn("through", F.sum("size").over(within)).join(starts, ["part", "range"])
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size")
    before = F.col("base") + F.col("through") - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select(
        "doc_id", "source", "tie", "size", "source_size", "target", (whole * F.col("size") + last).cast("long").alias("taken")
    )


@any_names
def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``documents``: a document taken in n epochs, the last perhaps in part, has n rows.

    Texts stay whole: the document at which a source's budget ends has its full text in that epoch.  Rows meet their part of the
    mix by id, source and the text's hash.  Rows equal in all three share what the mix takes of them: together they have as many
    rows as it has begun, dealt evenly, one more to those with the smallest hashes of their other columns.
    """
    group = ("doc_id", "source", "tie")
    taken = mix(documents, **options).groupBy(*group).agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("rows")).filter("taken > 0")
    names = {n: free_name(documents, f"mix_{n}") for n in (*group, "each", "more", "row", "at", "rank", "first", "epoch")}
    often = taken.withColumn("begun", F.expr("(taken + size - 1) div size")).select(*[F.col(n).alias(names[n]) for n in group], F.expr("begun div rows").alias(names["each"]), F.expr("begun % rows").alias(names["more"]))
    often = cut(often)
    own = (F.col("doc_id").cast("long"), F.col("source"), F.xxhash64("text"))
    met = documents.join(often, functools.reduce(Column.__and__, [a.eqNullSafe(F.col(names[n])) for a, n in zip(own, group)]))

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn(names["epoch"], F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*documents.columns)

    even = repeated(met.filter(f"{names['more']} = 0"), F.col(names["each"]))
    if often.filter(f"{names['more']} > 0").isEmpty():
        return even
    plain = [F.col(f.name) if isinstance(f.dataType, AtomicType) else F.col(f.name).cast("string") for f in documents.schema.fields]
    uneven = cut(met.filter(f"{names['more']} > 0")).withColumns({names["row"]: F.xxhash64(*plain), names["at"]: F.monotonically_increasing_id()})
    keys = [names[n] for n in group]
    ranked = distributed_rank(uneven, [*keys, names["row"], names["at"]], names["rank"])  # equal rows are interchangeable, so any order of them will do
    first = ranked.groupBy(*keys).agg(F.min(names["rank"]).alias("first")).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("first").alias(names["first"]))
    placed = ranked.join(first, functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]))
    one_more = (F.col(names["rank"]) - F.col(names["first"]) < F.col(names["more"])).cast("long")
    dealt = placed.withColumn(names["each"], F.col(names["each"]) + one_more).filter(f"{names['each']} > 0")
    return even.unionByName(repeated(dealt, F.col(names["each"])))


#: DuckDB SQL for ``mix``.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM {documents}
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 3 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM totals
), levels AS (
  SELECT source, source_size, most, weight,
    CAST(sum(source_size) OVER () - coalesce(sum(most) OVER w, 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level_here
  FROM ranked
  WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), weight * max(level_here) OVER ()) AS target FROM levels
), summed AS (
  SELECT doc_id, text, s.source, size, source_size, target,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM summed
"""
