"""Operator 8, mixing sources to target weights by capped water-filling. DataFrame functions only.

Targets are the water level times a source's weight, at most `most_epochs` times the source's size. Each document is
repeated as often as its source's target holds the source whole; what is left of the target is taken from the documents
in the order of a seeded hash, the last of them in part. So every source gives its target to within one word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from marketloom.llm.common import written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Hexadecimal digits of the hash that make up a slice of a source.
SLICE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """From (source, size): source, source_size, target. One row a source from the first step on.

    Sources take the weights in turn by code point, null last. In ascending order of size over weight, a source is
    clamped exactly if its cap lies below its share of what the sources before it leave, which is where repeated
    clamping and proportional resharing ends.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    level = Window.orderBy("fill", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("water", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("clamped", F.col("fill") <= F.col("water"))
    )
    flat = F.min(F.when(~F.col("clamped"), F.struct("fill", "source", "water"))).over(every).getField("water")
    return rows.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * flat).alias("target"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most_epochs: float = MOST_EPOCHS, seed: str = "mix"
) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, part_words, taken), one row per row of docs.

    `repeats` is how often a document is taken whole and `part_words` how many of its first words once more. A null or
    empty text has size 0 and gives nothing; a null source is a source of its own, last in order; rows that repeat share
    one place in the order and are told apart by content, whole copies by position, which can't change the result;
    without documents the result is empty. Only the named columns are read, whatever other columns docs has.
    """
    if most_epochs < 1:
        raise ValueError("sources can't give all sizes if a source may not be taken whole")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), place.alias("place")).withColumn("slice", F.substring("place", 1, SLICE_DIGITS)),
        "sizes",
    )
    # one row a slice of a source, then one row a source: windows never hold documents
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("size"))
    targets = source_targets(slices, weights, most_epochs)
    whole = (
        targets.withColumn("words", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    )
    plan = (
        slices.withColumnRenamed("source", "s").withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(whole, F.col("s").eqNullSafe(F.col("source")))
        .select(F.col("s"), F.col("slice").alias("sl"), "source_size", "target", "epochs", (F.col("rest") - F.col("before")).alias("left"), F.col("size").alias("slice_size"))
    )
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).drop("s", "sl")
    # a slice is taken once more in full, not at all, or (one a source) in part
    cut = (F.col("left") > 0) & (F.col("left") < F.col("slice_size"))
    in_slice = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    partly = joined.where(cut).withColumn("left", F.col("left") - F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
    rows = joined.where(~cut).unionByName(partly)
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))
    full = (once_more == F.col("size")) & (F.col("size") > 0)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") + F.when(full, 1).otherwise(0)).alias("repeats"),
        F.when(full, F.lit(0)).otherwise(once_more).cast("long").alias("part_words"),
        (F.col("epochs") * F.col("size") + once_more).cast("long").alias("taken"),
    )


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap FROM by_source),
filled AS (
  SELECT *, cap / weight AS fill,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM weighed),
levels AS (SELECT *, (total - cap_before) / weight_left AS water FROM filled),
flat AS (SELECT min_by(water, fill) AS water FROM levels WHERE fill > water),
targets AS (SELECT source, source_size, CASE WHEN fill <= levels.water THEN cap ELSE weight * flat.water END AS target FROM levels, flat),
cut AS (SELECT *, CAST(floor(target) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT doc_id, s.source, s.size, c.source_size, c.target, c.epochs, c.words - c.epochs * c.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""
