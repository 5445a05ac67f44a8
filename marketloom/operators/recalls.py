"""Recalls looked up from free text: year, make and model read, the model widened word by word, and a clean bill only for known models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions.places import title_case
from marketloom.operators.joins import with_facts

# Makes of two words, the first model year, and how far back a model counts as known.
TWO_WORD_MAKES = ("land rover", "alfa romeo", "aston martin", "general motors", "mercedes benz", "mercedes-benz", "rolls royce")
FIRST_YEAR, KNOWN_YEARS = 1970, 10


def parsed_query(raw: Column, this_year: int) -> Column:
    """struct(year, make, model): the first word that is a model year, up to the next one, is the year wherever it stands; of the others the
    first is the make, or the first two where they are one make, and the rest the model."""
    words = F.filter(F.split(F.trim(F.coalesce(raw, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    is_year = lambda w: F.coalesce(w.rlike("^[0-9]{4}$") & w.try_cast("int").between(FIRST_YEAR, this_year + 1), F.lit(False))
    at = F.array_position(F.transform(words, is_year), True)
    year = F.when(at > 0, F.element_at(words, F.greatest(at, F.lit(1)).cast("int")).try_cast("int"))
    rest = F.filter(words, lambda w, i: i + 1 != at)
    two = F.coalesce(F.lower(F.array_join(F.slice(rest, 1, 2), " ")).isin(*TWO_WORD_MAKES), F.lit(False)) & (F.size(rest) >= 2)
    head = F.when(two, 2).otherwise(1)
    part = lambda a: F.nullif(title_case(F.array_join(a, " ")), F.lit(""))
    make = part(F.slice(rest, F.lit(1), head))
    model = part(F.slice(rest, head + 1, F.greatest(F.size(rest) - head, F.lit(0))))
    return F.struct(year.alias("year"), make.alias("make"), model.alias("model"))


def model_candidates(model: Column, base: Column) -> Column:
    """Names to look a model up by: the base model, the model, and the model less its last words one by one; each once without regard to
    case, in the spelling that comes first."""
    words = F.split(F.trim(F.coalesce(model, F.lit(""))), r"(?U)\s+")
    shorter = F.transform(F.sequence(F.size(words) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    heads = F.when(F.size(words) > 1, shorter).otherwise(F.array().cast("array<string>"))
    every = F.filter(F.concat(F.array(F.trim(F.coalesce(base, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))), heads), lambda c: c != "")
    upper = F.transform(every, lambda c: F.upper(c))
    return F.filter(every, lambda c, i: F.array_position(upper, F.upper(c)) == i + 1)


def recall_lookup(queries: DataFrame, registry: DataFrame, query_id: str) -> DataFrame:
    """(query_id, count, matched_model, confirmed, confirmed_by) of queries (query_id, year, make, model, base_model) with year, make and
    model, from registry rows (make, model, year, recall_number).

    The first candidate name with recalls of that year counts, each number once. Without one, no recall is only a clean bill if some
    candidate is known from the ten years before: `confirmed`.
    """
    up = lambda c: F.upper(F.trim(c))
    q = queries.where("year is not null and make is not null and model is not null")
    q = q.select(query_id, "year", up(F.col("make")).alias("mk"), F.posexplode(model_candidates(F.col("model"), F.col("base_model"))).alias("at", "name")).withColumn("md", up(F.col("name")))
    known = registry.select(up(F.col("make")).alias("mk"), up(F.col("model")).alias("md"), F.col("year").alias("ry"), "recall_number").where("recall_number <> ''")
    counts = known.where("ry is not null").groupBy("mk", "md", "ry").agg(F.count_distinct("recall_number").alias("n"))
    # a candidate meets its model once, with all its years, and few models aren't dealt out by name
    met = with_facts(q, counts.groupBy("mk", "md").agg(F.map_from_entries(F.collect_list(F.struct("ry", "n"))).alias("years")), ["mk", "md"])
    n = F.try_element_at("years", F.col("year"))
    earlier = F.exists(F.map_keys("years"), lambda y: y.between(F.col("year") - KNOWN_YEARS, F.col("year") - 1))
    first = lambda when, of: F.min(F.when(when, F.struct("at", "name", of.alias("n"))))
    g = met.groupBy(query_id).agg(first(n.isNotNull(), n).alias("h"), first(earlier, F.lit(None).cast("long")).alias("k"))
    found = F.col("h").isNotNull()
    return g.select(
        query_id, F.coalesce("h.n", F.lit(0)).alias("count"), F.col("h.name").alias("matched_model"), (found | F.col("k").isNotNull()).alias("confirmed"),
        F.when(~found, F.col("k.name")).alias("confirmed_by"),
    )
