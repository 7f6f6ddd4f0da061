"""Typed names mapped to the entries of a canonical list.

Token-level repair: each distinct token of the typed values is joined to the vocabulary of the list by
edit distance (an equi-join on one-letter deletions). The corrected tokens then rank complete entries
by soft TF-IDF: the cosine of the weighted tokens of the value and the entry, each pair of tokens counting by its similarity. Candidates come only from the telling words of an entry (its first word, or its id), so
common words like tissues weigh in the score but never pair everything with everything.

Defined results: a null value is no case; a value that is an entry's name or id to the letter is no
case either; empty, blank and signs-only values mean no entry; an id with another number means no
entry; where another candidate shares as much with the value as the best does, none is meant; repeated entries count once,
entries without a name are reached by id only; an empty list maps everything to no entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.operators.spelling import SYNONYMS, id_number, near_join, words
from locusmill.session import broadcast_if_small, cut

NO_ENTRY = "NONE"

def _terms(c: Column) -> Column:
    """Words of a typed value, its first two and three words joined, and its id if it is one."""
    w = words(c)
    joined = F.array(F.array_join(F.slice(w, 1, 2), ""), F.array_join(F.slice(w, 1, 3), ""))
    n = id_number(c)
    return F.when(n.isNotNull(), F.array(n)).otherwise(F.array_distinct(F.filter(F.concat(w, joined), lambda t: t != "")))


def _vocabulary(entries: DataFrame) -> DataFrame:
    """Words of the list with their weight: the logarithm of entries over entries that hold the word."""
    total = entries.agg(F.count("*").alias("total"))
    return (
        entries.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
        .join(F.broadcast(total), F.lit(True)).select("word", F.log1p(F.col("total") / F.col("df")).alias("idf"))
    )


def rank_entries(values: DataFrame, value: str, entries: DataFrame, name: str, entry_id: str) -> DataFrame:
    """value, entry_id, score: the best entry of each distinct value that means one."""
    listed = entries.select(F.col(name).alias("__name"), F.col(entry_id).alias("__id")).where("__id is not null").distinct()
    e = listed.select(
        "__id", F.array_distinct(F.concat(F.array(F.col("__id")), F.coalesce(words(F.col("__name")), F.array().cast("array<string>")))).alias("words"),
    )
    vocabulary = cut(_vocabulary(e))
    weights = e.select("__id", F.explode("words").alias("word")).join(broadcast_if_small(vocabulary), "word").groupBy("__id").agg(
        F.collect_list(F.struct("word", "idf")).alias("words"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")
    )
    telling = listed.select("__id", F.col("__id").alias("word")).unionByName(
        listed.where("__name is not null").select("__id", F.element_at(words(F.col("__name")), 1).alias("word"))
    ).distinct()

    typed = values.select(F.col(value).alias("__v")).where("__v is not null").distinct().withColumn("__terms", _terms(F.col("__v")))
    terms = typed.select(F.explode("__terms").alias("term")).distinct()
    words_only = vocabulary.select("word").where(~F.col("word").contains("-"))
    other = F.create_map(*[F.lit(x) for k, v in SYNONYMS.items() for s in v for x in (s, k)])
    unknown = terms.join(vocabulary.select(F.col("word").alias("term")), "term", "left_anti")  # only these are repaired
    repaired = (
        terms.join(vocabulary.select(F.col("word").alias("term")), "term").select("term", F.col("term").alias("word"), F.lit(1.0).alias("sim"))
        .unionByName(near_join(unknown.where(~F.col("term").contains("-")), "term", words_only, "word")
                     .select("term", "word", (1 - F.lit(1.0) / F.length("term")).alias("sim")))
        .unionByName(terms.withColumn("word", other[F.col("term")]).where("word is not null").select("term", "word", F.lit(0.95).alias("sim")))
    )
    matched = cut(typed.select("__v", F.explode("__terms").alias("term")).join(repaired, "term").groupBy("__v", "word").agg(F.max("sim").alias("sim")))
    known = matched.join(broadcast_if_small(vocabulary), "word")
    bags = known.groupBy("__v").agg(F.map_from_entries(F.collect_list(F.struct("word", "sim"))).alias("bag"), F.sqrt(F.sum(F.pow(F.col("sim") * F.col("idf"), F.lit(2.0)))).alias("own"))
    candidates = matched.join(telling, "word").select("__v", "__id").distinct()
    shared = F.aggregate(
        "words", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(F.col("bag"), x["word"]), F.lit(0.0)) * x["idf"] * x["idf"]
    )
    scored = candidates.join(bags, "__v").join(weights, "__id").select("__v", "__id", shared.alias("shared"), (shared / F.col("norm") / F.col("own")).alias("score"))
    best = scored.groupBy("__v").agg(F.max_by(F.struct("__id", "shared"), F.struct("score", "__id")).alias("x"), F.max("score").alias("score"))
    rivals = scored.join(best.select("__v", "x"), "__v").where((F.col("__id") != F.col("x.__id")) & (F.col("shared") >= F.col("x.shared") - 1e-9)).select("__v").distinct()
    return best.join(rivals, "__v", "left_anti").select(F.col("__v").alias(value), F.col("x.__id").alias(entry_id), "score")


def map_values(rows: DataFrame, value: str, entries: DataFrame, name: str, entry_id: str) -> DataFrame:
    """``rows`` whose value isn't an entry to the letter, with the ``entry_id`` meant or NONE."""
    exact = entries.select(F.explode(F.array(name, entry_id)).alias(value)).where(F.col(value).isNotNull()).distinct()
    typed = rows.where(F.col(value).isNotNull()).join(broadcast_if_small(exact), value, "left_anti")
    meant = rank_entries(typed.select(value), value, entries, name, entry_id).drop("score")
    return typed.join(meant, value, "left").withColumn(entry_id, F.coalesce(entry_id, F.lit(NO_ENTRY)))


def unmatched(mapped: DataFrame, value: str, entry_id: str, *by: str) -> DataFrame:
    """Values that mean no entry, with their number of rows."""
    return mapped.where(F.col(entry_id) == NO_ENTRY).groupBy(*by, value).agg(F.count("*").alias("n"))
