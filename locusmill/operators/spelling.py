"""Spellings of names and ids: folding, tokens, and an equi-join for small edit distances.

Two strings one edit apart (insertion, deletion, substitution, swap of neighbours) share a string
after at most one deletion in each, so the distance join is an equi-join on those deletions followed
by a check. Nothing is compared all against all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters of other scripts that look like the Latin letter below them.
LOOKALIKES = "АВЕКМНОРСТУХІЈЅаеорсухкмвнтіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
LATIN = "ABEKMHOPCTYXIJSaeopcyxkmbhtijsABEZHIKMNOPTYXo"


# Other words for a word of the list.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "LUNG": ("PULMONARY", "PULM"), "STOMACH": ("GASTRIC",), "KIDNEY": ("RENAL",), "BREAST": ("MAMMARY",), "LIVER": ("HEPATIC",),
    "OVARY": ("OVARIAN",), "PANCREAS": ("PANC", "PANCREATIC"), "OESOPHAGUS": ("OESOPH", "ESOPHAGUS", "ESOPHAGEAL"),
    "SKIN": ("CUTANEOUS", "DERMAL"), "BONE": ("OSSEOUS",), "THYROID": ("THYR",), "PROSTATE": ("PROSTATIC",),
    "ENDOMETRIUM": ("ENDOMETRIAL", "UTERUS"), "URINARY": ("BLADDER",), "NERVOUS": ("BRAIN", "CNS"),
    "INTESTINE": ("COLON", "COLORECTAL"), "LARGE": ("LG",), "SOFT": ("SARCOMA",),
    "HAEMATOPOIETIC": ("HEMATOPOIETIC", "BLOOD", "HAEM"), "LYMPHOID": ("LYMPH",),
}


def folded(c: Column) -> Column:
    """Upper case, look-alike letters of other scripts made Latin."""
    return F.upper(F.translate(c, LOOKALIKES, LATIN))


def words(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(folded(c), "[^A-Z0-9]+"), lambda w: w != "")


def id_number(c: Column, prefix: str = "ACH", digits: int = 6) -> Column:
    """Canonical id for any spelling of prefix and number (O read as 0, lost leading zeros, a trailing .0), else null."""
    n = F.regexp_extract(folded(c), f"(?:^|[^A-Z0-9]){prefix}[^A-Z0-9]*([0-9O]{{3,{digits}}})(?:\\.0)?[^A-Z0-9]*$", 1)
    return F.when(n != "", F.concat(F.lit(prefix + "-"), F.lpad(F.translate(n, "O", "0"), digits, "0")))


def spans(c: Column) -> Column:
    """The first word, and the first two and three joined: a name may be written in parts."""
    w = words(c)
    return F.array_distinct(F.filter(F.array(*[F.array_join(F.slice(w, 1, k), "") for k in (1, 2, 3)]), lambda s: s != ""))


def deletions(c: Column) -> Column:
    """The string and all strings with one character less."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, 1, i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 1, cut).otherwise(F.array())))


def edits(a: Column, b: Column) -> Column:
    """0 or 1 edit (a swap counts as one), else null."""
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(a == b, 0).when((F.levenshtein(a, b) == 1) | swap, 1)


def near_join(tokens: DataFrame, token: str, vocabulary: DataFrame, word: str, min_length: int = 4) -> DataFrame:
    """Pairs of token and word at most one edit apart, with ``edits``. Both inputs hold distinct strings."""
    longest = vocabulary.agg(F.max(F.length(word)).alias("__most"))  # a longer token can't be one edit from a word, so it isn't cut up
    left = (
        tokens.select(F.col(token).alias("__t")).where(F.length("__t") >= min_length).join(F.broadcast(longest), F.length("__t") <= F.col("__most") + 1)
        .select("__t", F.explode(deletions(F.col("__t"))).alias("__d"))
    )
    right = vocabulary.select(F.col(word).alias("__w")).where(F.length("__w") >= min_length).withColumn("__d", F.explode(deletions(F.col("__w"))))
    return (
        left.join(right, "__d").select("__t", "__w").distinct()
        .withColumn("edits", edits(F.col("__t"), F.col("__w"))).where("edits is not null")
        .withColumnsRenamed({"__t": token, "__w": word})
    )


def resolve(values: DataFrame, value: str, entries: DataFrame, name: str, entry_id: str) -> DataFrame:
    """value -> entry_id for every distinct value that means one entry; values that mean none are left out.

    An exact name or id counts first, then an id in any spelling (another number is another entry),
    then the first words of the name by at most one edit, the nearest first. Entries whose first word
    is the same are told apart by the rest of the name; where that leaves several, nothing is meant.
    """
    e = entries.select(F.col(name).alias("__name"), F.col(entry_id).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    v = values.select(F.col(value).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    by_name = v.join(e.where("__name is not null"), F.col("__v") == F.col("__name")).select("__v", "__id", F.lit(0.0).alias("cost"))
    as_id = v.withColumn("__n", id_number(F.col("__v")))
    by_id = as_id.join(e.select("__id").distinct(), F.col("__n") == F.col("__id")).select("__v", "__id", F.lit(1.0).alias("cost"))
    heads = e.where("__name is not null").select("__id", F.element_at(words(F.col("__name")), 1).alias("__w"), F.slice(words(F.col("__name")), F.lit(2), F.size(words(F.col("__name")))).alias("__rest"))
    spelled = as_id.where("__n is null").select("__v", F.explode(spans(F.col("__v"))).alias("__span"))
    near = near_join(spelled.select("__span").distinct(), "__span", heads.select("__w").distinct(), "__w")
    other = F.create_map(*[F.lit(x) for k, v in SYNONYMS.items() for s in v for x in (s, k)])
    said = F.transform(words(F.col("__v")), lambda w: F.coalesce(other[w], w))
    unsaid = F.try_divide(F.size(F.array_except("__rest", said)), F.size("__rest"))
    by_word = spelled.join(near, "__span").join(heads, "__w").select("__v", "__id", (2 + 2 * F.col("edits") + F.coalesce(unsaid, F.lit(0))).alias("cost"))
    every = reduce(DataFrame.unionByName, [by_name, by_id, by_word])
    best = every.groupBy("__v", "__id").agg(F.min("cost").alias("cost"))
    w = Window.partitionBy("__v").orderBy("cost")
    return (
        best.withColumn("rank", F.rank().over(w)).where("rank = 1")
        .groupBy("__v").agg(F.min("__id").alias(entry_id), F.count("*").alias("n")).where("n = 1")
        .select(F.col("__v").alias(value), entry_id)
    )
