"""Scalar rules of the screen analysis as Spark columns: names, chromosomes, distances, corrections, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay lengths of the exponential kernels and edges of the window flags, in bases.
DECAYS = {"prox_exp_50k": 50_000, "prox_exp_100k": 100_000, "prox_exp_250k": 250_000, "prox_exp_500k": 500_000}
WINDOWS = {"prox_any_100k": 100_000, "prox_any_250k": 250_000, "prox_any_500k": 500_000}

# hg38 chromosome lengths.
CHROMOSOMES = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979,
    "chr7": 159345973, "chr8": 145138636, "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309,
    "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345, "chr17": 83257441, "chr18": 80373285,
    "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415,
}


def chrom_simple(c: Column) -> Column:
    """Every ``chr`` taken out, one put in front."""
    return F.concat(F.lit("chr"), F.regexp_replace(c, "chr", ""))


def chrom_mito(c: Column) -> Column:
    """Trimmed; MT is M; a name that starts with chr stays; any other gets the prefix."""
    t = F.trim(c)
    t = F.when(F.upper(t).isin("MT", "CHRMT"), "M").otherwise(t)
    return F.when(t.startswith("chr"), t).otherwise(F.concat(F.lit("chr"), F.regexp_replace(t, "chr|Chr|CHR", "")))


# Names that stand for another chromosome.
CHROMOSOME_NAMES = {"M": "chrM", "MT": "chrM", "X": "chrX", "Y": "chrY"}


def chrom_scaffold(c: Column) -> Column:
    """Name without ``chr`` in upper case, known names put right, ``chr`` in front; scaffolds and null become empty, other names stay."""
    t = F.upper(F.replace(F.trim(c), F.lit("chr"), F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in CHROMOSOME_NAMES.items() for x in pair])[t]
    odd = t.contains("_") | t.contains("RANDOM") | t.contains("ALT")
    kept = F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("chr"), t)).when(t.startswith("CHR"), F.replace(t, F.lit("CHR"), F.lit("chr"))).when(odd, "").otherwise(F.concat(F.lit("chr"), F.replace(t, F.lit("CHR"), F.lit("chr"))))
    return F.coalesce(known, kept, F.lit(""))


def ach_id(c: Column) -> Column:
    """``ACH-######`` for its spellings, else the trimmed text."""
    n = F.regexp_extract(c, r"(?i)^\s*ACH[\s_-]?(\d{6})\s*$", 1)
    return F.when(n != "", F.concat(F.lit("ACH-"), n)).otherwise(F.trim(c))


def ccle_name(c: Column) -> Column:
    a = ach_id(c)
    return F.when(a.rlike(r"^ACH-\d{6}$"), a).otherwise(F.upper(F.regexp_replace(a, r"[\s.-]+", "_")))


def plain_key(c: Column) -> Column:
    """Key that doesn't tell dashes from underscores."""
    return F.upper(F.regexp_replace(c, "[-_]+", "_"))


def valid_sample(c: Column) -> Column:
    """Whether a sample name is an ACH id in any spelling or upper-case words joined by underscores, without = or ;. Null is none."""
    t = F.trim(c)
    return F.coalesce(~t.rlike("[=;]") & t.rlike(r"^(?i:ACH[\s_-]?\d{6})$|^[A-Z0-9]+(_[A-Z0-9]+)+$"), F.lit(False))


def gene_symbol(c: Column) -> Column:
    """Symbol without a number in brackets behind it."""
    return F.trim(F.regexp_replace(c, r"\s*\(\d+\)\s*$", ""))


def first_token(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")[0]


def sample_of_path(c: Column) -> Column:
    """Sample that a file name states up to its first point, in the spelling of names."""
    return ccle_name(F.split(F.element_at(F.split(c, "/"), -1), "[.]")[0])


def sample_of_bedpe(c: Column) -> Column:
    """Sample of a path whose name may hold points: only the ending .bedpe is taken off."""
    return ccle_name(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)\.bedpe$", ""))


def breakpoint_parts(c: Column) -> Column:
    """``chrom:pos[-pos]strand`` as struct(chrom, start, end, strand) with the 1-base interval; null otherwise."""
    rx = r"(?i)^\s*(?:chr)?([0-9]+|X|Y|M|MT):(\d+)(?:-\d+)?([+-])\s*$"
    part = lambda i: F.regexp_extract(c, rx, i)
    pos = F.try_to_number(F.nullif(part(2), F.lit("")), F.lit("9" * 18)).cast("long")
    return F.when(
        part(3) != "",
        F.struct(
            F.concat(F.lit("chr"), F.upper(part(1))).alias("chrom"), F.greatest(F.lit(0), pos - 1).alias("start"), pos.alias("end"), part(3).alias("strand")
        ),
    )


def info_text(fields: Mapping[str, Column]) -> Column:
    """``k=v;k=v`` of the fields that aren't null or blank, ``.`` if none is left."""
    parts = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(k + "="), F.trim(v.cast("string")))) for k, v in fields.items()]
    return F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit("."))


def info_value(c: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(c, f"(?:^|;){key}=([^;]+)", 1), F.lit(""))


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def length(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), end - start)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def log2_to_copies(c: Column, ploidy: float = 2.0) -> Column:
    return F.lit(ploidy) * F.pow(F.lit(2.0), c)


def kernels(d: Column, eps: float = 1.0) -> dict[str, Column]:
    """Exponential kernels and the inverse kernel 1 / (d + eps) of a distance."""
    out = {k: F.exp(-d / F.lit(float(v))) for k, v in DECAYS.items()}
    return out | {"prox_inv": F.lit(1.0) / (d + F.lit(eps))}


def within(d: Column, w: int) -> Column:
    return F.coalesce(d <= w, F.lit(False)).cast("int")


def near_far(d: Column, w1: int, w2: int, missing: int = 5_000_000) -> tuple[Column, Column]:
    """Disjoint windows: up to w1, and beyond it up to w2."""
    x = F.coalesce(d, F.lit(missing))
    return (x <= w1).cast("int"), ((x > w1) & (x <= w2)).cast("int")


def nested(d: Column, w1: int, w2: int, missing: int = 10_000_000) -> tuple[Column, Column]:
    x = F.coalesce(d, F.lit(missing))
    return (x <= w1).cast("int"), (x <= w2).cast("int")


def contribution(coefficients: Sequence[Column], features: Sequence[Column]) -> Column:
    """Sum of coefficient times feature; a null coefficient counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * x for c, x in zip(coefficients, features)])


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def abs_max(columns: Sequence[Column]) -> Column:
    return F.greatest(*[F.abs(c) for c in columns]) if len(columns) > 1 else F.abs(columns[0])


def qc_flags(cn: Column, d: Column, cn_off: float = 1.0, close: int = 1_000_000, very_close: int = 100_000) -> dict[str, Column]:
    """Copy number off two, breakpoint close, very close; confounded if at least two hold, or (``confounded_any``) one. A missing distance is infinite."""
    x = F.coalesce(d.cast("double"), F.lit(float("inf")))
    a, b, c = (F.coalesce(v, F.lit(False)).cast("int") for v in (F.abs(cn - 2) >= cn_off, x <= close, x <= very_close))
    return {"flag_cn": a, "flag_bp_close": b, "flag_bp_very_close": c, "confounded": ((a + b + c) >= 2).cast("int"), "confounded_any": ((a + b + c) >= 1).cast("int")}


def label(criteria: Sequence[Column], green: int) -> Column:
    """GREEN at ``green`` criteria met, AMBER at one less, else RED; a null criterion isn't met."""
    score = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in criteria])
    return F.when(score >= green, "GREEN").when(score == green - 1, "AMBER").otherwise("RED")


def clean_coefficient(c: Column, limit: float = 10.0) -> Column:
    """Whether a coefficient is finite and below ``limit`` in size."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < limit), F.lit(False))
