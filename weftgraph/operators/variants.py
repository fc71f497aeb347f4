"""Protein variants: filtering records, numbering, placement on a sequence, roll-up and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values
KEPT_CLASSES = ("pathogenic", "likely pathogenic", "pathogenic/likely pathogenic")
LETTERS = "Ala A Arg R Asn N Asp D Cys C Gln Q Glu E Gly G His H Ile I Leu L Lys K Met M Phe F Pro P Ser S Thr T Trp W Tyr Y Val V".split()
CHANGE = r"\(p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})\)"
VERY_HIGH, MOST_SHIFT, LEAST_ROWS = 90, 60, 10
RECORD = "uid string, title string, genes array<struct<symbol:string>>, molecular_consequence_list array<string>, germline_classification struct<description:string,review_status:string,last_evaluated:string,trait_set:array<struct<trait_name:string>>>, variation_set array<struct<variation_name:string,variant_type:string>>"


def one_letter(three: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, LETTERS)), three)


def select_records(records: DataFrame) -> DataFrame:
    """Missense single-nucleotide rows of kept classes whose preferred name is written on the gene, from ``gene, r``.

    ``r`` is a record of schema :data:`RECORD`. Names without a protein change between two different amino acids drop out.
    """
    r = F.col("r")
    first = F.get(r["variation_set"], 0)
    name = F.coalesce(F.nullif(first["variation_name"], F.lit("")), r["title"], F.lit(""))
    kind = F.trim(F.coalesce(r["germline_classification"]["description"], F.lit("")))
    rows = records.where(
        F.lower(kind).isin(*KEPT_CLASSES)
        & F.array_contains(r["molecular_consequence_list"], "missense variant")
        & F.exists(r["genes"], lambda g: g["symbol"] == F.col("gene"))
        & (F.lower(first["variant_type"]) == "single nucleotide variant")
        & F.contains(name, F.concat(F.lit("("), F.col("gene"), F.lit("):")))
    )
    part = lambda i: F.regexp_extract(name, CHANGE, i)
    traits = F.filter(F.transform(r["germline_classification"]["trait_set"], lambda t: t["trait_name"]), lambda t: t != "")
    out = rows.select(
        "gene",
        r["uid"].alias("record_id"),
        F.concat(part(1), part(2), part(3)).alias("change"),
        F.expr(f"try_cast(regexp_extract({'coalesce(nullif(r.variation_set[0].variation_name, \"\"), r.title, \"\")'}, r'{CHANGE}', 2) AS bigint)").alias("position"),
        one_letter(part(1)).alias("ref"),
        one_letter(part(3)).alias("alt"),
        kind.alias("classification"),
        F.translate(F.substring(F.coalesce(r["germline_classification"]["last_evaluated"], F.lit("")), 1, 10), "/", "-").alias("last_evaluated"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce(traits, F.array().cast("array<string>")))), "; ").alias("conditions"),
    )
    return out.where("ref is not null and alt is not null and ref <> alt and position is not null")


def residues(structures: DataFrame) -> DataFrame:
    """``gene, position, residue, plddt`` from ``gene, seq, plddt[], first_residue``."""
    return structures.select("gene", "first_residue", "plddt", F.posexplode(F.split("seq", "")).alias("i", "residue")).select(
        "gene", (F.col("i") + F.col("first_residue")).cast("bigint").alias("position"), "residue", F.get("plddt", F.col("i")).alias("plddt")
    )


def best_shift(variants: DataFrame, places: DataFrame, most: int = MOST_SHIFT) -> DataFrame:
    """``gene, shift``: the numbering shift that puts most reference letters in place.

    Candidates are formed by an equi-join on (gene, letter) within the range of shifts, after counting variants per
    (gene, position, letter). A shift counts only with 10 variants or more, at least 90 % in place and under half in
    place without it; otherwise it is 0. Ties: the smaller shift, then the negative one.
    """
    spots = variants.groupBy("gene", "position", "ref").agg(F.count("*").alias("n"))
    total = spots.groupBy("gene").agg(F.sum("n").alias("total"))
    tried = spots.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("at", F.col("position") + F.col("shift"))
    hits = tried.join(places.select("gene", F.col("position").alias("at"), F.col("residue").alias("ref")), ["gene", "at", "ref"]).groupBy("gene", "shift").agg(F.sum("n").alias("hits"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("gene").orderBy(F.desc("hits"), F.abs("shift"), "shift")))
    plain = hits.where("shift = 0").select("gene", F.col("hits").alias("plain"))
    out = total.join(ranked.where("rank = 1"), "gene", "left").join(plain, "gene", "left")
    good = (F.col("total") >= LEAST_ROWS) & (F.coalesce("plain", F.lit(0)) < 0.5 * F.col("total")) & (F.col("hits") >= 0.9 * F.col("total"))
    return out.select("gene", F.when(good, F.col("shift")).otherwise(0).cast("bigint").alias("shift"))


def place(variants: DataFrame, places: DataFrame, shifts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants whose reference letter stands at their shifted position, with its confidence; and the rejected ones."""
    moved = variants.join(shifts, "gene", "left").withColumn("position", F.col("position") + F.coalesce("shift", F.lit(0))).drop("shift")
    spots = places.select("gene", "position", F.col("residue").alias("ref"), "plddt")
    return moved.join(spots, ["gene", "position", "ref"]), moved.join(spots, ["gene", "position", "ref"], "left_anti")


def roll_up(placed: DataFrame) -> DataFrame:
    """Per position: number of records, its changes and its conditions, both distinct and sorted."""
    named = F.filter(F.split("conditions", "; "), lambda c: c != "")
    return placed.groupBy("gene", "position").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("change")), " / ").alias("changes"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(named)))), "; ").alias("conditions"),
    )


def enrichment(per_gene: DataFrame) -> DataFrame:
    """Observed and expected positions of very high confidence, pooled over genes.

    ``per_gene`` has ``n`` variant positions, ``hits`` of them very high, ``k`` very high residues of ``t``. Expected
    value and variance are hypergeometric within each gene; ratio and z are null where their divisor is 0.
    """
    rows = per_gene.where("t > 0")
    n, k, t = (F.col(c).cast("double") for c in ("n", "k", "t"))
    sums = rows.agg(
        F.sum("hits").cast("bigint").alias("observed"),
        F.sum(n * k / t).alias("expected"),
        F.sum(F.when(t > 1, n * k * (t - k) * (t - n) / (t * t * (t - 1))).otherwise(0.0)).alias("variance"),
    )
    zero = F.lit(0.0)
    return sums.select("observed", "expected", "variance", (F.col("observed") / F.nullif(F.col("expected"), zero)).alias("ratio"), ((F.col("observed") - F.col("expected")) / F.nullif(F.sqrt("variance"), zero)).alias("z"))
