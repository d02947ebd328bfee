"""Whole comparisons: alignment of two sequence sets, their filters and the difference report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import aggregates, band, coords, filters, gaps, matches, structure, variants
from helixframe.operators.cluster import clusters, consistent_set
from helixframe.operators.extend import Options, extend
from helixframe.sources.alignments import with_bounds, with_identity


def seeds_of(refs: DataFrame, queries: DataFrame, o: Options) -> DataFrame:
    found = matches.maximal_matches(refs, queries, o.min_match, o.strand)
    return {"all": lambda m: m, "reference": matches.reference_unique, "unique": matches.unique_matches}[o.matches](found)


def align(refs: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """Match, cluster and extend two sets of sequences into alignments with identity and bounds."""
    o = options
    found, settings = seeds_of(refs, queries, o), (o.max_gap, o.min_cluster, o.diagonal, o.factor)
    chained = band.clusters(found, *settings, refs=refs if o.one_axis else None) if o.tiled or o.one_axis else clusters(found, *settings)
    return with_bounds(with_identity(extend(chained, refs, queries, o)))


def difference_report(refs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``section, metric, value``: sequences, bases, alignments, features and SNPs of a comparison, and its substitutions by letters.

    ``rows`` are read several times; give a persisted or written table.
    """
    flagged = filters.query_best(filters.reference_best(rows))
    one, many = flagged.filter("is_q AND is_r"), flagged.filter("is_q OR is_r")
    walk1, walk2 = structure.breakpoints(many, "reference"), structure.breakpoints(many, "query")
    differing = variants.differences(variants.with_sequences(one, refs, queries))
    found = variants.snps(differing, one)
    letters = lambda section, df: df.select(F.lit(section).alias("section"), F.concat_ws(">", "sub_r", "sub_q").alias("metric"), F.col("n").cast("double").alias("value"))
    kinds = lambda df: df.agg(F.count(F.lit(1)).alias("differences"), F.coalesce(F.sum(((F.col("sub_r") != ".") & (F.col("sub_q") != ".")).cast("int")), F.lit(0)).alias("snps"), F.coalesce(F.sum(((F.col("sub_r") == ".") | (F.col("sub_q") == ".")).cast("int")), F.lit(0)).alias("indels"))
    summaries = aggregates.report({
        "ref_sequences": aggregates.aligned_sequences(refs, rows, "reference"), "qry_sequences": aggregates.aligned_sequences(queries, rows, "query"),
        "one_to_one": aggregates.alignment_summary(one), "many_to_many": aggregates.alignment_summary(many), "breakpoints": aggregates.breakpoint_count(many),
        "ref_features": aggregates.feature_summary(walk1), "qry_features": aggregates.feature_summary(walk2),
        "ref_uncovered": aggregates.uncovered_bases(walk1), "qry_uncovered": aggregates.uncovered_bases(walk2),
        "all_differences": kinds(found), "good_differences": kinds(found.filter("buff >= 20")),
    })
    return summaries.unionByName(letters("all_substitutions", aggregates.snp_matrix(found))).unionByName(letters("good_substitutions", aggregates.snp_matrix(found, good=20)))


#: The settings of the two ready-made match pipelines.
PRESETS = {
    "reference": {"length": 20, "strand": "both", "min_cluster": 100, "factor": 0.12, "max_gap": 600},
    "unique": {"length": 20, "strand": "forward"},
}


def anchored(refs: DataFrame, queries: DataFrame, preset: str = "reference") -> DataFrame:
    """Matches in chains with what lies between them, without extension.

    ``reference``: matches unique in the reference on both strands, clustered. ``unique``: matches
    unique on both sides of the forward strand, of which the longest consistent set is one chain.
    """
    p = PRESETS[preset]
    found = matches.maximal_matches(refs, queries, p["length"], p["strand"])
    if preset == "reference":
        chained = clusters(matches.reference_unique(found), p["max_gap"], p["min_cluster"], factor=p["factor"])
    else:
        order = Window.partitionBy("ref_id", "qry_id", "strand").orderBy("s1", "s2")
        kept = consistent_set(matches.unique_matches(found)).filter("kept").drop("kept")
        chained = kept.withColumn("cluster_id", F.lit(0).cast("long")).withColumn("ord", F.row_number().over(order) - 1).withColumn("adj", F.lit(0).cast("long"))
    return gaps.annotate(chained, refs, queries)


__all__ = ["PRESETS", "align", "anchored", "coords", "difference_report", "seeds_of"]
