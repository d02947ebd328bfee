"""Text formats as rows ``..., line`` or ``..., lines``, and writers that keep them in order.

A format is made of column expressions; a writer sorts by what the format asks for and writes text
from all partitions. Whoever needs one file coalesces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(*parts: Column | str, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """The column ``line`` as text, in ``order`` across the part files."""
    (df.orderBy(*order) if order else df).select("line").write.mode("overwrite").text(path)


def fixed(value: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", value.cast("double"))


def delta_records(rows: DataFrame) -> DataFrame:
    """``ref_id, qry_id, line``: a pair's header and its alignments, each with its deltas and a closing 0."""
    one = F.concat_ws("\n", _text("s1", "e1", "s2", "e2", "errors", "sim_errors", "stops"), F.when(F.size("deltas") > 0, F.array_join(F.transform("deltas", lambda d: d.cast("string")), "\n")), F.lit("0"))
    pairs = rows.withColumn("_one", one).groupBy("ref_id", "qry_id", "ref_len", "qry_len").agg(F.sort_array(F.collect_list(F.struct("aln_id", "_one"))).alias("a"))
    head = F.concat(F.lit(">"), _text("ref_id", "qry_id", "ref_len", "qry_len"))
    return pairs.select("ref_id", "qry_id", F.concat_ws("\n", head, F.array_join(F.transform("a", lambda x: x["_one"]), "\n")).alias("line"))


#: The words for the data type in the header of a delta file.
TYPE_WORDS = {"dna": "NUCMER", "protein": "PROMER"}


def write_delta(rows: DataFrame, path: str, ref_path: str, qry_path: str, data_type: str = "dna") -> None:
    """Delta text ordered by query and reference, its two header lines first: paths, and the word for the data type."""
    type_word = TYPE_WORDS[data_type]
    head = rows.sparkSession.createDataFrame([("", "", 0, f"{ref_path} {qry_path}\n{type_word}")], "qry_id string, ref_id string, n int, line string")
    body = delta_records(rows).select("qry_id", "ref_id", F.lit(1).alias("n"), "line")
    write_lines(head.unionByName(body), path, "n", "qry_id", "ref_id")


def long_enough(rows: DataFrame, length: int) -> DataFrame:
    """Without alignments that are short on both sides."""
    return rows.filter(F.greatest(F.abs(F.col("e1") - F.col("s1")), F.abs(F.col("e2") - F.col("s2"))) + 1 >= length)


def match_lines(found: DataFrame, queries: DataFrame, four: bool = False, with_length: bool = False, with_letters: bool = False) -> DataFrame:
    """``qry_id, strand, lines``: a header for each query and strand, then its matches; also for queries without any."""
    cells = [F.lpad(F.col(c).cast("string"), 9, " ") for c in ("s1", "s2", "len")]
    line = F.concat_ws(" ", *([F.col("ref_id")] if four else []), *cells)
    if with_letters:
        line = F.concat_ws("\n", line, F.col("letters"))
    some = found.withColumn("_l", line).groupBy("qry_id", "strand").agg(F.sort_array(F.collect_list(F.struct("s2", "s1", "_l"))).alias("m"))
    ways = queries.select(F.col("seq_id").alias("qry_id"), "len").crossJoin(F.broadcast(queries.sparkSession.createDataFrame([(1,), (-1,)], "strand int")))
    head = F.concat(F.lit("> "), F.col("qry_id"), F.when(F.col("strand") < 0, " Reverse").otherwise(""), F.concat(F.lit("  Len = "), F.col("len").cast("string")) if with_length else F.lit(""))
    return ways.join(some, ["qry_id", "strand"], "left").select("qry_id", "strand", F.concat(F.array(head), F.coalesce(F.transform("m", lambda x: x["_l"]), F.array().cast("array<string>"))).alias("lines"))


def read_matches(spark, path: str) -> DataFrame:
    """``qry_id, strand, s1, s2, len`` from match lists; a list is one record, so it is read by many tasks."""
    lists = spark.read.option("lineSep", "\n>").text(path).select(F.split(F.regexp_replace("value", "^>", ""), "\n").alias("l"))
    head = F.split(F.trim(F.col("l")[0]), r"\s+")
    rows = lists.select(head[0].alias("qry_id"), F.when(F.col("l")[0].contains("Reverse"), -1).otherwise(1).alias("strand"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("row"))
    cells = F.split(F.trim("row"), r"\s+")
    return rows.filter(F.col("row").rlike(r"^\s*\d+\s+\d+\s+\d+")).select("qry_id", "strand", *[cells[i].cast("long").alias(c) for i, c in enumerate(("s1", "s2", "len"))])


def cluster_lines(listed: DataFrame) -> DataFrame:
    """Cluster rows with their gaps as lines: ``-`` for the first of a cluster."""
    gap = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return listed.select("ref_id", "qry_id", "strand", "cluster_id", "ord", _text("s1", "s2", "len", gap("gap1"), gap("gap2")).alias("line"))


def coords_lines(shown: DataFrame) -> DataFrame:
    """Tab-separated coordinates; whatever percent columns there are get two decimals."""
    percents = {"idy", "sim", "stp", "cov1", "cov2"}
    names = [c for c in shown.columns if c != "aln_id"]
    return shown.select("aln_id", _text(*[fixed(F.col(c)) if c in percents else F.col(c) for c in names], sep="\t").alias("line"))


def coords_table(shown: DataFrame) -> DataFrame:
    """Coordinates for people to read: columns of equal width between bars, names last."""
    wide = lambda c: F.lpad(F.col(c).cast("string"), 8, " ")
    pairs = [F.concat_ws(" ", wide(a), wide(b)) for a, b in (("s1", "e1"), ("s2", "e2"), ("len1", "len2"))]
    percents = F.concat_ws(" ", *[F.lpad(fixed(F.col(c)), 8, " ") for c in ("idy", "sim", "stp") if c in shown.columns])
    more = [F.concat_ws(" ", wide(a), wide(b)) for a, b in (("ref_len", "qry_len"),) if a in shown.columns]
    return shown.select("aln_id", F.concat_ws("  | ", *pairs, percents, *more, F.concat_ws("\t", "ref_id", "qry_id")).alias("line"))


def btab_lines(rows: DataFrame) -> DataFrame:
    """The 21 tab-separated columns of match reports: query first, its ends always ascending, strand words last."""
    nothing = F.lit("")
    cells = [F.col("qry_id"), F.lit(""), F.col("qry_len"), F.col("data_type"), nothing, F.col("ref_id"), F.col("s2"), F.col("e2"), F.col("s1"), F.col("e1"), fixed(F.col("idy"), 6), fixed(F.col("sim"), 6), F.abs(F.col("e2") - F.col("s2")) + 1, nothing, nothing, nothing, nothing, F.when(F.col("dir2") > 0, "Plus").otherwise("Minus"), F.col("ref_len"), nothing, nothing]
    return rows.select("aln_id", F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("line"))


def snp_lines(found: DataFrame) -> DataFrame:
    return found.select("aln_id", "p1", _text("p1", "sub_r", "sub_q", "p2", "buff", "dist", "con_r", "con_q", "ref_id", "qry_id", sep="\t").alias("line"))


def snp_table(found: DataFrame) -> DataFrame:
    """Differences for people to read: places around the two letters, distances and names between bars."""
    places = F.concat(F.lpad(F.col("p1").cast("string"), 8, " "), F.lit("   "), "sub_r", F.lit(" "), "sub_q", F.lit("   "), F.rpad(F.col("p2").cast("string"), 8, " "))
    distances = F.concat_ws(" ", F.lpad(F.col("buff").cast("string"), 6, " "), F.lpad(F.col("dist").cast("string"), 6, " "))
    return found.select("aln_id", "p1", F.concat_ws("  | ", places, distances, F.concat_ws("\t", "ref_id", "qry_id")).alias("line"))


def feature_lines(features: DataFrame, bare: bool = False) -> DataFrame:
    """Breakpoint rows; ``bare``: only name, kind and ends, for feature files."""
    if bare:
        return features.select("seq_id", "start", _text("seq_id", "type", "start", "end", sep="\t").alias("line"))
    extra = F.when(F.col("type") == "GAP", _text("len2", "diff", sep="\t")).when(F.col("type") == "SEQ", _text("prev_seq", "next_seq", sep="\t"))
    return features.select("seq_id", "start", F.concat_ws("\t", _text("seq_id", "type", "start", "end", "len", sep="\t"), extra).alias("line"))


def tiling_lines(tiles: DataFrame) -> DataFrame:
    gap = F.coalesce(F.col("gap").cast("string"), F.lit("-"))
    return tiles.select("ref_id", "start", _text(F.col("start"), F.col("end"), gap, F.col("len"), fixed(F.col("cov")), fixed(F.col("idy")), F.col("ori"), F.col("qry_id"), sep="\t").alias("line"))


def tiling_xml(tiles: DataFrame) -> DataFrame:
    """``ref_id, line``: a contig link for each tile and the next one, with the distance between them."""
    from pyspark.sql import Window

    order = Window.partitionBy("ref_id").orderBy("start", "end")
    nxt = tiles.withColumn("_q", F.lead("qry_id").over(order)).withColumn("_o", F.lead("ori").over(order)).filter("_q IS NOT NULL")
    ori = lambda c: F.when(F.col(c) == "+", "BE").otherwise("EB")
    return nxt.select("ref_id", "start", F.concat(F.lit('<CONTIGLINK><GAP SIZE="'), F.col("gap").cast("string"), F.lit('"/><CONTIG ID="'), F.col("qry_id"), F.lit('" ORI="'), ori("ori"), F.lit('"/><CONTIG ID="'), F.col("_q"), F.lit('" ORI="'), ori("_o"), F.lit('"/></CONTIGLINK>')).alias("line"))


def sam_header(refs: DataFrame) -> DataFrame:
    return refs.select("seq_id", F.concat(F.lit("@SQ\tSN:"), F.col("seq_id"), F.lit("\tLN:"), F.col("len").cast("string")).alias("line"))


def sam_lines(rows: DataFrame, long: bool = False, queries: DataFrame | None = None) -> DataFrame:
    """SAM rows of alignments with ``cigar, md, nm``. The first of a pair is primary; later ones are supplementary.

    ``long``: with the query's letters, on the strand of the alignment.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("ref_id", "qry_id").orderBy(F.col("errors"), "aln_id"))
    several = F.count(F.lit(1)).over(Window.partitionBy("ref_id", "qry_id"))
    rows = rows.withColumn("_n", rank).withColumn("_k", several)
    flag = F.when(F.col("dir2") < 0, 0x10).otherwise(0) + F.when(F.col("_n") > 1, 0x800).otherwise(0)
    letters = F.lit("*")
    if long:
        rows = rows.join(queries.select(F.col("seq_id").alias("qry_id"), F.col("seq").alias("_s")), "qry_id")
        letters = F.when(F.col("dir2") < 0, F.reverse(F.translate("_s", "acgt", "tgca"))).otherwise(F.col("_s"))
    cells = [F.col("qry_id"), flag, F.col("ref_id"), F.least("s1", "e1"), F.when(F.col("_k") > 1, 10).otherwise(30), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), letters, F.lit("*"), F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.concat(F.lit("MD:Z:"), F.col("md"))]
    return rows.select("aln_id", _text(*cells, sep="\t").alias("line"))


def vcf_header(spark, refs: DataFrame) -> DataFrame:
    """Header lines; the contig lines come from the reference's sizes."""
    fixed_lines = [(0, "##fileformat=VCFv4.2"), (2, '##INFO=<ID=DP,Number=1,Type=Integer,Description="Alignments at the place">'), (3, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")]
    contigs = refs.select(F.lit(1).alias("n"), F.concat(F.lit("##contig=<ID="), F.col("seq_id"), F.lit(",length="), F.col("len").cast("string"), F.lit(">")).alias("line"))
    return spark.createDataFrame(fixed_lines, "n int, line string").unionByName(contigs)


def vcf_lines(variants: DataFrame) -> DataFrame:
    return variants.select("chrom", "pos", _text(F.col("chrom"), F.col("pos"), F.lit("."), F.col("ref"), F.col("alt"), F.lit("."), F.lit("PASS"), F.lit("."), sep="\t").alias("line"))


def report_lines(report: DataFrame) -> DataFrame:
    return report.select("section", "metric", F.concat(F.rpad("section", 20, " "), F.rpad("metric", 28, " "), F.col("value").cast("string")).alias("line"))


def plot_series(rows: DataFrame, refs: DataFrame, queries: DataFrame, least_identity: float = 0.0) -> DataFrame:
    """``series, x1, y1, x2, y2, similarity``: forward and reverse segments on axes of sequences laid end to end."""
    from helixframe.operators.structure import offsets

    axis = lambda s, name: offsets(s).select(F.col("seq_id").alias(name), F.col("offset").alias(f"_{name}"))
    rows = rows.filter(F.col("idy") >= least_identity).join(axis(refs, "ref_id"), "ref_id").join(axis(queries, "qry_id"), "qry_id")
    return rows.select(F.when(F.col("dir2") > 0, "forward").otherwise("reverse").alias("series"), (F.col("_ref_id") + F.col("s1")).alias("x1"), (F.col("_qry_id") + F.col("s2")).alias("y1"), (F.col("_ref_id") + F.col("e1")).alias("x2"), (F.col("_qry_id") + F.col("e2")).alias("y2"), F.col("sim").alias("similarity"))


def coverage_series(rows: DataFrame) -> DataFrame:
    """``series, x1, y1, x2, y2``: each alignment at its height of identity, along the reference."""
    return rows.select(F.when(F.col("dir2") > 0, "forward").otherwise("reverse").alias("series"), "ref_id", F.col("lo1").alias("x1"), F.col("idy").alias("y1"), F.col("hi1").alias("x2"), F.col("idy").alias("y2"))


def layout(rows: DataFrame) -> DataFrame:
    """``qry_id, ref_id, rank, reverse``: queries in the order of their longest alignments along the references, turned where these run backwards."""
    from pyspark.sql import Window

    size = F.col("hi1") - F.col("lo1") + 1
    best = Window.partitionBy("qry_id").orderBy(size.desc(), "ref_id", "lo1", "aln_id")
    main = rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return main.select("qry_id", "ref_id", F.row_number().over(Window.partitionBy("ref_id").orderBy("lo1", "qry_id")).alias("rank"), (F.col("dir2") < 0).alias("reverse"))
