"""Six-frame protein comparison of nucleotide sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.deploy import written
from helixframe.functions.sequence import mask_short_orfs, protein_to_dna, translate_frame
from helixframe.operators import matches
from helixframe.operators.cluster import clusters
from helixframe.operators.extend import PROTEIN, Options, extend
from helixframe.operators.groups import tasks_of
from helixframe.sources.alignments import with_bounds, with_identity


def frames(seqs: DataFrame, least_orf: int = 8, masked: str = "X", mask: bool = True) -> DataFrame:
    """``seq_id, frame, seq, len`` of the six translations; short open frames are masked, stops become J."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, f, mask_short_orfs(p, least_orf, masked) if mask else p) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in range(1, 7) for p in (translate_frame(s, f),)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string()), pa.array([len(r[2]) for r in out], pa.int64())], names=["seq_id", "frame", "seq", "len"])

    return seqs.select("seq_id", F.coalesce("seq", F.lit("")).alias("seq")).mapInArrow(run, "seq_id string, frame int, seq string, len long")


def _keyed(f: DataFrame) -> DataFrame:
    return f.select(F.concat_ws("|", "seq_id", F.col("frame").cast("string")).alias("seq_id"), "seq", "len")


def align_protein(refs: DataFrame, queries: DataFrame, options: Options = PROTEIN, least_orf: int = 8) -> DataFrame:
    """Alignments of all frames against all frames, coordinates on the DNA; masked residues of the two sides differ, so they never match. Identity, similarity and stops are counted in amino acids, by the options' matrix."""
    o = replace(options, strand="forward", text=True)
    ours, theirs = _keyed(frames(refs, least_orf, "X")), _keyed(frames(queries.repartition(tasks_of(queries), "seq_id"), least_orf, "O"))
    found = matches.maximal_matches(ours, theirs, o.min_match)
    chained = written(clusters(found.filter("len > 1"), o.max_gap, o.min_cluster, o.diagonal, o.factor), "clusters")
    # only what has clusters is translated again
    chosen = lambda seqs, c: seqs.join(chained.select(F.regexp_replace(c, r"\|\d$", "").alias("seq_id")).distinct(), "seq_id", "left_semi")
    # masked frames seed; alignments grow through the unmasked ones, where stops are letters like any other
    rows = extend(chained, _keyed(frames(chosen(refs, "ref_id"), mask=False)), _keyed(frames(chosen(queries, "qry_id"), mask=False)), o)
    part = lambda c, i: F.element_at(F.split(c, r"\|"), i)
    rows = rows.withColumn("frame1", part("ref_id", -1).cast("int")).withColumn("frame2", part("qry_id", -1).cast("int"))
    rows = rows.withColumn("ref_id", F.regexp_replace("ref_id", r"\|\d$", "")).withColumn("qry_id", F.regexp_replace("qry_id", r"\|\d$", "")).drop("ref_len", "qry_len")
    rows = rows.join(refs.select(F.col("seq_id").alias("ref_id"), F.col("len").alias("ref_len")), "ref_id").join(queries.select(F.col("seq_id").alias("qry_id"), F.col("len").alias("qry_len")), "qry_id")

    def ends(start: str, end: str, frame: str, length: str):
        turned = F.col(frame) > 3
        last = protein_to_dna(F.col(end), F.col(frame), F.col(length))
        return protein_to_dna(F.col(start), F.col(frame), F.col(length)), F.when(turned, last - 2).otherwise(last + 2)

    s1, e1 = ends("s1", "e1", "frame1", "ref_len")
    s2, e2 = ends("s2", "e2", "frame2", "qry_len")
    rows = rows.withColumns({"s1": s1, "e1": e1, "s2": s2, "e2": e2, "data_type": F.lit("protein")})
    return with_bounds(with_identity(rows))
