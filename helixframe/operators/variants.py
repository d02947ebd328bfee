"""What differs inside alignments: substitutions and indels, CIGAR, MD, variants, displays.

Everything walks the expansion of an alignment: its two sequences with gaps where the deltas say.
It is made in batches next to the sequences; positions, neighbours and conflicts are windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import compatible, revcomp
from helixframe.operators.intervals import at_positions

#: Where a sequence has no letter: half a character, which no text can hold, so that a dash in a text is a letter. Written as a dash.
GAP = "\ud800"


def upper(text: str) -> str:
    """In upper case, letter by letter: one whose upper case is several letters (ß) stays."""
    return "".join([u if len(u := c.upper()) == 1 else c for c in text]) if len(whole := text.upper()) != len(text) else whole


def expand(ref: str, qry: str, deltas: list[int]) -> tuple[str, str]:
    """The two stretches with gaps: +d ends in a base that only ``ref`` has, -d in one that only ``qry`` has."""
    one, two, i, j = [], [], 0, 0
    for d in deltas:
        step = abs(d) - 1
        one.append(ref[i : i + step])
        two.append(qry[j : j + step])
        i, j = i + step, j + step
        if d > 0:
            one.append(ref[i])
            two.append(GAP)
            i += 1
        else:
            one.append(GAP)
            two.append(qry[j])
            j += 1
    rest = max(len(ref) - i, len(qry) - j)
    return "".join(one) + ref[i : i + rest], "".join(two) + qry[j : j + rest]


def contract(one: str, two: str) -> list[int]:
    """The deltas of an expansion."""
    out, run = [], 1
    for a, b in zip(one, two, strict=True):
        if a == GAP or b == GAP:
            out.append(-run if a == GAP else run)
            run = 1
        else:
            run += 1
    return out


def stretch(seq: str, start: int, end: int) -> str:
    """The bases from ``start`` to ``end``, of the reverse complement where start lies beyond end."""
    return seq[start - 1 : end] if start <= end else revcomp(seq[end - 1 : start])


def with_sequences(rows: DataFrame, refs: DataFrame, queries: DataFrame) -> DataFrame:
    """Add ``ref_seq`` and ``qry_seq``: the aligned stretches, cut out before they are moved on."""
    cut = lambda seq, s, e: F.substring(seq, F.least(s, e).cast("int"), (F.abs(F.col(e) - F.col(s)) + 1).cast("int"))
    turned = lambda x: F.reverse(F.translate(x, "acgtryswmkbdhvACGTRYSWMKBDHV", "tgcayrswkmvhdbTGCAYRSWKMVHDB"))
    for k, seqs, key, name in (("1", refs, "ref_id", "ref_seq"), ("2", queries, "qry_id", "qry_seq")):
        part = cut("_whole", f"s{k}", f"e{k}")
        met = rows.join(seqs.select(F.col("seq_id").alias(key), F.col("seq").alias("_whole")), key)
        rows = met.withColumn(name, F.when(F.col(f"s{k}") <= F.col(f"e{k}"), part).otherwise(turned(part))).drop("_whole")
    return rows


DIFFERENCES = "aln_id long, ref_id string, qry_id string, p1 long, p2 long, sub_r string, sub_q string, col long, ctx_r string, ctx_q string"


def differences(rows: DataFrame, context: int = 0) -> DataFrame:
    """A row for each column that differs; ``rows`` have ``ref_seq`` and ``qry_seq``.

    Letters that may be the same base are no difference. ``p1, p2`` are forward-strand positions,
    at a gap those of the base before; ``sub_r, sub_q`` are upper-case bases or ``.``; contexts are
    padded with ``-`` at the alignment's ends.
    """
    columns = ["aln_id", "ref_id", "qry_id", "s1", "e1", "s2", "e2", "deltas", "ref_seq", "qry_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for aln, ref, qry, s1, e1, s2, e2, deltas, r, q in zip(*[b.column(i).to_pylist() for i in range(len(columns))], strict=True):
                one, two = expand(r, q, deltas)
                d1, d2 = (1 if s1 <= e1 else -1), (1 if s2 <= e2 else -1)
                p1, p2 = s1 - d1, s2 - d2
                edge = GAP * context
                for k, (x, y) in enumerate(zip(one, two, strict=True)):
                    p1 += d1 * (x != GAP)
                    p2 += d2 * (y != GAP)
                    if x == GAP or y == GAP or not compatible(x, y):
                        around = [upper((edge + t + edge)[k : k + 2 * context + 1]).replace(GAP, "-") if context else "" for t in (one, two)]
                        out.append((aln, ref, qry, p1, p2, "." if x == GAP else upper(x), "." if y == GAP else upper(y), k, *around))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in out], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in DIFFERENCES.split(", ")])

    return rows.select(*columns).mapInArrow(run, DIFFERENCES)


def snps(differing: DataFrame, rows: DataFrame, side: str = "reference") -> DataFrame:
    """Add ``buff`` (distance along ``side`` to the nearest other difference, or to what lies beyond the alignment's end), ``dist`` (to the nearest sequence end) and the conflicts ``con_r, con_q`` (other alignments at the place)."""
    p, k = ("p1", "1") if side == "reference" else ("p2", "2")
    ends = rows.select("aln_id", "s1", "e1", "s2", "e2", "ref_len", "qry_len")
    step = Window.partitionBy("aln_id").orderBy(*(["p1", "p2"] if side == "reference" else ["p2", "p1"]), "col")
    near = differing.withColumn("_a", F.lag(p).over(step)).withColumn("_z", F.lead(p).over(step)).join(ends, "aln_id")
    lo, hi = F.least(f"s{k}", f"e{k}"), F.greatest(f"s{k}", f"e{k}")
    near = near.withColumn("buff", F.least(F.col(p) - lo + 1, hi - F.col(p) + 1, F.col(p) - F.col("_a"), F.col("_z") - F.col(p)))
    near = near.withColumn("dist", F.least("p1", F.col("ref_len") - F.col("p1") + 1, "p2", F.col("qry_len") - F.col("p2") + 1)).drop("_a", "_z", "s1", "e1", "s2", "e2", "ref_len", "qry_len")
    sides = rows.withColumn("_l1", F.least("s1", "e1")).withColumn("_h1", F.greatest("s1", "e1")).withColumn("_l2", F.least("s2", "e2")).withColumn("_h2", F.greatest("s2", "e2"))
    near = at_positions(near, sides.select("ref_id", "_l1", "_h1"), ["ref_id"], "p1", "_l1", "_h1", "con_r")
    near = at_positions(near, sides.select("qry_id", "_l2", "_h2"), ["qry_id"], "p2", "_l2", "_h2", "con_q")
    return near.withColumn("con_r", F.col("con_r") - 1).withColumn("con_q", F.col("con_q") - 1)


def sorted_snps(found: DataFrame, side: str = "reference") -> DataFrame:
    """By reference and place, then query and place, or the other way round."""
    keys = ["ref_id", "p1", "qry_id", "p2"]
    return found.orderBy(*(keys if side == "reference" else keys[2:] + keys[:2]), "col")


def unambiguous(found: DataFrame) -> DataFrame:
    return found.filter("con_r = 0 AND con_q = 0")


def without_indels(found: DataFrame) -> DataFrame:
    return found.filter("sub_r != '.' AND sub_q != '.'")


def runs(one: str, two: str) -> list[tuple[str, int]]:
    """Operations of an expansion: M for columns with two bases, D and I for those with one."""
    out: list[list] = []
    for a, b in zip(one, two, strict=True):
        op = "I" if a == GAP else "D" if b == GAP else "M"
        if out and out[-1][0] == op:
            out[-1][1] += 1
        else:
            out.append([op, 1])
    return [tuple(x) for x in out]


def cigar(one: str, two: str, before: int = 0, after: int = 0, hard: bool = False) -> str:
    """Operations with clipped ends: ``before`` and ``after`` query bases lie outside."""
    clip = "H" if hard else "S"
    return (f"{before}{clip}" if before else "") + "".join(f"{n}{op}" for op, n in runs(one, two)) + (f"{after}{clip}" if after else "")


def md(one: str, two: str) -> str:
    """The reference's bases where the query differs or lacks them, between counts of equal columns."""
    out, same, deleting = [], 0, False
    for a, b in zip(upper(one), upper(two), strict=True):
        if a == GAP:
            continue
        if b == GAP:
            out.append(a if deleting else f"{same}^{a}")
            same, deleting = 0, True
            continue
        if a == b:
            same += 1
        else:
            out.append(f"{same}{a}")
            same = 0
        deleting = False
    return "".join(out) + str(same)


def replay(text: str, ref: str, qry: str) -> tuple[int, int, int]:
    """Reference bases, query bases and differing columns of a CIGAR run over its stretches; clips are skipped."""
    import re

    i = j = off = 0
    for n, op in re.findall(r"(\d+)([MIDSH])", text):
        n = int(n)
        if op == "M":
            off += sum(a != b for a, b in zip(ref[i : i + n], qry[j : j + n], strict=True))
            i, j = i + n, j + n
        elif op == "I":
            j, off = j + n, off + n
        elif op == "D":
            i, off = i + n, off + n
    return i, j, off


def sam_columns(rows: DataFrame, hard: bool = False) -> DataFrame:
    """Add ``cigar, md, nm`` for rows with ``ref_seq`` and ``qry_seq``; clips count on the strand of the alignment."""
    @F.pandas_udf("struct<cigar: string, md: string, nm: long>")
    def made(ref: pd.Series, qry: pd.Series, deltas: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for r, q, d, b, a in zip(ref, qry, deltas, before, after, strict=True):
            one, two = expand(r, q, list(d))
            out.append((cigar(one, two, b, a, hard), md(one, two), sum(x.upper() != y.upper() for x, y in zip(one, two, strict=True))))
        return pd.DataFrame(out, columns=["cigar", "md", "nm"])

    forward = F.col("s2") <= F.col("e2")
    before = F.when(forward, F.col("s2") - 1).otherwise(F.col("qry_len") - F.col("s2"))
    after = F.when(forward, F.col("qry_len") - F.col("e2")).otherwise(F.col("e2") - 1)
    return rows.withColumn("_m", made("ref_seq", "qry_seq", "deltas", before, after)).select(*rows.columns, "_m.cigar", "_m.md", "_m.nm")


def vcf_rows(differing: DataFrame, refs: DataFrame) -> DataFrame:
    """``chrom, pos, ref, alt``: neighbouring indel columns of one kind are one variant, anchored at the base before; one row a place, the first by alignment."""
    rows = differing.withColumn("kind", F.when(F.col("sub_r") == ".", "I").when(F.col("sub_q") == ".", "D").otherwise("S"))
    step = Window.partitionBy("aln_id", "kind").orderBy("col")
    rows = rows.withColumn("_run", F.when(F.col("kind") == "S", F.col("col")).otherwise(F.col("col") - F.row_number().over(step)))
    whole = rows.groupBy("ref_id", "aln_id", "kind", "_run").agg(F.min("p1").alias("p1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "sub_r"))), lambda x: x["sub_r"]), "").alias("r"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "sub_q"))), lambda x: x["sub_q"]), "").alias("q"))
    whole = whole.withColumn("pos", F.when(F.col("kind") == "D", F.col("p1") - 1).otherwise(F.col("p1")))
    letter = F.substring(F.col("seq"), F.col("pos").cast("int"), F.lit(1))
    base = F.when(F.length(F.upper(letter)) > 1, letter).otherwise(F.upper(letter))
    at = whole.join(refs.select(F.col("seq_id").alias("ref_id"), "seq"), "ref_id").withColumn("base", base).drop("seq")
    ref = F.when(F.col("kind") == "S", F.col("r")).when(F.col("kind") == "D", F.concat("base", "r")).otherwise(F.col("base"))
    alt = F.when(F.col("kind") == "S", F.col("q")).when(F.col("kind") == "I", F.concat("base", "q")).otherwise(F.col("base"))
    first = Window.partitionBy("ref_id", "pos").orderBy("aln_id", "kind")
    return at.select(F.col("ref_id").alias("chrom"), "pos", ref.alias("ref"), alt.alias("alt"), F.row_number().over(first).alias("_n")).filter("_n = 1").drop("_n")


def display(rows: DataFrame, width: int = 60) -> DataFrame:
    """``aln_id, lines``: the two expansions in blocks with their positions and a line of marks under what differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for _, s1, e1, s2, e2, deltas, r, q in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                one, two = expand(r, q, deltas)
                p1, p2, lines = s1, s2, []
                for at in range(0, len(one), width):
                    x, y = one[at : at + width], two[at : at + width]
                    marks = "".join(" " if c != GAP and d != GAP and compatible(c, d) else "^" for c, d in zip(x, y, strict=True))
                    lines += [f"{p1:<10d} {x}".replace(GAP, "-"), f"{p2:<10d} {y}".replace(GAP, "-"), f"{'':<10s} {marks}"]
                    p1 += (len(x) - x.count(GAP)) * (1 if s1 <= e1 else -1)
                    p2 += (len(y) - y.count(GAP)) * (1 if s2 <= e2 else -1)
                made.append(lines)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["aln_id", "lines"])

    return rows.select("aln_id", "s1", "e1", "s2", "e2", "deltas", "ref_seq", "qry_seq").mapInArrow(run, "aln_id long, lines array<string>")


def errors(one: str, two: str) -> tuple[int, int, int]:
    """Differing columns, columns whose score isn't positive, and stop or other non-letters, of an expansion."""
    off = sum(a == GAP or b == GAP or a.lower() != b.lower() for a, b in zip(one, two, strict=True))
    similar = sum(a == GAP or b == GAP or a.lower() != b.lower() or a.lower() not in "acgt" for a, b in zip(one, two, strict=True))
    odd = sum((a != GAP and not a.isalpha()) + (b != GAP and not b.isalpha()) for a, b in zip(one, two, strict=True))
    return off, similar, odd
