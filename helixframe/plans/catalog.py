"""Registered queries and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as fn
from helixframe.operators import aggregates, coords, filters, intervals, matches, structure
from helixframe.sources.alignments import FROM_LINEITEM_SQL, from_lineitem, with_bounds, with_identity
from helixframe.sources.sequences import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Letters of the shortest match of whole texts, and of DNA made of them.
TEXT_MATCH, DNA_MATCH = 30, 24


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bounds(with_identity(from_lineitem(spark, sf_dir)))


ALN = "WITH " + FROM_LINEITEM_SQL
DNA = "translate(regexp_replace(lower({0}), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')"
REVCOMP = "translate(reverse({0}), 'acgt', 'tgca')"


def _mem_sql(length: int, refs: str, queries: str) -> str:
    """Maximal matches as islands of equal windows on a diagonal; ``refs`` give id, seq and ``queries`` id, strand, seq."""
    return f"""
    WITH r AS MATERIALIZED ({refs}), q AS MATERIALIZED ({queries}),
    rk AS (SELECT id, p AS s1, substring(seq, p, {length}) AS k FROM (SELECT id, seq, unnest(range(1, length(seq) - {length} + 2)) AS p FROM r)),
    qk AS (SELECT id, strand, p AS s2, substring(seq, p, {length}) AS k FROM (SELECT id, strand, seq, unnest(range(1, length(seq) - {length} + 2)) AS p FROM q)),
    hits AS (SELECT rk.id AS ref_id, qk.id AS qry_id, strand, s1, s2, s1 - s2 AS diagonal FROM rk JOIN qk USING (k)),
    runs AS (SELECT *, s1 - row_number() OVER (PARTITION BY ref_id, qry_id, strand, diagonal ORDER BY s1) AS run FROM hits),
    mem AS (SELECT ref_id, qry_id, strand, min(s1) AS s1, min(s2) AS s2, count(*) + {length} - 1 AS len FROM runs GROUP BY ref_id, qry_id, strand, diagonal, run)
    """


_TEXTS = (TEXT_MATCH, "SELECT item_id::VARCHAR AS id, lower(text) AS seq FROM benchmark", "SELECT doc_id::VARCHAR AS id, 1 AS strand, lower(text) AS seq FROM documents")
_MEM_OUT = "SELECT ref_id, qry_id, strand, s1, s2, len FROM "
_IN_REF = "NOT EXISTS (SELECT 1 FROM mem b WHERE b.qry_id = a.qry_id AND b.strand = a.strand AND b.s2 <= a.s2 AND b.s2 + b.len >= a.s2 + a.len AND (b.ref_id, b.s1, b.s2, b.len) IS DISTINCT FROM (a.ref_id, a.s1, a.s2, a.len))"
_IN_QRY = "NOT EXISTS (SELECT 1 FROM mem b WHERE b.qry_id = a.qry_id AND b.strand = a.strand AND b.ref_id = a.ref_id AND b.s1 <= a.s1 AND b.s1 + b.len >= a.s1 + a.len AND (b.s1, b.s2, b.len) IS DISTINCT FROM (a.s1, a.s2, a.len))"


def _text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.maximal_matches(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), TEXT_MATCH)


@query(_mem_sql(*_TEXTS) + _MEM_OUT + "mem")
def mem_benchmark_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_matches(spark, sf_dir)


@query(_mem_sql(*_TEXTS) + _MEM_OUT + f"mem a WHERE {_IN_REF}")
def mam_benchmark_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.reference_unique(_text_matches(spark, sf_dir))


@query(_mem_sql(*_TEXTS) + _MEM_OUT + f"mem a WHERE {_IN_REF} AND {_IN_QRY}")
def mum_benchmark_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.unique_matches(_text_matches(spark, sf_dir))


_STRANDS = (
    DNA_MATCH,
    f"SELECT item_id::VARCHAR AS id, {DNA.format('text')} AS seq FROM benchmark",
    f"SELECT doc_id::VARCHAR AS id, strand, CASE WHEN strand > 0 THEN d ELSE {REVCOMP.format('d')} END AS seq FROM (SELECT doc_id, {DNA.format('text')} AS d FROM documents), (VALUES (1), (-1)) s(strand)",
)


@query(_mem_sql(*_STRANDS) + "SELECT ref_id, qry_id, strand, s1, CASE WHEN strand < 0 THEN length(d.seq) - s2 + 1 ELSE s2 END AS s2, len FROM mem JOIN (SELECT id, seq FROM q WHERE strand > 0) d ON d.id = qry_id")
def mem_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", dna=True)
    found = matches.maximal_matches(table(spark, sf_dir, "benchmark", dna=True), docs, DNA_MATCH, "both")
    return matches.on_forward_strand(found, docs)


@query(_mem_sql(TEXT_MATCH, "SELECT item_id::VARCHAR AS id, lower(text) AS seq FROM benchmark", "SELECT item_id::VARCHAR AS id, 1 AS strand, lower(text) AS seq FROM benchmark") + "SELECT ref_id, qry_id, strand, s1, s2, len FROM mem")
def mem_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of window hashes that a large reference takes, of the benchmark with itself."""
    items = table(spark, sf_dir, "benchmark")
    return matches.maximal_matches(items, items, TEXT_MATCH, broadcast_letters=0)


_REPEATS = (12, f"SELECT item_id::VARCHAR AS id, {DNA.format('text')} AS seq FROM benchmark", f"SELECT item_id::VARCHAR AS id, 1 AS strand, {DNA.format('text')} AS seq FROM benchmark")


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.self_repeats(table(spark, sf_dir, "benchmark", dna=True), 12)


@query(_mem_sql(*_REPEATS).replace("FROM rk JOIN qk USING (k)", "FROM rk JOIN qk USING (k) WHERE rk.id = qk.id AND s1 < s2") + "SELECT ref_id AS seq_id, strand, s1, s2, len FROM mem")
def self_repeats_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir)


_TANDEM_SRC = "SELECT {0}::VARCHAR AS id, {1} seq FROM (SELECT p_partkey, repeat(substr(p_type, 1, 1 + (p_partkey % 4)::INT), 3 + (p_partkey % 5)::INT) || p_name AS t FROM part)"


@query(_mem_sql(6, _TANDEM_SRC.format("p_partkey", "lower(t) AS"), _TANDEM_SRC.format("p_partkey", "1 AS strand, lower(t) AS")).replace("FROM rk JOIN qk USING (k)", "FROM rk JOIN qk USING (k) WHERE rk.id = qk.id AND s1 < s2")
       + "SELECT seq_id, start, extent, unit, extent / unit AS copies FROM (SELECT ref_id AS seq_id, s1 AS start, s2 + len - s1 AS extent, s2 - s1 AS unit, row_number() OVER (PARTITION BY ref_id, s1 ORDER BY s2) AS n FROM mem WHERE s1 + len >= s2) WHERE n = 1")
def exact_tandems_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.lower(F.concat(F.expr("repeat(substring(p_type, 1, cast(1 + p_partkey % 4 AS int)), cast(3 + p_partkey % 5 AS int))"), F.col("p_name")))
    seqs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("seq_id"), made.alias("seq"))
    return matches.exact_tandems(matches.self_repeats(seqs, 6))


@query(f"SELECT doc_id::VARCHAR AS seq_id, length(d) AS len, {REVCOMP.format('d')} AS rc FROM (SELECT doc_id, {DNA.format('text')} AS d FROM documents)")
def revcomp_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", dna=True).select("seq_id", "len", fn.reverse_complement(F.col("seq")).alias("rc"))


@query("SELECT item_id::VARCHAR AS seq_id, regexp_replace(lower(regexp_replace(text, '\\s', '', 'g')), '[^a-z*]', 'x', 'g') AS letters, regexp_replace(lower(text), '[^acgt]', '~', 'g') AS bases FROM benchmark")
def cleaned_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("seq_id"), fn.clean_letters(F.col("text")).alias("letters"), fn.nucleotides_only(F.col("text")).alias("bases"))


@query("SELECT seq_id, pos FROM (SELECT doc_id::VARCHAR AS seq_id, lower(text) AS t, unnest(range(1, length(text) - 2)) AS pos FROM documents) WHERE substring(t, pos, 4) = 'the '")
def find_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.find(table(spark, sf_dir, "documents"), "the ")


_TWO = "(floor({0} * 100 + 0.5::DOUBLE) / 100)"
_SHOWN = _TWO.format("(CASE WHEN {0} > 99.99 AND {1} <> 0 THEN 99.99::DOUBLE WHEN {0} < 0.01 AND {0} > 0 THEN 0.01::DOUBLE ELSE {0} END)")


@query(ALN + f"SELECT aln_id, s1, e1, s2, e2, abs(e1 - s1) + 1 AS len1, abs(e2 - s2) + 1 AS len2, {_SHOWN.format('idy', 'errors')} AS idy, {_SHOWN.format('sim', 'sim_errors')} AS sim, {_TWO.format('stp')} AS stp, ref_len, qry_len, {_TWO.format('((abs(e1 - s1) + 1) * 100.0::DOUBLE / ref_len)')} AS cov1, {_TWO.format('((abs(e2 - s2) + 1) * 100.0::DOUBLE / qry_len)')} AS cov2, dir1 AS frm1, dir2 AS frm2, ref_id, qry_id FROM b")
def coords_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coords.coords(_alignments(spark, sf_dir), protein=True, coverage=True, lengths=True)
    ways = _alignments(spark, sf_dir).select("aln_id", F.col("dir1").alias("frm1"), F.col("dir2").alias("frm2"))
    return rows.join(ways, "aln_id")


@query(ALN + f"SELECT aln_id, s1, e1, s2, e2, abs(e1 - s1) + 1 AS len1, abs(e2 - s2) + 1 AS len2, {_SHOWN.format('idy', 'errors')} AS idy, ref_id, qry_id FROM b WHERE idy >= 97.5 AND greatest(abs(e1 - s1) + 1, abs(e2 - s2) + 1) >= 500")
def coords_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.coords(coords.selected(_alignments(spark, sf_dir), 97.5, 500))


@query(ALN + "SELECT min(aln_id) AS aln_id, s1, e1, s2, e2, ref_id, qry_id FROM b WHERE idy >= 97.5 GROUP BY s1, e1, s2, e2, ref_id, qry_id")
def coords_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alignments(spark, sf_dir)
    bar = F.when(F.col("aln_id") % 2 == 0, " | ").otherwise("  ")
    lines = rows.filter("idy >= 97.5").select(F.concat("s1", F.lit(" "), "e1", bar, "s2", F.lit(" "), "e2", F.when(F.col("aln_id") % 3 == 0, F.concat(F.lit(" | "), F.col("idy").cast("string"), F.lit(" |"))).otherwise(""), F.lit("\t"), "ref_id", F.lit("\t"), "qry_id").alias("value"))
    return coords.listed(rows, lines).select("aln_id", "s1", "e1", "s2", "e2", "ref_id", "qry_id")


@query(ALN + "SELECT aln_id, CASE WHEN dir2 > 0 THEN (s2 + 2) % 3 + 1 ELSE -((qry_len - s2) % 3 + 1) END AS frm2, (s1 + 2) % 3 + 1 AS frm1 FROM b")
def coords_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir).select("aln_id", coords.frame(True, "2").alias("frm2"), coords.frame(True, "1").alias("frm1"))


@query(ALN + """SELECT aln_id, CASE WHEN NOT ((x1 OR x2) AND (y1 OR y2)) THEN '' WHEN x1 AND x2 AND y1 AND y2 THEN '[IDENTITY]' WHEN x1 AND y1 THEN '[CONTAINED]' WHEN x2 AND y2 THEN '[CONTAINS]' WHEN x2 THEN '[END]' ELSE '[BEGIN]' END AS annot
FROM (SELECT aln_id, lo1 <= hang AS x1, l2 <= hang AS x2, hi1 + hang > ref_len AS y1, h2 + hang > qry_len AS y2 FROM (SELECT *, floor(0.05::DOUBLE * (greatest(hi1 - lo1, h2 - l2) + 1))::BIGINT AS hang FROM (
  SELECT *, CASE WHEN dir1 <> dir2 THEN qry_len - hi2 + 1 ELSE lo2 END AS l2, CASE WHEN dir1 <> dir2 THEN qry_len - lo2 + 1 ELSE hi2 END AS h2 FROM b)))""")
def overlap_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.overlap_annotation(_alignments(spark, sf_dir)).select("aln_id", "annot")


@query(ALN + """SELECT aln_id, CASE WHEN a1 IS NULL THEN '' WHEN lo1 = a1 AND lo2 = a2 AND hi1 = z1 AND hi2 = z2 THEN '[DUPLICATE]' WHEN lo1 < a1 AND lo2 < a2 AND hi1 > z1 AND hi2 > z2 THEN '[CONTAINS]'
 WHEN a1 < lo1 AND a2 < lo2 AND z1 > hi1 AND z2 > hi2 THEN '[SHADOWED]' WHEN lo1 BETWEEN a1 AND z1 OR hi1 BETWEEN a1 AND z1 OR lo2 BETWEEN a2 AND z2 OR hi2 BETWEEN a2 AND z2 THEN '[OVERLAPS]' ELSE '' END AS annot
FROM (SELECT *, lag(lo1) OVER w AS a1, lag(hi1) OVER w AS z1, lag(lo2) OVER w AS a2, lag(hi2) OVER w AS z2 FROM b WINDOW w AS (PARTITION BY ref_id, qry_id ORDER BY lo1, lo2, aln_id))""")
def conflict_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.conflict_annotation(_alignments(spark, sf_dir)).select("aln_id", "annot")


_UNION = """, o AS (SELECT {on}, {lo} AS lo, {hi} AS hi, CASE WHEN max({hi}) OVER w + {touch} < {lo} OR max({hi}) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY {on} ORDER BY {lo}, {hi}, aln_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY {on} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM o), u AS (SELECT {on}, min(lo) AS lo, max(hi) AS hi, count(*) AS members FROM g GROUP BY {on}, run)"""


@query(ALN + _UNION.format(on="ref_id, qry_id", lo="lo1", hi="hi1", touch=1) + "SELECT * FROM u")
def coverage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(_alignments(spark, sf_dir), ["ref_id", "qry_id"], "lo1", "hi1")


@query(ALN + _UNION.format(on="qry_id", lo="lo2", hi="hi2", touch=1) + "SELECT qry_id, u.covered, u.runs, extent, round(idy, 6) AS idy FROM (SELECT qry_id, sum(hi - lo + 1) AS covered, count(*) AS runs FROM u GROUP BY qry_id) u JOIN (SELECT qry_id, max(hi2) - min(lo2) + 1 AS extent, sum(idy * (hi2 - lo2 + 1)) / sum(hi2 - lo2 + 1) AS idy FROM b GROUP BY qry_id) USING (qry_id)")
def contig_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.contig_coverage(_alignments(spark, sf_dir)).withColumn("idy", F.round("idy", 6))


_DEPTH = """, e AS (SELECT {on}, place, sum(step) AS step FROM (SELECT {on}, {lo} AS place, 1 AS step FROM b UNION ALL SELECT {on}, {hi} + 1, -1 FROM b) GROUP BY {on}, place),
d AS (SELECT {on}, place AS lo, lead(place) OVER w - 1 AS hi, sum(step) OVER w AS depth FROM e WINDOW w AS (PARTITION BY {on} ORDER BY place))"""


@query(ALN + _DEPTH.format(on="ref_id, qry_id", lo="lo1", hi="hi1") + "SELECT ref_id, qry_id, lo, hi, depth FROM d WHERE depth > 0")
def coverage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.depth(_alignments(spark, sf_dir), ["ref_id", "qry_id"], "lo1", "hi1")


@query(ALN + _DEPTH.format(on="ref_id, qry_id", lo="lo1", hi="hi1") + """SELECT aln_id, sum(CASE WHEN d.lo IS NULL THEN 0 ELSE least(d.hi, b.hi1) - greatest(d.lo, b.lo1) + 1 END) AS "unique" FROM b LEFT JOIN d ON d.ref_id = b.ref_id AND d.qry_id = b.qry_id AND d.depth = 1 AND d.lo <= b.hi1 AND d.hi >= b.lo1 GROUP BY aln_id""")
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.unique_share(_alignments(spark, sf_dir), ["ref_id", "qry_id"], "lo1", "hi1").select("aln_id", "unique")


@query(ALN + "SELECT aln_id FROM b WHERE idy >= 98 AND least(hi1 - lo1, hi2 - lo2) + 1 >= 1000")
def filter_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_size(_alignments(spark, sf_dir), 98, 1000).select("aln_id")


@query(ALN + """SELECT a.aln_id, a.lo1 + a.aln_id % (a.hi1 - a.lo1 + 1) AS pos, count(*) - 1 AS con_r FROM b a JOIN b c ON c.ref_id = a.ref_id AND c.qry_id = a.qry_id AND c.lo1 <= a.lo1 + a.aln_id % (a.hi1 - a.lo1 + 1) AND c.hi1 >= a.lo1 + a.aln_id % (a.hi1 - a.lo1 + 1) GROUP BY ALL""")
def position_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other alignments cover a position of each."""
    rows = _alignments(spark, sf_dir)
    points = rows.select("aln_id", "ref_id", "qry_id", (F.col("lo1") + F.col("aln_id") % (F.col("hi1") - F.col("lo1") + 1)).alias("pos"))
    found = intervals.at_positions(points, rows.select("ref_id", "qry_id", "lo1", "hi1"), ["ref_id", "qry_id"], "pos", "lo1", "hi1", "con_r")
    return found.select("aln_id", "pos", (F.col("con_r") - 1).alias("con_r"))


@query()
def brief_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.merged(_alignments(spark, sf_dir))


@query()
def knockout_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.knockout(_alignments(spark, sf_dir)).select("aln_id")


@query(ALN + "SELECT count(DISTINCT ref_id) AS ref_nodes, count(DISTINCT qry_id) AS qry_nodes, count(DISTINCT (ref_id, qry_id)) AS edges, count(*) AS alignments FROM b")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.graph_counts(_alignments(spark, sf_dir))


#: Chain flags as columns, so that the walk has a twin in SQL.
FLAGS = "(l_orderkey + l_linenumber) % 3"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir).withColumn("is_r", F.col("aln_id") % 3 != 0).withColumn("is_q", F.col("aln_id") % 5 != 0)


_WALK = ALN + """, w0 AS (SELECT {seq} AS seq_id, {mate} AS mate, lo{a} AS lo, hi{a} AS hi, lo{b} AS mlo, hi{b} AS mhi, dir1 * dir2 AS slope, aln_id % {other} <> 0 AS dual, {length} AS length, aln_id FROM b WHERE aln_id % {mine} <> 0),
w1 AS (SELECT *, CASE WHEN dual THEN row_number() OVER (PARTITION BY seq_id, mate, dual ORDER BY mlo, mhi, aln_id) END AS rank, 1 AS pad FROM w0),
ends AS (SELECT {seq} AS seq_id, max({length}) AS length FROM b GROUP BY ALL),
w2 AS (SELECT seq_id, mate, lo, hi, mlo, mhi, slope, dual, aln_id, rank, pad FROM w1 UNION ALL SELECT seq_id, NULL, 0, 0, NULL, NULL, NULL, true, NULL, NULL, 0 FROM ends UNION ALL SELECT seq_id, NULL, length + 1, length + 1, NULL, NULL, NULL, true, NULL, NULL, 2 FROM ends),
w3 AS (SELECT *, lag(hi) OVER o AS pa_hi, lag(aln_id) OVER o AS pa_id, last_value(CASE WHEN dual THEN {{'mate': mate, 'slope': slope, 'rank': rank, 'mlo': mlo, 'mhi': mhi, 'id': aln_id}} END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pg FROM w2 WINDOW o AS (PARTITION BY seq_id ORDER BY pad, lo, hi, aln_id)),
w4 AS (SELECT *, CASE WHEN pad = 2 THEN 'BRK' WHEN NOT dual THEN 'DUP' WHEN pg.mate = mate AND slope <> pg.slope THEN 'INV' WHEN pg.mate = mate AND rank <> pg.rank + pg.slope THEN 'JMP' WHEN pg.mate = mate AND pa_id IS NOT DISTINCT FROM pg.id THEN 'GAP' WHEN pg.mate = mate THEN 'BRK' WHEN pg.mate IS NOT NULL THEN 'SEQ' ELSE 'BRK' END AS kind FROM w3 WHERE pad > 0),
w5 AS (SELECT *, CASE WHEN kind = 'GAP' THEN CASE WHEN slope > 0 THEN mlo - pg.mhi - 1 ELSE pg.mlo - mhi - 1 END END AS len2 FROM w4),
w6 AS (SELECT seq_id, CASE WHEN kind = 'DUP' THEN 'BRK' ELSE kind END AS type, pa_hi + 1 AS start, lo - 1 AS "end", len2, CASE WHEN kind = 'SEQ' THEN pg.mate END AS prev_seq, CASE WHEN kind = 'SEQ' THEN mate END AS next_seq FROM w5 UNION ALL SELECT seq_id, 'DUP', lo, hi, NULL, NULL, NULL FROM w5 WHERE kind = 'DUP')
SELECT seq_id, type, start, "end", "end" - start + 1 AS len, len2, "end" - start + 1 - len2 AS diff, prev_seq, next_seq FROM w6 WHERE type <> 'BRK' OR "end" - start + 1 > 0"""


@query(_WALK.format(seq="ref_id", mate="qry_id", a=1, b=2, mine=3, other=5, length="ref_len"))
def breakpoint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.breakpoints(_flagged(spark, sf_dir), "reference")


@query(_WALK.format(seq="qry_id", mate="ref_id", a=2, b=1, mine=5, other=3, length="qry_len"))
def breakpoint_classes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.breakpoints(_flagged(spark, sf_dir), "query")


@query("SELECT sum(k) AS n, sum(len * k) AS sum, sum(len * k) / sum(k) AS avg, sum(len * len * k) / sum(len * k) AS e_size, max(CASE WHEN run >= total * 0.5 THEN len END) AS nx FROM (SELECT *, sum(len * k) OVER (ORDER BY len DESC) AS run, sum(len * k) OVER () AS total FROM (SELECT length(text) AS len, count(*) AS k FROM documents GROUP BY 1))")
def n50_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.n50(table(spark, sf_dir, "documents"))


@query(ALN + "SELECT count(*) AS alignments, sum(hi1 - lo1 + 1) AS len1, sum(hi2 - lo2 + 1) AS len2, avg(hi1 - lo1 + 1) AS avg1, avg(hi2 - lo2 + 1) AS avg2, round(sum(floor(idy * 100 + 0.5::DOUBLE) / 100 * (hi1 - lo1 + hi2 - lo2 + 2)) / sum(hi1 - lo1 + hi2 - lo2 + 2), 6) AS avg_idy FROM b")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.alignment_summary(_alignments(spark, sf_dir)).withColumn("avg_idy", F.round("avg_idy", 6))


@query(ALN + "SELECT sum((s1 NOT IN (1, ref_len))::INT + (e1 NOT IN (1, ref_len))::INT) AS breakpoints1, sum((s2 NOT IN (1, qry_len))::INT + (e2 NOT IN (1, qry_len))::INT) AS breakpoints2 FROM b")
def breakpoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.breakpoint_count(_alignments(spark, sf_dir))


@query(_WALK.format(seq="ref_id", mate="qry_id", a=1, b=2, mine=3, other=5, length="ref_len").replace("SELECT seq_id, type, start, \"end\", \"end\" - start + 1 AS len", ", f AS (SELECT seq_id, type, start, \"end\", \"end\" - start + 1 AS len") + """)
SELECT count(*) FILTER (type = 'JMP') AS relocations, count(*) FILTER (type = 'SEQ') AS translocations, count(*) FILTER (type = 'INV') AS inversions, count(*) FILTER ((type = 'GAP' AND diff > 0) OR (type <> 'GAP' AND len > 0)) AS insertions,
 coalesce(sum(CASE WHEN type = 'GAP' THEN diff ELSE len END) FILTER ((type = 'GAP' AND diff > 0) OR (type <> 'GAP' AND len > 0)), 0) AS insertion_bases, count(*) FILTER (type = 'GAP' AND len <= 0 AND diff > 0) AS tandem_insertions, coalesce(sum(diff) FILTER (type = 'GAP' AND len <= 0 AND diff > 0), 0) AS tandem_insertion_bases FROM f""")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.feature_summary(structure.breakpoints(_flagged(spark, sf_dir), "reference"))


def _documents_hit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), _text_matches(spark, sf_dir).select("ref_id", "qry_id")


@query(_mem_sql(*_TEXTS) + "SELECT doc_id::VARCHAR AS seq_id, length(text) AS len FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT qry_id FROM mem)")
def unaligned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.unaligned(*_documents_hit(spark, sf_dir), "query")


@query(_mem_sql(*_TEXTS) + "SELECT count(*) AS total_seqs, count(*) FILTER (hit) AS aligned_seqs, count(*) FILTER (NOT hit) AS unaligned_seqs, sum(len) AS total_bases, coalesce(sum(len) FILTER (hit), 0) AS bases_in_aligned FROM (SELECT length(text) AS len, doc_id::VARCHAR IN (SELECT qry_id FROM mem) AS hit FROM documents)")
def aligned_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aligned_sequences(*_documents_hit(spark, sf_dir), "query")


@query(ALN + "SELECT ref_id, sum(errors) AS errors, sum(greatest(hi1 - lo1, hi2 - lo2) + 1) AS size, sum(errors) / sum(greatest(hi1 - lo1, hi2 - lo2) + 1) AS rate, max(errors / (greatest(hi1 - lo1, hi2 - lo2) + 1)) AS worst FROM b GROUP BY ref_id")
def region_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.error_rate(_alignments(spark, sf_dir), ["ref_id"])


@query('SELECT doc_id::VARCHAR AS seq_id, length(text) AS len, (sum(length(text) - 1) OVER (ORDER BY doc_id) - length(text) + 1)::BIGINT AS "offset" FROM documents')
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.offsets(table(spark, sf_dir, "documents")).select("seq_id", "len", "offset")


@query(ALN + ", t AS (SELECT ref_id AS cluster_id, row_number() OVER (PARTITION BY ref_id ORDER BY lo1, aln_id) AS ord, lo1 AS s1, lo2 AS s2, least(hi1 - lo1, hi2 - lo2) + 1 AS len FROM b) SELECT cluster_id, ord, s1, s2, len, s1 - lag(s1 + len) OVER w AS gap1, s2 - lag(s2 + len) OVER w AS gap2 FROM t WINDOW w AS (PARTITION BY cluster_id ORDER BY ord)")
def cluster_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _alignments(spark, sf_dir).select(F.col("ref_id").alias("cluster_id"), F.row_number().over(Window.partitionBy("ref_id").orderBy("lo1", "aln_id")).alias("ord"), F.col("lo1").alias("s1"), F.col("lo2").alias("s2"), (F.least(F.col("hi1") - F.col("lo1"), F.col("hi2") - F.col("lo2")) + 1).alias("len"))
    return structure.gaps_between(rows)


# Chains, clusters, extensions and what follows from them: tested against brute force, without a twin in SQL.


def _some_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir)


@query()
def qlis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.query_chains(_some_alignments(spark, sf_dir))


@query()
def rlis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.reference_chains(_some_alignments(spark, sf_dir))


@query()
def glis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.global_best(_some_alignments(spark, sf_dir)).filter("is_g").select("aln_id", "ref_id", "qry_id")


@query()
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.both_chains(_some_alignments(spark, sf_dir)).filter("is_q AND is_r").select("aln_id")


@query()
def many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.both_chains(_some_alignments(spark, sf_dir))


_UNIQUE = """, {name}s AS (SELECT seq, place, sum(step) AS step FROM (SELECT pair AS seq, lo{k} AS place, 1 AS step FROM {rows} UNION ALL SELECT pair, hi{k} + 1, -1 FROM {rows}) GROUP BY seq, place),
{name}d AS (SELECT seq, place AS lo, lead(place) OVER w - 1 AS hi, sum(step) OVER w AS depth FROM {name}s WINDOW w AS (PARTITION BY seq ORDER BY place)),
{name} AS (SELECT * FROM {rows} WHERE aln_id IN (SELECT aln_id FROM {rows} b LEFT JOIN {name}d d ON d.seq = b.pair AND d.depth = 1 AND d.lo <= b.hi{k} AND d.hi >= b.lo{k} GROUP BY aln_id, b.lo{k}, b.hi{k} HAVING 100.0::DOUBLE * sum(CASE WHEN d.lo IS NULL THEN 0 ELSE least(d.hi, b.hi{k}) - greatest(d.lo, b.lo{k}) + 1 END) >= 40.0 * (b.hi{k} - b.lo{k} + 1)))"""


@query(ALN + ", p AS (SELECT *, ref_id || ':' || qry_id AS pair FROM b)" + _UNIQUE.format(name="u", rows="p", k=1) + _UNIQUE.format(name="v", rows="u", k=2) + "SELECT aln_id FROM v")
def uniqueness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alignment; each pair's two sequences count as sequences of their own."""
    pair = F.concat_ws(":", "ref_id", "qry_id")
    rows = _some_alignments(spark, sf_dir).withColumn("pair", pair)
    return filters.by_uniqueness(rows.withColumn("ref_id", F.col("pair")).withColumn("qry_id", F.col("pair")), 40).select("aln_id")


@query()
def tiling_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.tiling import tiling

    return tiling(_some_alignments(spark, sf_dir), max_gap=-1, coverage=3.0, lead=0.1, identity=90.0)


#: Text alignment of the planted benchmark passages.
TEXT_OPTIONS = {"min_match": TEXT_MATCH, "min_cluster": 40, "text": True, "strand": "forward", "matches": "all"}


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables and their alignments, which are written: what follows reads them several times."""
    from helixframe.deploy import written
    from helixframe.operators.extend import Options
    from helixframe.plans.align import align

    refs, queries = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return refs, queries, written(align(refs, queries, Options(**TEXT_OPTIONS)), "aligned")


@query()
def cluster_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.cluster import clusters

    return clusters(_text_matches(spark, sf_dir), min_cluster=40)


#: Rows of ``lineitem`` as matches between suppliers and parts, on near diagonals and often from one start; in words of both engines.
_LINES = {
    "ref_id": "CAST(l_suppkey AS VARCHAR(20))", "qry_id": "CAST(l_partkey % 20 AS VARCHAR(20))", "strand": "CAST(1 AS INT)",
    "s1": "CAST(1001 + 20 * (l_orderkey * 7 % 200) + 20 * (CAST(l_quantity AS INT) % 3) + l_linenumber % 2 AS BIGINT)", "s2": "CAST(1 + 20 * (l_orderkey * 7 % 200) AS BIGINT)",
    "len": "CAST(12 + 9 * l_linenumber + CAST(l_quantity AS INT) % 5 * 8 AS BIGINT)",
}


def _line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*(f"{how} AS {name}" for name, how in _LINES.items()))


# equal lines are one and each window has one order, so that both windows see the same row before another
_LINE_MEM = "WITH RECURSIVE lines AS (SELECT DISTINCT " + ", ".join(f"{how} AS {name}" for name, how in _LINES.items()) + """ FROM lineitem),
    reach AS (SELECT *, max(s2 + len) OVER (PARTITION BY ref_id, qry_id, strand, s2 - s1 ORDER BY s2, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM lines),
    runs AS (SELECT *, sum(CASE WHEN s2 <= far THEN 0 ELSE 1 END) OVER (PARTITION BY ref_id, qry_id, strand, s2 - s1 ORDER BY s2, len ROWS UNBOUNDED PRECEDING) AS run FROM reach),
    mem AS MATERIALIZED (SELECT ref_id, qry_id, strand, min(s1) AS s1, min(s2) AS s2, max(s2 + len) - min(s2) AS len FROM runs GROUP BY ref_id, qry_id, strand, s2 - s1, run)
"""


def _rivals_sql(side: str, other: str) -> str:
    """Matches with a rival that starts with them on ``side`` and shares half of the shorter on the ``other``."""
    return f"""
    SELECT a.ref_id, a.qry_id, a.strand, a.s1, a.s2, a.len, bool_or(b.len > a.len) AS beaten,
      bool_or(b.len = a.len AND (b.s2, b.s1) < (a.s2, a.s1)) AS ahead, bool_or(b.len = a.len AND (b.s2, b.s1) > (a.s2, a.s1)) AS behind
    FROM mem a JOIN mem b ON b.ref_id = a.ref_id AND b.qry_id = a.qry_id AND b.strand = a.strand AND b.{side} = a.{side} AND b.{other} <> a.{other}
      AND least(a.{other} + a.len, b.{other} + b.len) - greatest(a.{other}, b.{other}) >= least(a.len, b.len) // 2
    GROUP BY ALL"""


_THIN = f""", rivals AS ({_rivals_sql("s1", "s2")} UNION ALL {_rivals_sql("s2", "s1")}),
    gone AS (SELECT ref_id, qry_id, strand, s1, s2, len FROM rivals GROUP BY ALL HAVING bool_or(beaten) OR bool_or(ahead) AND bool_or(behind)),
    thin AS MATERIALIZED (SELECT ref_id, qry_id, strand, s1, s2, len FROM mem ANTI JOIN gone USING (ref_id, qry_id, strand, s1, s2, len))
"""


@query(_LINE_MEM + _THIN + "SELECT * FROM thin")
def repeat_internal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.band import without_repeats

    return without_repeats(_line_matches(spark, sf_dir)).drop("axis")


@query(
    _LINE_MEM + _THIN + """,
    links AS MATERIALIZED (
      SELECT a.ref_id, a.qry_id, a.strand, a.s1, a.s2, b.s1 AS t1, b.s2 AS t2 FROM thin a JOIN thin b USING (ref_id, qry_id, strand)
      WHERE (a.s2, a.s1) < (b.s2, b.s1) AND b.s2 - a.s2 - a.len <= 40
        AND abs((b.s2 - b.s1) - (a.s2 - a.s1)) <= greatest(5, trunc(0.12::DOUBLE * (b.s2 - a.s2 - a.len)))),
    ways AS MATERIALIZED (FROM links UNION ALL SELECT ref_id, qry_id, strand, t1, t2, s1, s2 FROM links),
    met AS (SELECT ref_id, qry_id, strand, s1, s2, s1 AS t1, s2 AS t2 FROM thin
      UNION SELECT met.ref_id, met.qry_id, met.strand, met.s1, met.s2, w.t1, w.t2 FROM met JOIN ways w
        ON w.ref_id = met.ref_id AND w.qry_id = met.qry_id AND w.strand = met.strand AND w.s1 = met.t1 AND w.s2 = met.t2),
    roots AS (SELECT ref_id, qry_id, strand, s1, s2, min((t2, t1)) AS root FROM met GROUP BY ALL)
    SELECT thin.*, root[2] AS root_s1, root[1] AS root_s2 FROM thin JOIN roots USING (ref_id, qry_id, strand, s1, s2)"""
)
def band_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.band import connected, without_repeats

    return connected(without_repeats(_line_matches(spark, sf_dir)), max_gap=40, tile_bits=10).drop("axis")


@query()
def clusters_on_one_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.band import clusters

    return clusters(_text_matches(spark, sf_dir), min_cluster=40, refs=table(spark, sf_dir, "benchmark"))


@query()
def align_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)[2]


@query()
def snps_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators import variants

    refs, queries, rows = _aligned(spark, sf_dir)
    return variants.snps(variants.differences(variants.with_sequences(rows, refs, queries)), rows)


@query()
def sam_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators import variants
    from helixframe.sinks.formats import sam_lines

    refs, queries, rows = _aligned(spark, sf_dir)
    return sam_lines(variants.sam_columns(variants.with_sequences(rows, refs, queries)))


@query()
def vcf_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators import variants

    refs, queries, rows = _aligned(spark, sf_dir)
    return variants.vcf_rows(variants.differences(variants.with_sequences(rows, refs, queries)), refs)


@query()
def difference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.plans.align import difference_report as report

    refs, queries, rows = _aligned(spark, sf_dir)
    return report(refs, queries, rows)


_CODES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_PROTEIN = "array_to_string(list_transform(range({f}, length({s}) - 1, 3), lambda i: substr('" + _CODES + "', ((instr('tcag', substr({s}, i, 1)) - 1) * 16 + (instr('tcag', substr({s}, i + 1, 1)) - 1) * 4 + instr('tcag', substr({s}, i + 2, 1)))::BIGINT, 1)), '')"
_MASKED = "array_to_string(list_transform(string_split({p}, '*'), lambda x: CASE WHEN length(x) >= 8 THEN x ELSE repeat('X', length(x)) END), 'J')"


@query(f"SELECT seq_id, frame, {_MASKED.format(p='p')} AS seq, length(p) AS len FROM (SELECT seq_id, frame, {_PROTEIN.format(f='(frame - 1) % 3 + 1', s='s')} AS p FROM (SELECT item_id::VARCHAR AS seq_id, frame, CASE WHEN frame > 3 THEN {REVCOMP.format('d')} ELSE d END AS s FROM (SELECT item_id, {DNA.format('text')} AS d FROM benchmark), (SELECT unnest(range(1, 7))::INT AS frame)))")
def six_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.protein import frames

    return frames(table(spark, sf_dir, "benchmark", dna=True))


@query()
def align_protein_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.protein import align_protein

    return align_protein(table(spark, sf_dir, "benchmark", dna=True), table(spark, sf_dir, "documents", dna=True), _protein_options())


def _protein_options():
    from helixframe.operators.extend import PROTEIN

    return PROTEIN


@query()
def gap_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.cluster import clusters
    from helixframe.operators.gaps import annotate

    refs, queries = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return annotate(clusters(_text_matches(spark, sf_dir), min_cluster=40), refs, queries)


@query()
def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.sinks.formats import plot_series as series

    refs, queries, rows = _aligned(spark, sf_dir)
    return series(rows, refs, queries)


@query(ALN + """SELECT qry_id, ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY lo1, qry_id) AS rank, dir2 < 0 AS reverse FROM (SELECT *, row_number() OVER (PARTITION BY qry_id ORDER BY hi1 - lo1 + 1 DESC, ref_id, lo1, aln_id) AS n FROM b) WHERE n = 1""")
def plot_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.sinks.formats import layout

    return layout(_alignments(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS seq_id, length(text) AS len FROM documents WHERE lower(text) SIMILAR TO '.*(idiot|clown).*' OR regexp_matches(lower(text), 'idiot|clown')")
def data_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.records import data_grep as grep

    return grep(table(spark, sf_dir, "documents"), "idiot|clown").select("seq_id", "len")


@query("SELECT doc_id::VARCHAR AS seq_id, length(text) AS len FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.records import extract

    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select(F.col("doc_id").cast("string").alias("seq_id"))
    return extract(table(spark, sf_dir, "documents"), ids).select("seq_id", "len")


from helixframe.plans import catalog_formats  # noqa: E402, F401  its queries join those above
