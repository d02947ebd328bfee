"""Registered queries of sources, sinks, records and what is derived from differences, with their SQL twins.

A source's query writes a table in its format to the shared folder and reads it back, so that the
rows that come out are those of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.deploy import scratch
from helixframe.functions import sequence as fn
from helixframe.operators import aggregates, coords, filters, matches, records, structure, tiling, variants
from helixframe.plans.catalog import _IN_REF, _MEM_OUT, _SHOWN, _TEXTS, _TWO, _WALK, ALN, DNA, DNA_MATCH, REVCOMP, TEXT_MATCH, _alignments, _flagged, _mem_sql, _text_matches, query
from helixframe.sinks import formats
from helixframe.sources import alignments, sequences
from helixframe.sources.sequences import table


def _written(spark: SparkSession, lines: DataFrame, name: str, *order: str) -> str:
    path = scratch(spark, name)
    formats.write_lines(lines, path, *order)
    return path


# Sources

_BARE = "lower(regexp_replace(text, '\\s', '', 'g'))"


@query(f"SELECT doc_id::VARCHAR AS seq_id, length({_BARE}) AS len, md5({_BARE}) AS letters FROM documents")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FASTA of 70 letters a line, read back."""
    whole = records.wrapped(table(spark, sf_dir, "documents").withColumn("seq", F.regexp_replace("seq", r"\s", "")), 70)
    path = _written(spark, whole.select(F.concat_ws("\n", F.concat(F.lit(">"), "seq_id", F.lit(" a document")), F.array_join("lines", "\n")).alias("line")), "fasta")
    return sequences.read_sequences(spark, path).select("seq_id", "len", F.md5("seq").alias("letters"))


@query(f"SELECT doc_id::VARCHAR AS seq_id, length({_BARE}) AS len, md5({_BARE}) AS letters, repeat('~', length({_BARE})) AS qual FROM documents")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("seq", F.regexp_replace("seq", r"\s", ""))
    line = F.concat_ws("\n", F.concat(F.lit("@"), "seq_id"), "seq", F.lit("+"), F.repeat(F.lit("~"), F.length("seq")))
    path = _written(spark, rows.select(line.alias("line")), "fastq")
    return sequences.read_fastq(spark, path).select("seq_id", "len", F.md5("seq").alias("letters"), "qual")


@query("SELECT 'u' || user_id AS seq_id, 'events' AS source, event_type AS feature, event_id AS start, event_id + 10 AS \"end\", '.' AS score, '+' AS strand, '0' AS frame, 'g' || event_id AS gene FROM events")
def gff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat_ws("\t", F.concat(F.lit("u"), "user_id"), F.lit("events"), "event_type", "event_id", F.col("event_id") + 10, F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("g"), "event_id"))
    return sequences.read_gff(spark, _written(spark, rows.select(line.alias("line")), "gff"))


@query("SELECT doc_id::VARCHAR AS seq_id, length(text) AS len, doc_id % 2 = 1 AS reverse FROM documents")
def id_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.sizes(table(spark, sf_dir, "documents"))
    line = F.concat_ws(" ", "seq_id", "len", F.when(F.col("seq_id").cast("long") % 2 == 1, "-").otherwise("+"))
    return sequences.read_id_list(spark, _written(spark, rows.select(line.alias("line")), "ids"))


@query("SELECT doc_id::VARCHAR AS seq_id, length(text) AS len FROM documents")
def fasta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sizes(table(spark, sf_dir, "documents"))


@query("SELECT doc_id::VARCHAR AS seq_id, substring(lower(text), 11, 90) AS seq, length(substring(lower(text), 11, 90)) AS len FROM documents")
def sub_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sub_range(table(spark, sf_dir, "documents"), 11, 100).select("seq_id", "seq", "len")


_LOCUS = "SELECT ref_id, qry_id, ref_len, qry_len, s1, e1, s2, e2, errors, sim_errors, stops FROM b"


@query(ALN + _LOCUS)
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "delta")
    formats.write_delta(_alignments(spark, sf_dir), path, "ref.fa", "qry.fa")
    return alignments.read_delta(spark, path).select("ref_id", "qry_id", "ref_len", "qry_len", "s1", "e1", "s2", "e2", "errors", "sim_errors", "stops")


@query(ALN + _LOCUS + " WHERE greatest(hi1 - lo1, hi2 - lo2) + 1 >= 1000")
def delta_long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.long_enough(_alignments(spark, sf_dir), 1000).select("ref_id", "qry_id", "ref_len", "qry_len", "s1", "e1", "s2", "e2", "errors", "sim_errors", "stops")


@query(_mem_sql(*_TEXTS) + "SELECT qry_id, strand, s1, s2, len FROM mem")
def match_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.match_lines(_text_matches(spark, sf_dir), table(spark, sf_dir, "documents"))
    return formats.read_matches(spark, _written(spark, rows.select("qry_id", "strand", F.array_join("lines", "\n").alias("line")), "matches", "qry_id", "strand"))


@query(_mem_sql(*_TEXTS) + "SELECT qry_id, strand, s1, s2, len, ref_id, substring(r.seq, s1, len) AS letters FROM mem JOIN r ON r.id = ref_id")
def match_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.with_letters(_text_matches(spark, sf_dir), table(spark, sf_dir, "benchmark"), "ref_id", "s1", "letters")


@query(_mem_sql(*_TEXTS) + _MEM_OUT + "mem")
def mem_joined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of window hashes that a large reference takes, over all documents."""
    return matches.maximal_matches(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), TEXT_MATCH, broadcast_letters=0)


@query(_mem_sql(*_TEXTS) + _MEM_OUT + "mem")
def mem_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches from seeds that were saved and loaded again."""
    from helixframe.operators import seeds

    refs, path = table(spark, sf_dir, "benchmark"), scratch(spark, "seeds")
    seeds.save(seeds.sampled(refs, TEXT_MATCH), path)
    return matches.from_index(seeds.load(spark, path), refs, table(spark, sf_dir, "documents"), TEXT_MATCH)


#: Letters as bases, but e as any base: stretches of acgt between others.
_MIXED = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'acgtncgtacgtacgtacgtacgtac')"
_ONLY = (7, f"SELECT item_id::VARCHAR AS id, regexp_replace({_MIXED}, '[^acgt]', '#', 'g') AS seq FROM benchmark", f"SELECT item_id::VARCHAR AS id, 1 AS strand, regexp_replace({_MIXED}, '[^acgt]', '~', 'g') AS seq FROM benchmark")


@query(_mem_sql(*_ONLY) + _MEM_OUT + "mem")
def mem_nucleotides_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").withColumn("seq", F.translate("seq", "abcdefghijklmnopqrstuvwxyz", "acgtncgtacgtacgtacgtacgtac"))
    return matches.maximal_matches(items, items, 7, nucleotides_only=True)


_TURNED = (12, f"SELECT item_id::VARCHAR AS id, {DNA.format('text')} AS seq FROM benchmark", f"SELECT item_id::VARCHAR AS id, -1 AS strand, {REVCOMP.format(DNA.format('text'))} AS seq FROM benchmark")


@query(_mem_sql(*_TURNED).replace("FROM rk JOIN qk USING (k)", "FROM rk JOIN qk USING (k) WHERE rk.id = qk.id") + "SELECT ref_id AS seq_id, strand, s1, length(r.seq) - s2 + 1 AS s2, len FROM mem JOIN r ON r.id = ref_id WHERE length(r.seq) - s2 + 1 >= s1")
def self_repeats_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.self_repeats(table(spark, sf_dir, "benchmark", dna=True), 12, "reverse")


_CODES_RC = "reverse(translate({0}, 'acgtryswmkbdhvACGTRYSWMKBDHV', 'tgcayrswkmvhdbTGCAYRSWKMVHDB'))"


@query(f"SELECT item_id::VARCHAR AS seq_id, {_CODES_RC.format('text')} AS codes, {_CODES_RC.format(chr(114) + 'egexp_replace(text, ' + repr('[^acgtryswmkbdhvACGTRYSWMKBDHV]') + ', ' + repr('n') + ', ' + repr('g') + ')')} AS codes_only, reverse(translate(text, 'ACGTNacgtn', 'TGCANtgcan')) AS bases FROM benchmark")
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("seq_id"), fn.reverse_complement_iupac(text).alias("codes"), fn.reverse_complement_iupac(text, False).alias("codes_only"), fn.reverse_complement_acgtn(text).alias("bases"))


# Record verbs

_SEQ = "doc_id::VARCHAR AS seq_id, lower(text) AS seq"


@query(f"SELECT {_SEQ} FROM documents ORDER BY doc_id LIMIT 7")
def records_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.head(table(spark, sf_dir, "documents"), 7).select("seq_id", "seq")


@query(f"SELECT {_SEQ} FROM documents ORDER BY doc_id DESC LIMIT 7")
def records_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tail(table(spark, sf_dir, "documents"), 7).select("seq_id", "seq")


@query(f"SELECT {_SEQ} FROM documents WHERE NOT regexp_matches(doc_id::VARCHAR, '^1.*[02468]$')")
def records_header_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.header_grep(table(spark, sf_dir, "documents"), "^1.*[02468]$", inverted=True).select("seq_id", "seq")


@query("SELECT doc_id::VARCHAR AS seq_id, (doc_id % 7)::INT AS part FROM documents")
def records_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.split(table(spark, sf_dir, "documents"), 7).select("seq_id", "part")


@query("SELECT doc_id::VARCHAR AS seq_id, array_to_string(list_transform(range(0, greatest(1, (length(text) + 59) // 60)), lambda i: substring(lower(text), i * 60 + 1, 60)), chr(10)) AS lines FROM documents")
def records_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.wrapped(table(spark, sf_dir, "documents"), 60).select("seq_id", F.array_join("lines", "\n").alias("lines"))


@query("SELECT '>' || doc_id AS header, lower(text) AS seq FROM documents")
def records_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.one_line(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id::VARCHAR AS seq_id, {_CODES_RC.format('lower(text)')} AS seq FROM documents")
def records_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.turned(table(spark, sf_dir, "documents")).select("seq_id", "seq")


@query("SELECT seq_id, row_number() OVER (ORDER BY seq, seq_id) AS place FROM (SELECT doc_id::VARCHAR AS seq_id, md5(text) AS seq FROM documents)")
def records_by_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their order, as numbers from 1."""
    return _numbered(records.by_data(_digests(spark, sf_dir)))


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("seq_id"), F.md5("text").alias("seq"))


def _numbered(ordered: DataFrame) -> DataFrame:
    """Places of sorted rows: each sorted partition is counted, and numbered from where those before it end."""
    at = F.monotonically_increasing_id()
    rows = ordered.select("seq_id", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").select("seq_id", (F.col("_start") + F.col("_at") + 1).alias("place"))


@query(ALN + "SELECT aln_id AS seq_id, row_number() OVER (ORDER BY qry_id, lo2, ref_id, lo1, aln_id) AS place FROM b")
def coords_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(coords.ordered(_alignments(spark, sf_dir), "query").select(F.col("aln_id").alias("seq_id")))


@query(ALN + "SELECT aln_id AS seq_id, row_number() OVER (ORDER BY ref_id, lo1, qry_id, lo2, aln_id) AS place FROM b")
def coords_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(coords.ordered(_alignments(spark, sf_dir), "reference").select(F.col("aln_id").alias("seq_id")))


# Lines

_F2 = "printf('%.2f', {0})"


@query(ALN + f"SELECT aln_id, concat_ws(chr(9), s1, e1, s2, e2, abs(e1 - s1) + 1, abs(e2 - s2) + 1, {_F2.format(_SHOWN.format('idy', 'errors'))}, ref_id, qry_id) AS line FROM b")
def coords_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.coords_lines(coords.coords(_alignments(spark, sf_dir)))


@query(ALN + f"SELECT aln_id, lpad(s1::VARCHAR, 8, ' ') || ' ' || lpad(e1::VARCHAR, 8, ' ') || '  | ' || lpad(s2::VARCHAR, 8, ' ') || ' ' || lpad(e2::VARCHAR, 8, ' ') || '  | ' || lpad((abs(e1 - s1) + 1)::VARCHAR, 8, ' ') || ' ' || lpad((abs(e2 - s2) + 1)::VARCHAR, 8, ' ') || '  | ' || lpad({_F2.format(_SHOWN.format('idy', 'errors'))}, 8, ' ') || '  | ' || ref_id || chr(9) || qry_id AS line FROM b")
def coords_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.coords_table(coords.coords(_alignments(spark, sf_dir)))


_SIX = "(floor({0} * 1000000 + 0.5::DOUBLE) / 1000000)"


@query(ALN + f"SELECT aln_id, concat_ws(chr(9), qry_id, '', qry_len, 'dna', '', ref_id, s2, e2, s1, e1, printf('%.6f', {_SIX.format('idy')}), printf('%.6f', {_SIX.format('sim')}), abs(e2 - s2) + 1, '', '', '', '', CASE WHEN dir2 > 0 THEN 'Plus' ELSE 'Minus' END, ref_len, '', '') AS line FROM b")
def coords_btab(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = lambda c: F.floor(F.col(c) * 1000000 + 0.5) / 1000000
    return formats.btab_lines(_alignments(spark, sf_dir).withColumns({"idy": six("idy"), "sim": six("sim")}))


@query(ALN + ", t AS (SELECT ref_id, qry_id, row_number() OVER w AS ord, lo1 AS s1, lo2 AS s2, least(hi1 - lo1, hi2 - lo2) + 1 AS len FROM b WINDOW w AS (PARTITION BY ref_id, qry_id ORDER BY lo1, aln_id)) SELECT ref_id, qry_id, 1 AS strand, 0::BIGINT AS cluster_id, ord, concat_ws(' ', s1, s2, len, coalesce((s1 - lag(s1 + len) OVER w)::VARCHAR, '-'), coalesce((s2 - lag(s2 + len) OVER w)::VARCHAR, '-')) AS line FROM t WINDOW w AS (PARTITION BY ref_id, qry_id ORDER BY ord)")
def cluster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.cluster import listing

    order = Window.partitionBy("ref_id", "qry_id").orderBy("lo1", "aln_id")
    size = F.least(F.col("hi1") - F.col("lo1"), F.col("hi2") - F.col("lo2")) + 1
    rows = _alignments(spark, sf_dir).select("ref_id", "qry_id", F.lit(1).alias("strand"), F.lit(0).cast("long").alias("cluster_id"), F.row_number().over(order).alias("ord"), F.col("lo1").alias("s1"), F.col("lo2").alias("s2"), size.alias("len"))
    return formats.cluster_lines(listing(rows))


_REF_WALK = _WALK.format(seq="ref_id", mate="qry_id", a=1, b=2, mine=3, other=5, length="ref_len")
_WALKED = _REF_WALK.replace('SELECT seq_id, type, start, "end", "end" - start + 1 AS len', ', f AS (SELECT seq_id, type, start, "end", "end" - start + 1 AS len')


@query(_WALKED + ") SELECT seq_id, start, concat_ws(chr(9), seq_id, type, start, \"end\") AS line FROM f")
def features_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.feature_lines(structure.breakpoints(_flagged(spark, sf_dir), "reference"), bare=True)


@query(_WALKED + ") SELECT seq_id, start, concat_ws(chr(9), seq_id, type, start, \"end\", len, CASE WHEN type = 'GAP' THEN concat_ws(chr(9), len2, diff) WHEN type = 'SEQ' THEN concat_ws(chr(9), prev_seq, next_seq) END) AS line FROM f")
def features_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.feature_lines(structure.breakpoints(_flagged(spark, sf_dir), "reference"))


@query(_WALKED + ") SELECT coalesce(sum(len) FILTER (type <> 'DUP' AND len > 0), 0) AS bases FROM f")
def uncovered_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.uncovered_bases(structure.breakpoints(_flagged(spark, sf_dir), "reference"))


@query(ALN + "SELECT CASE WHEN dir2 > 0 THEN 'forward' ELSE 'reverse' END AS series, ref_id, lo1 AS x1, idy AS y1, hi1 AS x2, idy AS y2 FROM b")
def coverage_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.coverage_series(_alignments(spark, sf_dir))


@query(ALN + "SELECT CASE WHEN dir2 > 0 THEN 'forward' ELSE 'reverse' END AS series, replace(ref_id, 'r', '')::BIGINT * 99999 + s1 AS x1, replace(qry_id, 'q', '')::BIGINT * 49999 + s2 AS y1, replace(ref_id, 'r', '')::BIGINT * 99999 + e1 AS x2, replace(qry_id, 'q', '')::BIGINT * 49999 + e2 AS y2, sim AS similarity FROM b WHERE idy >= 98")
def plot_of_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On axes of 20 references and 50 queries laid end to end."""
    axis = lambda n, name, size: spark.range(n).select(F.lit(name).alias("seq_set"), F.concat(F.lit(name), "id").alias("seq_id"), F.col("id").alias("ord"), F.lit(size).cast("long").alias("len"))
    return formats.plot_series(_alignments(spark, sf_dir), axis(20, "r", 100000), axis(50, "q", 50000), 98)


@query(ALN + "SELECT aln_id FROM b")
def filter_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filtered(_alignments(spark, sf_dir)).select("aln_id")


# Tiles: each alignment's letters as a contig with five more at either end, and a shorter copy of it on the next reference

_CONTIGS = ALN + """, c AS (SELECT aln_id::VARCHAR AS qry_id, ref_id, lo1, hi1, idy, dir2, hi1 - lo1 + 1 AS size, (hi1 - lo1 + 1) * (70 + aln_id % 30) // 100 AS less, hi1 - lo1 + 11 AS len FROM b),
k AS (SELECT qry_id, ref_id, lo1 - 5 AS start, hi1 + 5 AS "end", len, idy, CASE WHEN dir2 > 0 THEN '+' ELSE '-' END AS ori, size * 100.0::DOUBLE / len AS cov, less * 100.0::DOUBLE / len AS second,
  greatest(0, 6 - lo1) + greatest(0, hi1 + 5 - 100000) AS over FROM c),
u AS (SELECT *, greatest(cov, CASE WHEN len > over THEN cov * len / (len - over) ELSE 0 END) >= 95 AND idy >= 90 AND cov - second >= 10 AS usable FROM k) """
_TILES = _CONTIGS.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY start, "end", qry_id) AS i FROM u WHERE usable),
walk AS (SELECT ref_id, i, "end" AS e FROM o WHERE i = 1 UNION ALL
  SELECT ref_id, m.i, m."end" FROM (SELECT walk.ref_id, coalesce(
      (SELECT x.i FROM o x WHERE x.ref_id = walk.ref_id AND x.i > walk.i AND x.start <= walk.e AND x."end" > walk.e ORDER BY x."end" DESC, x.i LIMIT 1),
      (SELECT min(x.i) FROM o x WHERE x.ref_id = walk.ref_id AND x.i > walk.i AND x.start > walk.e)) AS i FROM walk) n JOIN o m USING (ref_id, i)),
t AS (SELECT ref_id, start, "end", qry_id, len, floor(idy * 100 + 0.5) / 100 AS idy, ori, floor(cov * 100 + 0.5) / 100 AS cov, lead(start) OVER w - "end" - 1 AS gap, lead(qry_id) OVER w AS q, lead(ori) OVER w AS o,
  greatest(0, coalesce(max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - start + 1, 0)) AS trim FROM walk JOIN o USING (ref_id, i) WINDOW w AS (PARTITION BY ref_id ORDER BY start, "end")) """


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two alignments of each contig, made of one alignment of the table."""
    size = F.col("hi1") - F.col("lo1") + 1
    rows = _alignments(spark, sf_dir).select("aln_id", "ref_id", F.col("aln_id").cast("string").alias("qry_id"), "ref_len", (size + 10).alias("qry_len"), "lo1", "hi1", F.lit(6).cast("long").alias("lo2"), (size + 5).alias("hi2"), "dir2", "idy")
    less = F.floor(size * (70 + F.col("aln_id") % 30) / 100).cast("long")
    # on the reverse strand the copy's first letters are the contig's last ones
    lo2 = F.when(F.col("dir2") > 0, F.lit(6)).otherwise(size + 6 - less).cast("long")
    other = rows.withColumn("ref_id", F.concat(F.lit("r"), ((F.substring("ref_id", 2, 9).cast("int") + 1) % 20).cast("string")))
    other = other.withColumn("lo2", lo2).withColumn("hi2", F.col("lo2") + less - 1).withColumn("hi1", F.col("lo1") + less - 1)
    return rows.unionByName(other)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda c: (F.floor(F.col(c) * 100 + 0.5) / 100).alias(c)
    return tiling.tiling(_contigs(spark, sf_dir)).select("ref_id", "start", "end", "gap", "len", cut("cov"), cut("idy"), "ori", "qry_id")


@query(_TILES + 'SELECT ref_id, start, "end", gap, len, cov, idy, ori, qry_id FROM t')
def tiling_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs placed, chosen and linked over all alignments."""
    return _tiles(spark, sf_dir)


@query(_CONTIGS + "SELECT qry_id, len AS qry_len, ref_id, floor(cov * 100 + 0.5) / 100 AS covered FROM u WHERE NOT usable")
def tiling_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.unusable(_contigs(spark, sf_dir)).select("qry_id", "qry_len", "ref_id", (F.floor(F.col("covered") * 100 + 0.5) / 100).alias("covered"))


@query(_TILES + f"SELECT ref_id, start, concat_ws(chr(9), start, \"end\", coalesce(gap::VARCHAR, '-'), len, printf('%.2f', cov), printf('%.2f', idy), ori, qry_id) AS line FROM t")
def tiling_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.tiling_lines(_tiles(spark, sf_dir))


@query(_TILES + """SELECT ref_id, start, '<CONTIGLINK><GAP SIZE="' || gap || '"/><CONTIG ID="' || qry_id || '" ORI="' || CASE WHEN ori = '+' THEN 'BE' ELSE 'EB' END || '"/><CONTIG ID="' || q || '" ORI="' || CASE WHEN o = '+' THEN 'BE' ELSE 'EB' END || '"/></CONTIGLINK>' AS line FROM t WHERE q IS NOT NULL""")
def tiling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.tiling_xml(_tiles(spark, sf_dir))


@query(_TILES + "SELECT ref_id, start, \"end\", qry_id, trim FROM t")
def tile_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.trims(_tiles(spark, sf_dir)).select("ref_id", "start", "end", "qry_id", "trim")


# Contigs over the origin: each part is one, of two alignments with a few letters between them, before and after the origin

_ROUND = """WITH c AS (SELECT p_partkey::VARCHAR AS qry_id, 'r' || (p_partkey % 20) AS ref_id, 20 + p_size AS h, 30 + p_partkey % 40 AS k, p_partkey % 7 AS g, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS ori FROM part) """


@query(_ROUND + 'SELECT qry_id, ref_id, 100000 - g - h + 1 AS start, 100000 + k AS "end", floor((h + k) * 100.0::DOUBLE / (h + g + k) * 100 + 0.5) / 100 AS covered, ori FROM c')
def circular_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contig once, though its alignments lie at both ends of a circular reference."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, long = F.col("p_partkey").cast("long"), lambda c: c.cast("long")
    base = part.select(key.alias("id"), (20 + F.col("p_size")).cast("long").alias("h"), (30 + key % 40).alias("k"), (key % 7).alias("g"))
    size, forward = F.col("h") + F.col("g") + F.col("k"), F.col("id") % 2 == 0
    own = [F.concat(F.lit("r"), (F.col("id") % 20).cast("string")).alias("ref_id"), F.col("id").cast("string").alias("qry_id"), long(F.lit(100000)).alias("ref_len"), size.alias("qry_len"), F.when(forward, 1).otherwise(-1).alias("dir2"), F.lit(99.0).alias("idy")]
    # on the reverse strand what comes first on the reference is the contig's last
    before = base.select((F.col("id") * 2).alias("aln_id"), *own, (100000 - F.col("g") - F.col("h") + 1).alias("lo1"), (100000 - F.col("g")).alias("hi1"), F.when(forward, 1).otherwise(F.col("k") + F.col("g") + 1).cast("long").alias("lo2"), F.when(forward, F.col("h")).otherwise(size).alias("hi2"))
    after = base.select((F.col("id") * 2 + 1).alias("aln_id"), *own, long(F.lit(1)).alias("lo1"), F.col("k").alias("hi1"), F.when(forward, F.col("h") + F.col("g") + 1).otherwise(1).cast("long").alias("lo2"), F.when(forward, size).otherwise(F.col("k")).alias("hi2"))
    found = tiling.chains(before.unionByName(after), circular=True)
    return found.select("qry_id", "ref_id", "start", "end", (F.floor(F.col("covered") * 100 + 0.5) / 100).alias("covered"), "ori")


# Differences: each benchmark item's DNA against itself moved on by a letter

_SHIFTED = f"""WITH d AS (SELECT item_id AS aln_id, item_id::VARCHAR AS id, {DNA.format('text')} AS r FROM benchmark WHERE length({DNA.format('text')}) > 1),
x AS (SELECT aln_id, id, length(r) AS n, r, substring(r, 2) || substring(r, 1, 1) AS q, unnest(range(1, length(r) + 1)) AS p FROM d),
s AS (SELECT aln_id, id AS ref_id, id AS qry_id, p AS p1, p AS p2, upper(substring(r, p, 1)) AS sub_r, upper(substring(q, p, 1)) AS sub_q, n FROM x WHERE substring(r, p, 1) <> substring(q, p, 1)),
f AS (SELECT *, least(p1, n - p1 + 1, coalesce(p1 - lag(p1) OVER w, n), coalesce(lead(p1) OVER w - p1, n)) AS buff, least(p1, n - p1 + 1) AS dist FROM s WINDOW w AS (PARTITION BY aln_id ORDER BY p1)) """


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Alignments and their differences."""
    refs = table(spark, sf_dir, "benchmark", dna=True).filter("len > 1")
    queries = refs.withColumn("seq", F.concat(F.expr("substring(seq, 2)"), F.expr("substring(seq, 1, 1)")))
    one = F.lit(1).cast("long")
    rows = refs.select(F.col("ord").alias("aln_id"), F.col("seq_id").alias("ref_id"), F.col("seq_id").alias("qry_id"), F.col("len").alias("ref_len"), F.col("len").alias("qry_len"), one.alias("s1"), F.col("len").alias("e1"), one.alias("s2"), F.col("len").alias("e2"), F.array().cast("array<bigint>").alias("deltas"), one.alias("errors"), one.alias("dir2"))
    return rows, variants.with_sequences(rows, refs, queries)


def _snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, both = _shifted(spark, sf_dir)
    return variants.snps(variants.differences(both), rows)


@query(_SHIFTED + "SELECT aln_id, ref_id, qry_id, p1, p2, sub_r, sub_q, buff, dist, 0 AS con_r, 0 AS con_q FROM f")
def snps_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snps(spark, sf_dir).select("aln_id", "ref_id", "qry_id", "p1", "p2", "sub_r", "sub_q", "buff", "dist", "con_r", "con_q")


@query(_SHIFTED + "SELECT aln_id, p1, buff FROM f")
def snps_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, both = _shifted(spark, sf_dir)
    return variants.snps(variants.differences(both), rows, "query").select("aln_id", "p1", "buff")


@query(_SHIFTED + "SELECT ref_id || ':' || p1 AS seq_id, row_number() OVER (ORDER BY qry_id, p2, ref_id, p1) AS place FROM f")
def snps_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.without_indels(variants.unambiguous(_snps(spark, sf_dir)))
    return _numbered(variants.sorted_snps(rows, "query").select(F.concat_ws(":", "ref_id", "p1").alias("seq_id")))


@query(_SHIFTED + "SELECT aln_id, p1, concat_ws(chr(9), p1, sub_r, sub_q, p2, buff, dist, 0, 0, ref_id, qry_id) AS line FROM f")
def snps_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.snp_lines(_snps(spark, sf_dir))


@query(_SHIFTED + "SELECT aln_id, p1, lpad(p1::VARCHAR, 8, ' ') || '   ' || sub_r || ' ' || sub_q || '   ' || rpad(p2::VARCHAR, 8, ' ') || '  | ' || lpad(buff::VARCHAR, 6, ' ') || ' ' || lpad(dist::VARCHAR, 6, ' ') || '  | ' || ref_id || chr(9) || qry_id AS line FROM f")
def snps_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.snp_table(_snps(spark, sf_dir))


@query(_SHIFTED + "SELECT sub_r, sub_q, count(*) AS n FROM f GROUP BY ALL")
def snp_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.snp_matrix(_snps(spark, sf_dir))


@query(_SHIFTED + "SELECT sub_r, sub_q, count(*) AS n FROM f WHERE buff >= 2 GROUP BY ALL")
def snp_matrix_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.snp_matrix(_snps(spark, sf_dir), good=2)


@query(_SHIFTED + "SELECT ref_id AS chrom, p1 AS pos, sub_r AS ref, sub_q AS alt FROM f")
def vcf_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.vcf_rows(variants.differences(_shifted(spark, sf_dir)[1]), table(spark, sf_dir, "benchmark", dna=True))


@query(_SHIFTED + "SELECT ref_id AS chrom, p1 AS pos, concat_ws(chr(9), ref_id, p1, '.', sub_r, sub_q, '.', 'PASS', '.') AS line FROM f")
def vcf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.vcf_lines(variants.vcf_rows(variants.differences(_shifted(spark, sf_dir)[1]), table(spark, sf_dir, "benchmark", dna=True)))


@query(_SHIFTED + """, m AS (SELECT aln_id, ref_id, any_value(n) AS n, count(*) AS nm, string_agg(g || sub_r, '' ORDER BY p1) || (any_value(n) - max(p1)) AS md FROM (SELECT *, p1 - coalesce(lag(p1) OVER (PARTITION BY aln_id ORDER BY p1), 0) - 1 AS g FROM f) GROUP BY aln_id, ref_id)
SELECT aln_id, concat_ws(chr(9), ref_id, 0, ref_id, 1, 30, n || 'M', '*', 0, 0, substring(r, 2) || substring(r, 1, 1), '*', 'NM:i:' || nm, 'MD:Z:' || md) AS line FROM m JOIN d USING (aln_id)""")
def sam_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form: with the query's letters."""
    both = _shifted(spark, sf_dir)[1]
    queries = both.select(F.col("qry_id").alias("seq_id"), F.col("qry_seq").alias("seq"))
    return formats.sam_lines(variants.sam_columns(both), long=True, queries=queries)


@query(f"SELECT item_id::VARCHAR AS seq_id, '@SQ' || chr(9) || 'SN:' || item_id || chr(9) || 'LN:' || length({DNA.format('text')}) AS line FROM benchmark")
def sam_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.sam_header(table(spark, sf_dir, "benchmark", dna=True))


@query(f"SELECT 1 AS n, '##contig=<ID=' || item_id || ',length=' || length({DNA.format('text')}) || '>' AS line FROM benchmark UNION ALL SELECT * FROM (VALUES (0, '##fileformat=VCFv4.2'), (2, '##INFO=<ID=DP,Number=1,Type=Integer,Description=\"Alignments at the place\">'), (3, '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL' || chr(9) || 'FILTER' || chr(9) || 'INFO')) v(n, line)")
def vcf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.vcf_header(spark, table(spark, sf_dir, "benchmark", dna=True))


@query(_mem_sql(DNA_MATCH, f"SELECT item_id::VARCHAR AS id, {DNA.format('text')} AS seq FROM benchmark", f"SELECT doc_id::VARCHAR AS id, 1 AS strand, {DNA.format('text')} AS seq FROM documents") + _MEM_OUT + f"mem a WHERE {_IN_REF}")
def mam_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches.maximal_matches(table(spark, sf_dir, "benchmark", dna=True), table(spark, sf_dir, "documents", dna=True), DNA_MATCH)
    return matches.reference_unique(found)


@query()
def preset_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.plans.align import anchored

    return anchored(table(spark, sf_dir, "benchmark", dna=True), table(spark, sf_dir, "documents", dna=True), "reference")


@query()
def preset_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.plans.align import anchored

    return anchored(table(spark, sf_dir, "benchmark", dna=True), table(spark, sf_dir, "documents", dna=True), "unique")


@query()
def regions_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.operators.gaps import regions
    from helixframe.plans.align import anchored

    return regions(anchored(table(spark, sf_dir, "benchmark", dna=True), table(spark, sf_dir, "documents", dna=True), "reference"))


# Differences with indels: each benchmark item's DNA against an edited copy, and its middle against another one on the other strand

_EDITED = f"""WITH d AS (SELECT item_id, item_id::VARCHAR AS id, {DNA.format('text')} AS r, length({DNA.format('text')}) AS n FROM benchmark WHERE length({DNA.format('text')}) > 5),
p AS (SELECT *, unnest(range(1, n + 1)) AS p FROM d),
e AS (SELECT *, substring(r, p, 1) AS x, p BETWEEN 3 AND n - 3 AND (p % 23 IN (7, 8) OR p % 41 = 20) AS gone, p BETWEEN 3 AND n - 3 AND p % 17 = 3 AS other,
  CASE WHEN p NOT BETWEEN 3 AND n - 3 THEN '' WHEN p % 29 = 11 THEN 'acg' WHEN p % 23 = 9 THEN 't' ELSE '' END AS more FROM p),
c AS (SELECT 2 * item_id AS aln_id, id, 'a' AS kind, n, r, p, 0 AS k, x, CASE WHEN gone THEN NULL WHEN other THEN translate(x, 'acgt', 'cgta') ELSE x END AS y FROM e
  UNION ALL SELECT 2 * item_id, id, 'a', n, r, p, k, NULL, substring(more, k, 1) FROM (SELECT *, unnest(range(1, length(more) + 1)) AS k FROM e)
  UNION ALL SELECT 2 * item_id + 1, id, 'b', n, r, p, 0, x, CASE WHEN p % 13 = 4 THEN translate(x, 'acgt', 'cgta') ELSE x END FROM e WHERE p BETWEEN n // 3 + 1 AND 2 * n // 3),
w AS (SELECT *, row_number() OVER o - 1 AS col, CASE kind WHEN 'a' THEN 0 ELSE n // 3 END + count(x) OVER o AS p1, count(y) OVER o AS at2, count(y) OVER (PARTITION BY aln_id) AS m2,
  CASE kind WHEN 'a' THEN 1 ELSE n // 3 + 1 END AS lo, CASE kind WHEN 'a' THEN n ELSE 2 * n // 3 END AS hi,
  {' || '.join(f"coalesce({f}(coalesce(x, '-'), {abs(i)}) OVER o, '-')" if i else "coalesce(x, '-')" for i, f in ((-2, 'lag'), (-1, 'lag'), (0, ''), (1, 'lead'), (2, 'lead')))} AS ctx_r,
  {' || '.join(f"coalesce({f}(coalesce(y, '-'), {abs(i)}) OVER o, '-')" if i else "coalesce(y, '-')" for i, f in ((-2, 'lag'), (-1, 'lag'), (0, ''), (1, 'lead'), (2, 'lead')))} AS ctx_q
  FROM c WINDOW o AS (PARTITION BY aln_id ORDER BY p, k)),
z AS (SELECT *, CASE kind WHEN 'a' THEN 2 + at2 ELSE m2 - at2 + 2 END AS p2, CASE kind WHEN 'a' THEN m2 + 5 ELSE m2 + 3 END AS qry_len FROM w),
s AS (SELECT aln_id, id, r, n, id AS ref_id, id || kind AS qry_id, p1, p2, coalesce(upper(x), '.') AS sub_r, coalesce(upper(y), '.') AS sub_q, col, upper(ctx_r) AS ctx_r, upper(ctx_q) AS ctx_q, lo, hi, qry_len,
  CASE WHEN kind = 'b' OR p1 BETWEEN n // 3 + 1 AND 2 * n // 3 THEN 1 ELSE 0 END AS con_r FROM z WHERE x IS DISTINCT FROM y),
f AS (SELECT *, least(p1 - lo + 1, hi - p1 + 1, coalesce(p1 - lag(p1) OVER o, n), coalesce(lead(p1) OVER o - p1, n)) AS buff, least(p1, n - p1 + 1, p2, qry_len - p2 + 1) AS dist FROM s WINDOW o AS (PARTITION BY aln_id ORDER BY p1, p2, col)) """


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Alignments with runs of planted indels and substitutions and with clipped ends, two over each item's middle, and the same with their stretches."""
    import pyarrow as pa

    refs = table(spark, sf_dir, "benchmark", dna=True).filter("len > 5")
    changed, columns = str.maketrans("acgt", "cgta"), "aln_id long, ref_id string, qry_id string, ref_len long, qry_len long, s1 long, e1 long, s2 long, e2 long, deltas array<long>, errors long, dir2 long, query string"
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]

    def plant(batches):
        for b in batches:
            out = []
            for k, name, seq in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                n, one, two = len(seq), [], []
                for p, x in enumerate(seq, 1):
                    inner = 3 <= p <= n - 3
                    gone = inner and (p % 23 in (7, 8) or p % 41 == 20)
                    more = ("acg" if p % 29 == 11 else "t" if p % 23 == 9 else "") if inner else ""
                    one.append(x + variants.GAP * len(more))
                    two.append((variants.GAP if gone else x.translate(changed) if inner and p % 17 == 3 else x) + more)
                one, two = "".join(one), "".join(two)
                whole = two.replace(variants.GAP, "")
                off = sum(x != y for x, y in zip(one, two, strict=True))
                out.append((2 * k, name, f"{name}a", n, len(whole) + 5, 1, n, 3, len(whole) + 2, variants.contract(one, two), off, 1, f"gg{whole}ttt"))
                lo, hi = n // 3 + 1, 2 * n // 3
                middle = "".join(x.translate(changed) if p % 13 == 4 else x for p, x in enumerate(seq[lo - 1 : hi], lo))
                off = sum(x != y for x, y in zip(seq[lo - 1 : hi], middle, strict=True))
                out.append((2 * k + 1, name, f"{name}b", n, len(middle) + 3, lo, hi, len(middle) + 1, 2, [], off, -1, "a" + fn.revcomp(middle) + "cc"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in columns.split(", ")])

    rows = refs.select("ord", "seq_id", "seq").mapInArrow(plant, columns)
    queries = rows.select(F.col("qry_id").alias("seq_id"), F.col("query").alias("seq"))
    rows = rows.drop("query")
    return rows, variants.with_sequences(rows, refs, queries)


def _edited_snps(spark: SparkSession, sf_dir: str, context: int = 0) -> DataFrame:
    rows, both = _edited(spark, sf_dir)
    return variants.snps(variants.differences(both, context), rows)


@query(_EDITED + "SELECT aln_id, ref_id, qry_id, p1, p2, sub_r, sub_q, buff, dist, con_r, 0 AS con_q, ctx_r, ctx_q FROM f")
def snps_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited_snps(spark, sf_dir, context=2).select("aln_id", "ref_id", "qry_id", "p1", "p2", "sub_r", "sub_q", "buff", "dist", "con_r", "con_q", "ctx_r", "ctx_q")


@query(_EDITED + "SELECT aln_id, p1, p2, sub_r, sub_q FROM f WHERE con_r = 0")
def snps_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.unambiguous(_edited_snps(spark, sf_dir)).select("aln_id", "p1", "p2", "sub_r", "sub_q")


@query(_EDITED + "SELECT aln_id, p1, p2, sub_r, sub_q FROM f WHERE sub_r <> '.' AND sub_q <> '.'")
def snps_without_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.without_indels(_edited_snps(spark, sf_dir)).select("aln_id", "p1", "p2", "sub_r", "sub_q")


@query(_EDITED + """, g AS (SELECT *, CASE WHEN sub_r = '.' THEN 'I' WHEN sub_q = '.' THEN 'D' ELSE 'S' END AS kind FROM f),
h AS (SELECT *, CASE kind WHEN 'S' THEN col ELSE col - row_number() OVER (PARTITION BY aln_id, kind ORDER BY col) END AS run FROM g),
v AS (SELECT ref_id, aln_id, kind, any_value(r) AS r, CASE kind WHEN 'D' THEN min(p1) - 1 ELSE min(p1) END AS pos, string_agg(sub_r, '' ORDER BY col) AS gone, string_agg(sub_q, '' ORDER BY col) AS come FROM h GROUP BY ref_id, aln_id, kind, run),
b AS (SELECT *, upper(substring(r, pos, 1)) AS base FROM v)
SELECT ref_id AS chrom, pos, CASE kind WHEN 'S' THEN gone WHEN 'D' THEN base || gone ELSE base END AS ref, CASE kind WHEN 'S' THEN come WHEN 'I' THEN base || come ELSE base END AS alt
FROM b QUALIFY row_number() OVER (PARTITION BY ref_id, pos ORDER BY aln_id, kind) = 1""")
def vcf_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of indels are one variant, and of two alignments at a place the first wins."""
    return variants.vcf_rows(variants.differences(_edited(spark, sf_dir)[1]), table(spark, sf_dir, "benchmark", dna=True))


@query(_EDITED + """, o AS (SELECT *, CASE WHEN x IS NULL THEN 'I' WHEN y IS NULL THEN 'D' ELSE 'M' END AS op FROM z),
i AS (SELECT *, col - row_number() OVER (PARTITION BY aln_id, op ORDER BY col) AS run FROM o),
q AS (SELECT aln_id, kind, op, run, min(col) AS col, count(*) AS n FROM i GROUP BY ALL),
t AS (SELECT aln_id, CASE kind WHEN 'a' THEN '2S' ELSE '2S' END || string_agg(n || op, '' ORDER BY col) || CASE kind WHEN 'a' THEN '3S' ELSE '1S' END AS cigar FROM q GROUP BY aln_id, kind),
m AS (SELECT *, p1 - lo + 1 AS nth, y IS NULL AS gone, coalesce(lag(y IS NULL) OVER (PARTITION BY aln_id ORDER BY col), false) AS before FROM z WHERE x IS NOT NULL),
u AS (SELECT *, nth - coalesce(lag(nth) OVER (PARTITION BY aln_id ORDER BY col), 0) - 1 AS same FROM m WHERE x IS DISTINCT FROM y),
x AS (SELECT aln_id, string_agg(CASE WHEN gone AND before THEN '' ELSE same || CASE WHEN gone THEN '^' ELSE '' END END || upper(x), '' ORDER BY col) AS md, max(nth) AS last FROM u GROUP BY aln_id),
y AS (SELECT aln_id, max(p1 - lo + 1) AS size, sum((x IS DISTINCT FROM y)::INT)::BIGINT AS nm FROM z GROUP BY aln_id)
SELECT aln_id, cigar, coalesce(md, '') || (size - coalesce(last, 0)) AS md, nm FROM t JOIN y USING (aln_id) LEFT JOIN x USING (aln_id)""")
def sam_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGAR with clips on both strands, and MD."""
    return variants.sam_columns(_edited(spark, sf_dir)[1]).select("aln_id", "cigar", "md", "nm")
