"""Exact matches: ``ref_id, qry_id, strand, s1, s2, len``, coordinates from 1, on the strand that was searched.

Maximal matches come in one of two ways. A reference that is proven small (its letters are counted
first) is broadcast as a sorted table of window hashes and queries stream past it, and nothing is
shuffled. A larger one is joined by sampled seeds (``seeds.sampled``), which any two equal stretches of
enough letters share; a seed that is very frequent is dealt over a grid of tasks. Either way hits that
follow each other on a diagonal are runs (gaps and islands), and letters are compared when matches are
assembled: a match is what is equal, whatever hashes say. Letters travel as short pieces of
their sequences, and what is equal over the border of two pieces is glued. Uniqueness is decided by
interval containment with running maxima, never by joining matches with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import flip, reverse_complement
from helixframe.operators.seeds import code_points, sampled, seed_length, slices, window_hashes

SCHEMA = "ref_id string, qry_id string, strand int, s1 long, s2 long, len long"
#: Letters of reference up to which it is broadcast: eight bytes of hash and four of place for each.
BROADCAST_LETTERS = 8_000_000


def strands(queries: DataFrame, strand: str = "forward") -> DataFrame:
    """Queries with ``strand`` 1 or -1; reverse rows hold the reverse complement."""
    forward = queries.select("seq_id", "seq", F.lit(1).alias("strand"))
    reverse = queries.select("seq_id", reverse_complement(F.col("seq")).alias("seq"), F.lit(-1).alias("strand"))
    return {"forward": forward, "reverse": reverse, "both": forward.unionByName(reverse)}[strand]


def maximal_matches(refs: DataFrame, queries: DataFrame, length: int = 20, strand: str = "forward", nucleotides_only: bool = False, broadcast_letters: int = BROADCAST_LETTERS) -> DataFrame:
    """All matches of at least ``length`` letters that can be extended neither way."""
    if nucleotides_only:
        refs = refs.withColumn("seq", F.regexp_replace("seq", "[^acgt]", "#"))
        queries = queries.withColumn("seq", F.regexp_replace("seq", "[^acgt]", "~"))
    known = refs.agg(F.sum("len")).first()[0] or 0
    dealt = strands(queries, strand)
    return _streamed(refs, dealt, length) if known <= broadcast_letters else _joined(refs, dealt, length)


def _streamed(refs: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    found = refs.select("seq_id", "seq").orderBy("seq_id").toArrow()  # at most BROADCAST_LETTERS letters
    names = found.column(0).to_pylist()
    letters = [code_points(s or "") for s in found.column(1).to_pylist()]
    hashes = [window_hashes(x, length) for x in letters]
    table = np.concatenate([np.empty(0, np.uint64), *hashes])
    of = np.concatenate([np.empty(0, np.int32), *[np.full(len(h), i, np.int32) for i, h in enumerate(hashes)]])
    at = np.concatenate([np.empty(0, np.int64), *[np.arange(len(h)) for h in hashes]])
    order = np.argsort(table, kind="stable")
    shared = queries.sparkSession.sparkContext.broadcast((names, letters, table[order], of[order], at[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, letters, table, of, at = shared.value
        known = marked(table)
        for b in batches:
            out: list[tuple] = []
            for seq_id, seq, way in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                mine = code_points(seq or "")
                k, q = hits_of(table, window_hashes(mine, length), known)
                for r, p, place, size in diagonal_runs(of[k], at[k], q, length):
                    out += [(names[r], seq_id, way, p + i + 1, place + i + 1, n) for i, n in equal_runs(letters[r][p : p + size], mine[place : place + size], length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(KINDS)], names=NAMES)

    return queries.select("seq_id", "seq", "strand").mapInArrow(run, SCHEMA)


NAMES, KINDS = ["ref_id", "qry_id", "strand", "s1", "s2", "len"], (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def marked(table: np.ndarray) -> np.ndarray:
    """Which first bits the hashes of ``table`` have: a few more bits than tell its rows apart, at most 24."""
    bits = min(max(len(table).bit_length() + 5, 10), 24)
    known = np.zeros(1 << bits, bool)
    known[table >> np.uint64(64 - bits)] = True
    return known


def hits_of(table: np.ndarray, own: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``table`` and in ``own`` of all equal hashes; hashes that are not ``marked`` are not searched."""
    if known is not None:
        some = np.flatnonzero(known[own >> np.uint64(65 - len(known).bit_length())])
        k, q = hits_of(table, own[some])
        return k, some[q]
    lo, hi = np.searchsorted(table, own, "left"), np.searchsorted(table, own, "right")
    n = hi - lo
    q = np.repeat(np.arange(len(own)), n)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q)), q


def diagonal_runs(of: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """``sequence, p, q, size`` of consecutive hits on the diagonals of each sequence."""
    if not len(q):
        return []
    order = np.lexsort((q, p - q, of))
    of, p, q = of[order], p[order], q[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (q[1:] != q[:-1] + 1)]))
    sizes = np.diff(np.append(first, len(q))) + length - 1
    return list(zip(of[first].tolist(), p[first].tolist(), q[first].tolist(), sizes.tolist(), strict=True))


def equal_runs(one: np.ndarray, two: np.ndarray, length: int) -> list[tuple[int, int]]:
    """``start, size`` of the stretches of at least ``length`` equal letters."""
    apart = np.flatnonzero(one != two)
    if not len(apart):
        return [(0, len(one))]
    starts, ends = np.concatenate([[0], apart + 1]), np.append(apart, len(one))
    return [(int(a), int(z - a)) for a, z in zip(starts, ends, strict=True) if z - a >= length]


#: Letters of one piece of a sequence.
PIECE = 1 << 14
#: Seeds of each side that may be dealt over a grid of tasks, and rows of either side that one of these tasks has.
HOTTEST, HOT_ROWS = 1000, 1 << 13


def pieces(seqs: DataFrame, id_column: str, size: int = PIECE, overlap: int = 0) -> DataFrame:
    """``id_column, part, letters``: each sequence in pieces of ``size`` letters, with the ``overlap`` letters after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for seq_id, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = range(-(-len(seq) // size))
                yield pa.RecordBatch.from_arrays([pa.array([seq_id] * len(parts), pa.string()), pa.array(parts, pa.int64()), pa.array([seq[k * size : (k + 1) * size + overlap] for k in parts], pa.string())], names=[id_column, "part", "letters"])

    return seqs.select("seq_id", F.coalesce("seq", F.lit("")).alias("seq")).mapInArrow(run, f"{id_column} string, part long, letters string")


def with_letters(rows: DataFrame, seqs: DataFrame, id_column: str, start: str, name: str, size: int = PIECE) -> DataFrame:
    """Add ``name``: the letters of each row's stretch; rows join the pieces of the sequence that they lie in."""
    first, last = F.floor((F.col(start) - 1) / size), F.floor((F.col(start) + F.greatest(F.col("len"), F.lit(1)) - 2) / size)
    placed = rows.withColumn("_first", first).withColumn("_last", last)
    held = pieces(seqs, id_column, size).select(F.col(id_column).alias("_id"), F.col("part").alias("_part"), F.col("letters").alias("_letters"))

    def cut(df: DataFrame) -> DataFrame:
        begin = F.greatest(F.col(start), F.col("_part") * size + 1)
        end = F.least(F.col(start) + F.col("len"), (F.col("_part") + 1) * size + 1)
        met = df.join(held.withColumnRenamed("_part", "_of"), (F.col("_id") == F.col(id_column)) & (F.col("_of") == F.col("_part")))
        return met.withColumn("_cut", F.substring(F.col("_letters"), (begin - F.col("_part") * size).cast("int"), (end - begin).cast("int")))

    own = rows.columns
    within = cut(placed.filter("_first = _last").withColumn("_part", F.col("_first"))).select(*own, F.col("_cut").alias(name))
    # rows over a border: each once for every piece, equal rows counted and given back
    over = placed.filter("_first < _last").groupBy(*own, "_first", "_last").agg(F.count(F.lit(1)).alias("_n"))
    apart = cut(over.withColumn("_part", F.explode(F.sequence("_first", "_last"))))
    whole = apart.groupBy(*own, "_n").agg(F.array_sort(F.collect_list(F.struct("_part", "_cut"))).alias("_cuts"))
    joined = whole.withColumn(name, F.array_join(F.transform("_cuts", lambda c: c["_cut"]), "")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return within.unionByName(joined.select(*own, name))


def _by_seed(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``ref_id, way_id, s1, s2`` of all equal seeds. The rows of the ``HOTTEST`` seeds of either side, if over ``HOT_ROWS``, are dealt over a grid of tasks."""
    counts: dict[int, list[int]] = {}
    for side, rows in enumerate((ours, theirs)):
        hot = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOTTEST)
        for r in hot.collect():
            counts.setdefault(r.kmer, [1, 1])[side] = -(-r.n // HOT_ROWS)
    out = ["ref_id", "way_id", "s1", "s2"]
    if not counts:
        return ours.join(theirs, "kmer").select(*out)
    grid = F.broadcast(ours.sparkSession.createDataFrame([(k, *parts) for k, parts in counts.items()], "kmer long, parts1 int, parts2 int"))
    hot = F.col("kmer").isin(list(counts))
    rows1, rows2 = (side.filter(hot).join(grid, "kmer") for side in (ours, theirs))
    part = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows1 = rows1.select("kmer", "ref_id", "s1", part("parts1", "ref_id", "s1").alias("part1"), every("parts2").alias("part2"))
    rows2 = rows2.select("kmer", "way_id", "s2", every("parts1").alias("part1"), part("parts2", "way_id", "s2").alias("part2"))
    calm = ours.filter(~hot).join(theirs.filter(~hot), "kmer").select(*out)
    return calm.unionByName(rows1.join(rows2, ["kmer", "part1", "part2"]).select(*out))


def _keyed(queries: DataFrame) -> DataFrame:
    """Dealt queries under names that hold the strand."""
    return queries.select(F.concat_ws("\t", F.col("strand").cast("string"), "seq_id").alias("seq_id"), "seq")


def _joined(refs: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    return _from_seeds(sampled(refs, length), refs, _keyed(queries), length, seed_length(length))


def from_index(seeds: DataFrame, refs: DataFrame, queries: DataFrame, length: int, strand: str = "forward", seed: int | None = None) -> DataFrame:
    """Maximal matches against a reference whose seeds were taken before (``seq_id, pos, kmer``, as saved and loaded).

    ``seeds`` are those of ``sampled(refs, length, seed)``; of ``extract(refs, length)`` if ``seed`` is ``length``.
    """
    return _from_seeds(seeds, refs, _keyed(strands(queries, strand)), length, seed or seed_length(length))


def _from_seeds(seeds: DataFrame, refs: DataFrame, keyed: DataFrame, length: int, seed: int) -> DataFrame:
    ours = seeds.select(F.col("seq_id").alias("ref_id"), F.col("pos").alias("s1"), "kmer")
    theirs = sampled(keyed, length, seed).select(F.col("seq_id").alias("way_id"), F.col("pos").alias("s2"), "kmer")
    return verified(islands(_by_seed(ours, theirs), length, seed), refs, keyed, length)


def islands(hits: DataFrame, length: int, seed: int) -> DataFrame:
    """``ref_id, way_id, s1, s2, len``: stretches that hold every match of at least ``length`` letters with the ``hits`` on its diagonal.

    Within a match hits are at most ``length - seed + 1`` letters apart, and it reaches less than that beyond them.
    """
    span = length - seed + 1
    on = Window.partitionBy("ref_id", "way_id", "diagonal").orderBy("s1")
    rows = hits.withColumn("diagonal", F.col("s1") - F.col("s2"))
    rows = rows.withColumn("_new", F.coalesce((F.col("s1") - F.lag("s1").over(on) > span).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("_new").over(on))
    found = rows.groupBy("ref_id", "way_id", "diagonal", "run").agg(F.min("s1").alias("first"), F.max("s1").alias("last"))
    back = F.least(F.lit(span - 1), F.col("first") - 1, F.col("first") - F.col("diagonal") - 1)
    found = found.withColumn("s1", F.col("first") - back)
    return found.select("ref_id", "way_id", "s1", (F.col("s1") - F.col("diagonal")).alias("s2"), (F.col("last") - F.col("s1") + seed + span - 1).alias("len"))


def verified(stretches: DataFrame, refs: DataFrame, keyed: DataFrame, length: int, size: int = PIECE) -> DataFrame:
    """Matches of at least ``length`` equal letters in ``stretches`` (``ref_id, way_id, s1, s2, len``); ``keyed`` has the queries by strand and id."""
    # cut at the reference's pieces; a query piece holds the letters of the next one too
    first, last = F.floor((F.col("s1") - 1) / size), F.floor((F.col("s1") + F.col("len") - 2) / size)
    cut = stretches.withColumn("part1", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("s1"), F.col("part1") * size + 1)
    end = F.least(F.col("s1") + F.col("len"), (F.col("part1") + 1) * size + 1)
    cut = cut.select("ref_id", "way_id", begin.alias("s1"), (begin - F.col("s1") + F.col("s2")).alias("s2"), (end - begin).alias("len"), "part1", (begin > F.col("s1")).alias("left"), (end < F.col("s1") + F.col("len")).alias("right"))
    cut = cut.withColumn("part2", F.floor((F.col("s2") - 1) / size))
    ours = pieces(refs, "ref_id", size).select("ref_id", F.col("part").alias("part1"), F.col("letters").alias("one"))
    theirs = pieces(keyed, "way_id", size, size).select("way_id", F.col("part").alias("part2"), F.col("letters").alias("two"))
    inner = lambda text, start, part: F.substring(F.col(text), (F.col(start) - F.col(part) * size).cast("int"), F.col("len").cast("int")).alias(text)
    kept = ["ref_id", "way_id", "s1", "s2", "len", "left", "right"]
    met = cut.join(ours, ["ref_id", "part1"]).select(*kept, "part2", inner("one", "s1", "part1"))
    met = met.join(theirs, ["way_id", "part2"]).select(*kept, "one", inner("two", "s2", "part2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for ref_id, way_id, s1, s2, size_, left, right, one, two in zip(*[b.column(i).to_pylist() for i in range(9)], strict=True):
                n = min(len(one), len(two))
                for i, m in equal_runs(code_points(one[:n]), code_points(two[:n]), 1 if left or right else length):
                    before, after = left and i == 0, right and i + m == size_
                    if m and (m >= length or before or after):
                        out.append((ref_id, way_id, s1 + i, s2 + i, m, before, after))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["ref_id", "way_id", "s1", "s2", "len", "left", "right"])

    runs = met.mapInArrow(run, "ref_id string, way_id string, s1 long, s2 long, len long, left boolean, right boolean")
    plain = ["ref_id", "way_id", "s1", "s2", "len"]
    # runs that touch a border go on where the one before ends
    diagonal = F.col("s1") - F.col("s2")
    on = Window.partitionBy("ref_id", "way_id", diagonal).orderBy("s1")
    touching = runs.filter("left OR right").withColumn("_new", F.coalesce((F.lag(F.col("s1") + F.col("len")).over(on) < F.col("s1")).cast("int"), F.lit(0)))
    touching = touching.withColumn("_run", F.sum("_new").over(on)).groupBy("ref_id", "way_id", diagonal.alias("_diagonal"), "_run")
    glued = touching.agg(F.min("s1").alias("s1"), F.min("s2").alias("s2"), (F.max(F.col("s1") + F.col("len")) - F.min("s1")).alias("len")).filter(F.col("len") >= length)
    found = runs.filter("NOT left AND NOT right").select(*plain).unionByName(glued.select(*plain))
    way = F.split("way_id", "\t", 2)
    return found.select("ref_id", way[1].alias("qry_id"), way[0].cast("int").alias("strand"), "s1", "s2", "len")


def _outermost(matches: DataFrame, over: list[str], start: str) -> DataFrame:
    """Matches whose interval on one side lies in no other's among those of equal ``over``."""
    end = F.col(start) + F.col("len")
    ahead = Window.partitionBy(*over).orderBy(F.col(start), end.desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*over).orderBy(F.col(start), end.desc())
    rows = matches.withColumn("_reach", F.max(end).over(ahead)).withColumn("_twin", (F.lead(start).over(after) == F.col(start)) & (F.lead("len").over(after) == F.col("len")))
    return rows.filter((F.col("_reach").isNull() | (F.col("_reach") < end)) & ~F.coalesce("_twin", F.lit(False))).drop("_reach", "_twin")


def reference_unique(matches: DataFrame) -> DataFrame:
    """Matches (all maximal ones go in) whose letters occur once in the whole reference set."""
    return _outermost(matches, ["qry_id", "strand"], "s2")


def unique_matches(matches: DataFrame) -> DataFrame:
    """Those that also occur once in their query: both tests against all maximal matches that go in."""
    rows = matches.withColumn("_reach", F.max(F.col("s1") + F.col("len")).over(Window.partitionBy("ref_id", "qry_id", "strand").orderBy(F.col("s1"), F.col("len").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    step = Window.partitionBy("ref_id", "qry_id", "strand").orderBy(F.col("s1"), F.col("len").desc())
    rows = rows.withColumn("_twin", F.coalesce((F.lead("s1").over(step) == F.col("s1")) & (F.lead("len").over(step) == F.col("len")), F.lit(False)))
    rows = rows.withColumn("_alone", (F.col("_reach").isNull() | (F.col("_reach") < F.col("s1") + F.col("len"))) & ~F.col("_twin")).drop("_reach", "_twin")
    return reference_unique(rows).filter("_alone").drop("_alone")


def on_forward_strand(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """Reverse matches' query starts counted on the forward strand."""
    lengths = queries.select(F.col("seq_id").alias("qry_id"), F.col("len").alias("_length"))
    return matches.join(lengths, "qry_id").withColumn("s2", F.when(F.col("strand") < 0, flip(F.col("s2"), F.col("_length"))).otherwise(F.col("s2"))).drop("_length")


def find(seqs: DataFrame, pattern: str | Column) -> DataFrame:
    """``seq_id, pos`` of every occurrence of a pattern (a text or a column of texts), overlapping ones too.

    A sequence is split before each occurrence; where the pieces end is where it occurs.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    quoted = F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pieces = F.split("seq", F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")))
    rows = seqs.filter(F.col("seq").contains(pattern)).select("seq_id", F.startswith("seq", pattern).alias("_first"), pieces.alias("_p"))
    ends = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ends")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["ends"], F.array(a["at"] + F.length(p) + 1)).alias("ends")))["ends"]
    inner = F.slice(ends, F.lit(1), F.size("_p") - 1)  # the last piece ends the sequence
    places = F.when(F.col("_first"), F.concat(F.array(F.lit(1).cast("long")), inner)).otherwise(inner)
    return rows.select("seq_id", F.explode(places).alias("pos"))


#: Letters up to which one task finds the repeats of a sequence by itself.
SELF_LETTERS = 1 << 16


def self_repeats(seqs: DataFrame, length: int = 20, strand: str = "forward", task_letters: int = SELF_LETTERS) -> DataFrame:
    """Pairs of equal stretches within one sequence, extended as far as they go; each pair once.

    ``s1 < s2`` on the forward strand. Reverse rows pair a stretch with one of the reverse
    complement, whose place is given on the forward strand, and are kept if ``s2`` isn't before ``s1``.
    A sequence of more than ``task_letters`` is joined with itself by sampled seeds, in many tasks, with the same rows.
    """
    held = F.length(F.coalesce("seq", F.lit("")))
    whole = _own_repeats(seqs.filter(held <= task_letters), length, strand)
    long = seqs.filter(held > task_letters)
    return whole if long.isEmpty() else whole.unionByName(_joined_repeats(long, length, strand))


def _joined_repeats(seqs: DataFrame, length: int, strand: str) -> DataFrame:
    seed, keyed = seed_length(length), _keyed(strands(seqs, strand))
    way = F.split("way_id", "\t", 2)
    # seeds meet within their sequence only
    ours = sampled(seqs, length).select(F.col("seq_id").alias("ref_id"), F.col("pos").alias("s1"), F.xxhash64("seq_id", "kmer").alias("kmer"))
    theirs = sampled(keyed, length).select(F.col("seq_id").alias("way_id"), F.col("pos").alias("s2"), "kmer").withColumn("kmer", F.xxhash64(way[1], "kmer"))
    # on the forward strand each pair once, and no sequence with itself at the same place
    hits = _by_seed(ours, theirs).filter((F.col("ref_id") == way[1]) & ((way[0] == "-1") | (F.col("s1") < F.col("s2"))))
    found = on_forward_strand(verified(islands(hits, length, seed), seqs, keyed, length), seqs.withColumn("len", F.length("seq")))
    return found.filter((F.col("strand") > 0) | (F.col("s2") >= F.col("s1"))).select(F.col("ref_id").alias("seq_id"), "strand", "s1", "s2", "len")


def _own_repeats(seqs: DataFrame, length: int, strand: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for seq_id, seq, other, way in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                one, two = code_points(seq), code_points(other)
                table = window_hashes(one, length)
                order = np.argsort(table, kind="stable")
                k, q = hits_of(table[order], table if way > 0 else window_hashes(two, length))
                p = order[k]
                if way > 0:  # each pair once
                    p, q = p[p < q], q[p < q]
                for _, at, place, size in diagonal_runs(np.zeros(len(q), np.int32), p, q, length):
                    for i, n in equal_runs(one[at : at + size], two[place : place + size], length):
                        start, other = at + i + 1, place + i + 1 if way > 0 else len(two) - place - i
                        if way > 0 or other >= start:
                            out.append((seq_id, way, start, other, n))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["seq_id", "strand", "s1", "s2", "len"])

    seq = F.coalesce("seq", F.lit(""))
    forward = seqs.select("seq_id", seq.alias("seq"), seq.alias("other"), F.lit(1).alias("strand"))
    reverse = seqs.select("seq_id", seq.alias("seq"), reverse_complement(seq).alias("other"), F.lit(-1).alias("strand"))
    rows = {"forward": forward, "reverse": reverse, "both": forward.unionByName(reverse)}[strand]
    return rows.mapInArrow(run, "seq_id string, strand int, s1 long, s2 long, len long")


def tandem_only(repeats: DataFrame) -> DataFrame:
    """Forward repeats whose two copies touch or overlap."""
    return repeats.filter((F.col("strand") > 0) & (F.col("s1") + F.col("len") >= F.col("s2")))


def exact_tandems(repeats: DataFrame) -> DataFrame:
    """``seq_id, start, extent, unit, copies``: the shortest period at each start."""
    nearest = Window.partitionBy("seq_id", "s1").orderBy("s2")
    rows = tandem_only(repeats).withColumn("_n", F.row_number().over(nearest)).filter("_n = 1")
    extent, unit = F.col("s2") + F.col("len") - F.col("s1"), F.col("s2") - F.col("s1")
    return rows.select("seq_id", F.col("s1").alias("start"), extent.alias("extent"), unit.alias("unit"), (extent / unit).alias("copies"))
