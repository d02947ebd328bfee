"""Functions of one sequence, as column expressions where built-ins suffice and as plain Python for kernels."""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each nucleotide code stands for.
IUPAC = {
    "a": "a", "c": "c", "g": "g", "t": "t", "r": "ag", "y": "ct", "s": "cg", "w": "at",
    "m": "ac", "k": "gt", "b": "cgt", "d": "agt", "h": "act", "v": "acg",
}
#: Complements of the codes above.
COMPLEMENT = str.maketrans("acgtryswmkbdhvACGTRYSWMKBDHV", "tgcayrswkmvhdbTGCAYRSWKMVHDB")
#: Amino acids of the 64 codons in the order t, c, a, g of each place.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: Places of bases in that order by character codes, 4 for any other letter; and the amino acids as bytes.
CODON_BASES = np.full(256, 4, np.uint8)
CODON_BASES[np.frombuffer(b"tcaguTCAGU", np.uint8)] = [0, 1, 2, 3, 0] * 2
CODONS = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)


def reverse_complement(seq: Column) -> Column:
    """Of acgt; other letters become n."""
    return F.reverse(F.translate(F.regexp_replace(F.lower(seq), "[^acgt]", "n"), "acgt", "tgca"))


def reverse_complement_iupac(seq: Column, keep_other: bool = True) -> Column:
    """Of all nucleotide codes; other letters stay, or become n."""
    cleaned = seq if keep_other else F.regexp_replace(seq, "[^acgtryswmkbdhvACGTRYSWMKBDHV]", "n")
    return F.reverse(F.translate(cleaned, "acgtryswmkbdhvACGTRYSWMKBDHV", "tgcayrswkmvhdbTGCAYRSWKMVHDB"))


def reverse_complement_acgtn(seq: Column) -> Column:
    """Of acgtn in either case; other letters stay."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def nucleotides_only(seq: Column) -> Column:
    """Letters other than acgt become ~, which never matches."""
    return F.regexp_replace(F.lower(seq), "[^acgt]", "~")


def clean_letters(seq: Column) -> Column:
    """Lower case without white space; what is neither a letter nor * becomes x."""
    return F.regexp_replace(F.lower(F.regexp_replace(seq, r"\s", "")), "[^a-z*]", "x")


def first_token(header: Column) -> Column:
    """The id in a header line: up to the first white space."""
    return F.regexp_extract(header, r"^>?\s*(\S+)", 1)


def flip(coordinate: Column, length: Column) -> Column:
    """A coordinate on the other strand."""
    return length - coordinate + 1


def dna_view(text: Column) -> Column:
    """Any text as DNA: its letters a-z, dealt to acgt in turn; near-copies stay near-identical."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac")


def alignment_total(s1: Column, e1: Column, deltas_below: Column, protein: Column | None = None) -> Column:
    """Alignment columns: reference span (in amino acids for protein) and bases that only the query has."""
    span = F.abs(e1 - s1) + 1
    return (span if protein is None else F.when(protein, F.floor(span / 3)).otherwise(span)) + deltas_below


def percent(total: Column, off: Column) -> Column:
    return (total - off) * 100.0 / total


def stop_percent(total: Column, stops: Column) -> Column:
    return stops * 100.0 / (2 * total)


def revcomp(seq: str) -> str:
    """Plain twin of :func:`reverse_complement_iupac`."""
    return seq.translate(COMPLEMENT)[::-1]


@cache
def compatible(x: str, y: str) -> bool:
    """Whether reference letter ``x`` and query letter ``y`` may be the same base; n and x match all.

    Codes match if one stands for a subset of the other's bases. Fixed exception: y accepts b, but not the reverse order.
    """
    x, y = x.lower(), y.lower()
    if x in "nx" or y in "nx":
        return True
    if x not in IUPAC or y not in IUPAC:
        return False
    if len(IUPAC[x]) == 3 and len(IUPAC[y]) > 1:
        return x == y
    return set(IUPAC[x]) <= set(IUPAC[y]) or set(IUPAC[y]) <= set(IUPAC[x])


@cache
def amino_acid(codon: str) -> str:
    """X where the codon's ambiguity leaves more than one amino acid."""
    codon = codon.lower().replace("u", "t")
    bases = [IUPAC.get(c, "acgt" if c in "nx" else "") for c in codon]
    found = {AMINO_ACIDS[16 * "tcag".index(a) + 4 * "tcag".index(b) + "tcag".index(c)] for a, b, c in product(*bases)}
    return found.pop() if len(found) == 1 else "X"


def translate_frame(seq: str, frame: int) -> str:
    """Frames 1-3 forward, 4-6 on the reverse complement."""
    if frame > 3:
        seq, frame = revcomp(seq), frame - 3
    if seq.isascii():
        bases = CODON_BASES[np.frombuffer(seq.encode(), np.uint8)[frame - 1 :]]
        bases = bases[: len(bases) // 3 * 3].reshape(-1, 3)
        if not len(bases) or bases.max() < 4:
            return CODONS[bases @ np.array([16, 4, 1], np.uint8)].tobytes().decode()
    return "".join([amino_acid(seq[i : i + 3]) for i in range(frame - 1, len(seq) - 2, 3)])


def mask_short_orfs(protein: str, least: int, masked: str) -> str:
    """Stretches between stops shorter than ``least`` become ``masked``; stops become J."""
    return "J".join([part if len(part) >= least else masked * len(part) for part in protein.split("*")])


def protein_to_dna(coordinate: Column, frame: Column, length: Column) -> Column:
    """DNA coordinate of an amino acid's first base, on the forward strand."""
    inner = F.when(frame > 3, frame - 3).otherwise(frame)
    here = 3 * coordinate - (3 - inner)
    return F.when(frame > 3, length - here + 1).otherwise(here)


def common_prefix(one: str, two: str) -> int:
    n = 0
    for a, b in zip(one, two, strict=False):
        if a != b:
            break
        n += 1
    return n
