"""Column functions on nucleotide sequences."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

# Complements, ambiguity codes and genetic codes (codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG).
BASES = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENTS = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
MITOCHONDRIAL_CODE = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"


def codons(code: str = STANDARD_CODE) -> dict[str, str]:
    return {a + b + c: code[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def count_of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_fraction(seq: Column) -> Column:
    """GC among A, C, G and T; null without any."""
    return F.try_divide(count_of(seq, "GCgc"), count_of(seq, "ACGTacgt"))


def translate(seq: Column, code: str = STANDARD_CODE, stop: bool = True) -> Column:
    """Protein of a coding sequence; unknown codons are X; ends at the first stop if asked."""
    table = F.create_map(*[F.lit(x) for pair in codons(code).items() for x in pair])
    every = F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(...)"), F.lit(1))
    out = F.array_join(F.transform(every, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")
    return F.substring_index(out, "*", 1) if stop else out


def ambiguous(bases: set[str]) -> str:
    """The ambiguity code of a set of bases."""
    return next((k for k, v in AMBIGUITY.items() if set(v) == bases and k != "U"), "N")


def iupac_regex(motif: str) -> str:
    """A motif as a regular expression over plain bases."""
    return "".join(f"[{AMBIGUITY[c]}]" if len(AMBIGUITY[c]) > 1 else AMBIGUITY[c] for c in motif.upper())


def mismatches(piece: Column, motif: str) -> Column:
    """Positions of ``piece`` that the motif's codes do not allow."""
    return sum((~F.substring(piece, i + 1, 1).isin(list(AMBIGUITY[c]))).cast("int") for i, c in enumerate(motif.upper()))


def random_sequence(length: int, seed: Column) -> Column:
    """Random bases with probabilities 0.2 A, 0.3 C, 0.3 G, 0.2 T, a function of ``seed``."""
    def base(i: Column) -> Column:
        u = F.pmod(F.xxhash64(seed, i), F.lit(10))
        return F.when(u < 2, "A").when(u < 5, "C").when(u < 8, "G").otherwise("T")

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "")
