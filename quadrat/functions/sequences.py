"""Column expressions for nucleotide sequences and base qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the IUPAC letters, and the bases each stands for.
_LETTERS, _COMPLEMENTS = "ACGTRYMKBVDHSWN", "TGCAYRKMVBHDSWN"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: str | Column) -> Column:
    return F.reverse(F.translate(F.upper(_col(c)), _LETTERS, _COMPLEMENTS))


def canonical_strand(c: str | Column) -> Column:
    """The smaller of a sequence and its reverse complement: equal for both strands."""
    return F.least(F.upper(_col(c)), reverse_complement(c))


def occurrences(c: str | Column, letters: str) -> Column:
    s = _col(c)
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_percent(c: str | Column) -> Column:
    """Of the letters A, C, G and T; null where there are none."""
    s = F.upper(_col(c))
    return F.try_divide(100.0 * occurrences(s, "GC"), occurrences(s, "ACGT").cast("double"))


def gc_skew(c: str | Column) -> Column:
    s = F.upper(_col(c))
    return F.try_divide((occurrences(s, "G") - occurrences(s, "C")).cast("double"), occurrences(s, "GC").cast("double"))


def iupac_pattern(primer: str) -> str:
    """Regular expression for a primer with ambiguity letters."""
    return "".join(b if len(b) == 1 else f"[{b}]" for b in (IUPAC[x] for x in primer.upper()))


def mismatches(window: Column, primer: str) -> Column:
    """Positions of a window of the primer's length that the primer doesn't allow."""
    return sum((F.when(F.substring(window, i + 1, 1).isin(list(IUPAC[x])), 0).otherwise(1) for i, x in enumerate(primer.upper())), F.lit(0))


def best_primer_match(c: str | Column, primer: str, window: int = 30) -> Column:
    """(mismatches, start) of the best placement in the first letters; ties to the earliest."""
    s, n = F.upper(_col(c)), len(primer)
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(s), F.lit(window)) - n + 1)), lambda p: F.struct(mismatches(F.substr(s, p, F.lit(n)), primer).alias("mismatches"), (p - 1).alias("start")))
    return F.array_min(places)


def quality_scores(c: str | Column) -> Column:
    """Phred+33 text as an array of numbers."""
    return F.transform(F.filter(F.split(_col(c), ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)


def mean_quality(scores: Column) -> Column:
    """Quality of the mean error probability, which is floored at 1e-10; null without scores."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -q / F.lit(10.0)))
    return F.when(F.size(scores) > 0, -10 * F.log10(F.greatest(total / F.size(scores), F.lit(1e-10))))


def kmers(c: str | Column, k: int) -> Column:
    s = _col(c)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda p: F.substr(s, p, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def fragments(c: str | Column, size: int) -> Column:
    """Cut into parts of that size; the last may be shorter."""
    s = _col(c)
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size)), lambda p: F.substr(s, (p * size + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<string>"))


def open_frames(c: str | Column, stops: list[str], least: int = 150) -> Column:
    """How many of the three forward frames hold no stop codon; frames shorter than least don't count as open."""
    s = F.upper(_col(c))

    def is_open(frame: int) -> Column:
        length = F.floor((F.length(s) - frame) / 3) * 3
        codons = F.regexp_replace(F.substring(s, frame + 1, 2**31 - 1), "(?s)(.{3})", "$1,")  # one pass; a place in a string costs a walk to it
        return F.when((length >= least) & ~codons.rlike("(?:" + "|".join(stops) + "),"), 1).otherwise(0)

    return is_open(0) + is_open(1) + is_open(2)
