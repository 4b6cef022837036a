"""Column expressions for names: blanks, ranks, keys and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing name, and of a suffix for one that was not resolved.
BLANK = r"(?i)^(na|nan|null|unknown|unassigned|unclassified|uncultured|undetermined)$"
UNRESOLVED = r"(?i)--+(other|unclassified|uncultured|unknown)$"
# The cell texts that count tables use for a missing value.
MISSING = ["", "NA", "nan", "None"]
# Two genus names of one group, and the label they share.
HAEMOPLASMA = ["Eperythrozoon", "Haemobartonella"]
HAEMOPLASMA_LABEL = "Haemoplasma group"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c: str | Column) -> Column:
    """Trimmed text; null for the cell texts that mean a missing value."""
    t = F.trim(_col(c))
    return F.when(~t.isin(MISSING), t)


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text; null for empty text and for words such as unclassified."""
    t = F.trim(_col(c))
    return F.when((t != "") & ~t.rlike(BLANK), t)


def clean_label(c: str | Column) -> Column:
    """Without a rank prefix such as ``g__``; Unclassified where nothing is left."""
    return F.coalesce(blank_to_null(F.regexp_replace(F.trim(_col(c)), "^[a-z]__", "")), F.lit("Unclassified"))


def clean_genus(c: str | Column) -> Column:
    """Genus without an unresolved suffix, synonyms merged; null for blanks."""
    g = blank_to_null(F.regexp_replace(F.trim(_col(c)), UNRESOLVED, ""))
    return F.when(g.isin(HAEMOPLASMA), HAEMOPLASMA_LABEL).otherwise(g)


def clean_midori(c: str | Column) -> Column:
    """Without the taxon number that follows the name (``Name_1234``)."""
    return blank_to_null(F.regexp_replace(_col(c), r"_\d+$", ""))


def clean_pr2(c: str | Column, species: bool = False) -> Column:
    """Null for ranks that the source leaves undefined (``_X``, ``_sp.``); species names get blanks."""
    v = _col(c)
    kept = F.when(~v.rlike(r"_X+$") & ~v.rlike(r"(?i)_sp\.?$"), v)
    return F.translate(kept, "_", " ") if species else kept


def rank_label(ranks: list[str], rank: str) -> Column:
    """Name at the rank, else '<deepest higher name> unidentified', else Unassigned."""
    above = ranks[: ranks.index(rank)][::-1]
    options = [missing_to_null(rank), *(F.concat(missing_to_null(r), F.lit(" unidentified")) for r in above)]
    return F.coalesce(*options, F.lit("Unassigned"))


def species_label(genus: str | Column, species: str | Column) -> Column:
    """Species name; a bare epithet is put behind its genus; Unclassified for blanks and '... sp.'."""
    s, g = blank_to_null(species), clean_genus(genus)
    named = F.when(s.contains(" ") | g.isNull(), s).otherwise(F.concat_ws(" ", g, s))
    return F.when(s.isNull() | s.endswith(" sp.") | (s == "sp."), "Unclassified").otherwise(named)


def analysis_label(rank: str) -> Column:
    """Label of a rank in profiles: cleaned, Unclassified for blanks."""
    if rank == "species":
        return species_label("genus", "species")
    value = clean_genus("genus") if rank == "genus" else blank_to_null(F.regexp_replace(F.trim(F.col(rank)), UNRESOLVED, ""))
    return F.coalesce(value, F.lit("Unclassified"))


def deepest_name(ranks: list[str]) -> Column:
    """Name of the deepest rank that has one."""
    return F.coalesce(*(missing_to_null(r) for r in reversed(ranks)))


def deepest_rank(ranks: list[str]) -> Column:
    """The deepest rank that has a name, else none."""
    return reduce(lambda rest, r: F.when(missing_to_null(r).isNotNull(), r).otherwise(rest), ranks, F.lit("none"))


def folded_key(c: str | Column) -> Column:
    """Lower case, letters and digits only: how names of samples are matched."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def is_dna(c: str | Column, least: int = 20) -> Column:
    return _col(c).rlike(f"(?i)^[ACGTUNRYSWKMBDHV]{{{least},}}$")


def valid_binomial(c: str | Column) -> Column:
    """Two words or more, genus capitalised, epithet in lower case and no open name (sp., cf., uncultured ...)."""
    v = F.trim(_col(c))
    return v.rlike(r"^[A-Z][a-z]+ [a-z][a-z-]+") & ~v.rlike(r"(?i)(^| )(sp|cf|aff|nr|gen|uncultured|environmental|unidentified|hybrid|x)\.?( |$)")


def natural_key(c: str | Column) -> Column:
    """Sort key in which runs of digits compare as numbers: they are padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def safe_name(c: str | Column) -> Column:
    """Letters, digits, dot, dash and underscore; runs of anything else become one underscore."""
    return F.regexp_replace(F.trim(_col(c)), r"[^A-Za-z0-9._-]+", "_")


def strip_markup(c: str | Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), "<[^>]*>", " "), r"\s+", " "))


def number_or_null(c: str | Column) -> Column:
    """Tolerant cast: thousands separators and blanks go, anything else is null."""
    return F.regexp_replace(F.trim(_col(c)), ",", "").try_cast("double")


def base_pairs(c: str | Column) -> Column:
    """'4.6 Mb', '800k', '1,200 bp' as a number of base pairs."""
    t = F.lower(F.regexp_replace(F.trim(_col(c)), ",", ""))
    n, unit = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)\s*([kmg]?)b?p?$", 1), F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)\s*([kmg]?)b?p?$", 2)
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(n != "", n.try_cast("double") * scale)
