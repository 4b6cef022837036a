"""Names from alignment hits: ties, common ancestors, identity limits, agreement of two databases, consensus.

Hits are (query, subject, pident, bitscore, qcov); lineages (subject, ranks..., source, species_all).
Each name is made of grouped sets of the ranks and one expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.labels import deepest_rank, valid_binomial

RANKS = ["phylum", "class", "order", "family", "genus", "species"]
# Least identity for a name at each rank; identity within which hits tie.
LIMITS = {"species": 98.5, "genus": 95.0, "family": 90.0, "order": 85.0, "class": 80.0}
TIE = 0.5
# Classes of fish, and of chordates that are no vertebrates.
FISH = ["Actinopteri", "Chondrichthyes", "Cladistia", "Coelacanthimorpha", "Dipnomorpha", "Hyperoartia", "Myxini", "Actinopterygii", "Dipnoi", "Petromyzonti", "Elasmobranchii", "Holocephali"]
NOT_VERTEBRATE = ["Ascidiacea", "Thaliacea", "Appendicularia", "Leptocardii"]


def _name(rank: str) -> Column:
    return F.when(F.col(rank) != "", F.col(rank))


def in_limit(limit: str) -> Column:
    """Whether a lineage belongs to the taxonomic limit: all, fish or vertebrates. Records of the fish-only source need no class."""
    if limit == "all":
        return F.lit(True)
    fish_only = _name("class").isNull() & F.forall(F.split(F.coalesce("source", F.lit("")), ";"), lambda x: x == "MitoFish")
    own = F.col("class").isin(FISH) if limit == "fish" else (F.col("phylum") == "Chordata") & ~F.coalesce(F.col("class").isin(NOT_VERTEBRATE), F.lit(False))
    return fish_only | F.coalesce(own, F.lit(False))


def _sets(ranks: list[str]) -> list[Column]:
    """Distinct names of each rank among a group's rows, and whether a row lacks one."""
    return [c for r in ranks for c in (F.sort_array(F.collect_set(_name(r))).alias(f"{r}_set"), F.bool_or(_name(r).isNull()).alias(f"{r}_gap"))]


def walk(ranks: list[str]) -> dict[str, Column]:
    """Common ancestor: a rank is judged on the rows that name it; disagreement ends the walk."""
    out, open_ = {}, F.lit(True)
    for r in ranks:
        open_ = open_ & (F.size(f"{r}_set") <= 1)
        out[r] = F.when(open_, F.get(f"{r}_set", F.lit(0)))
    return out


def tie_ancestor(ranks: list[str]) -> dict[str, Column]:
    """Common ancestor of tied hits: the deepest rank that every row names alike stands, ranks above it come from the agreed name or the best hit (``top``).

    Plain walk where no rank is unanimous, or the ties are of several classes.
    """
    plain = walk(ranks)
    depth = F.lit(-1)
    for i, r in enumerate(ranks):
        depth = F.when((F.size(f"{r}_set") == 1) & ~F.col(f"{r}_gap"), i).otherwise(depth)
    depth = F.when(F.size("class_set") > 1, -1).otherwise(depth) if "class" in ranks else depth
    return {r: F.when(depth < 0, plain[r]).when(depth >= i, F.when(F.size(f"{r}_set") == 1, F.get(f"{r}_set", F.lit(0))).otherwise(F.col(f"top.{r}"))) for i, r in enumerate(ranks)}


def assign(hits: DataFrame, lineages: DataFrame, limit: str = "all", limits: dict[str, float] | None = None, ranks: list[str] = RANKS, tie: float = TIE) -> DataFrame:
    """One row per query with a known subject: name by tied best hits, cut by identity.

    The best hit has the largest bitscore, then identity, then the smallest subject. Hits inside the limit are used unless
    the best outside is more than ``tie`` closer. n_ties: different species among the tied hits.
    """
    limits = LIMITS if limits is None else limits
    h = hits.join(lineages, "subject").withColumn("inside", in_limit(limit))
    own = Window.partitionBy("query")
    order = [F.desc("bitscore"), F.desc("pident"), F.col("subject")]
    best, inside = F.first("pident").over(own.orderBy(*order)), F.max(F.when(F.col("inside"), F.struct("bitscore", "pident"))).over(own)
    h = h.withColumn("off", inside.isNull() | (best > inside["pident"] + tie))
    pool = h.where(F.col("off") | F.col("inside"))
    columns = F.struct("pident", "qcov", "subject", *ranks, "source")
    pool = pool.withColumn("top", F.first(columns).over(own.orderBy(*order)))
    tied = pool.where(F.col("pident") >= F.col("top.pident") - tie)
    species = F.when(F.size(F.coalesce("species_all", F.array().cast("array<string>"))) > 0, F.col("species_all")).otherwise(F.array_compact(F.array(_name("species"))))
    s = tied.groupBy("query").agg(*_sets(ranks), F.first("top").alias("top"), F.first("off").alias("off"), F.size(F.array_distinct(F.flatten(F.collect_set(species)))).alias("n_ties"))
    named = s.select("query", *(F.when(F.col("top.pident") >= limits.get(r, 0.0), c).alias(r) for r, c in tie_ancestor(ranks).items()), F.col("top.subject").alias("best_subject"), F.col("top.pident").alias("pident"), F.col("top.qcov").alias("qcov"), "n_ties", F.when(F.col("off"), "no").otherwise("yes").alias("target"))
    return named.withColumn("rank_reached", deepest_rank(ranks))


def first_hit(hits: DataFrame, lineages: DataFrame, order: str | list[str], limits: dict[str, float] | None = None, ranks: list[str] = RANKS) -> DataFrame:
    """Name of the first hit in file order, cut by identity. order: a column, or several where one leaves ties."""
    limits = LIMITS if limits is None else limits
    first = hits.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy(*([order] if isinstance(order, str) else order)))).where("__r = 1").join(lineages, "subject", "left")
    return first.select("query", "subject", "pident", *(F.when(F.col("pident") >= limits.get(r, 0.0), _name(r)).alias(r) for r in ranks))


def consensus(hits: DataFrame, lineages: DataFrame, within: float = TIE, least: float = 0.8, limits: dict[str, float] | None = None, ranks: list[str] = RANKS) -> DataFrame:
    """Name by hits within ``within`` of the best identity: at each rank the name of at least ``least`` of the hits that have one.

    Ranks are walked from the top: one without any name is skipped, one without enough agreement ends the walk.
    """
    limits = LIMITS if limits is None else limits
    near = hits.withColumn("best", F.max("pident").over(Window.partitionBy("query"))).where(F.col("pident") >= F.col("best") - within).join(lineages, "subject")
    long = near.select("query", "best", F.posexplode(F.array(*(_name(r) for r in ranks))).alias("rank_no", "name"))
    per = long.where("name IS NOT NULL").groupBy("query", "rank_no", "name").agg(F.count("*").alias("n"))
    own = Window.partitionBy("query", "rank_no")
    win = per.withColumn("all", F.sum("n").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.desc("n"), "name"))).where("r = 1")
    picks = win.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("rank_no", F.struct((F.col("n") / F.col("all") >= least).alias("ok"), "name")))).alias("m"))
    s = near.select("query", "best").distinct().join(picks, "query", "left").select("query", "best", F.coalesce("m", F.expr("cast(map() as map<int, struct<ok:boolean, name:string>>)")).alias("m"))
    open_, out = F.lit(True), []
    for i, r in enumerate(ranks):
        pick = F.col("m")[i]
        open_ = open_ & F.coalesce(pick["ok"], F.lit(True))
        out.append(F.when(open_ & (F.col("best") >= limits.get(r, 0.0)), pick["name"]).alias(r))
    return s.select("query", F.col("best").alias("pident"), *out)


def combine(local: DataFrame, second: DataFrame, genus_lineages: DataFrame, checked: DataFrame, limits: dict[str, float] | None = None, tie: float = TIE) -> DataFrame:
    """Local names held against a second database: an agreement word for each query, and the name that stands.

    local: assign()'s columns with best_name. second: (query, rank, species, pident, accession), best first by rank.
    checked: (query) that were sent to the second database. genus_lineages: (genus, phylum, class, order, family).
    Decided in this order: not_checked, ncbi_no_hit, ncbi_only, ncbi_no_hit (no named hit), agree, ncbi_tie, local_better,
    outside_limit, differ. A name that differs is cut to the ranks both share from the top.
    """
    limits = LIMITS if limits is None else limits
    named = second.where(valid_binomial("species"))
    top = named.withColumn("best", F.first(F.struct("species", "pident", "accession")).over(Window.partitionBy("query").orderBy("rank")))
    tied = top.where(F.col("pident") >= F.col("best.pident") - tie).groupBy("query").agg(F.first("best").alias("b"), F.collect_set("species").alias("sp"), F.collect_set(F.split("species", " ")[0]).alias("gen"))
    any_hit = second.groupBy("query").agg(F.min_by(F.struct("species", "pident", "accession"), "rank").alias("b0"))
    up = genus_lineages.select(F.col("genus").alias("g"), F.struct(*RANKS[:4], "genus").alias("up"))
    j = local.join(checked.select("query", F.lit(True).alias("was_checked")), "query", "left").join(any_hit, "query", "left").join(tied, "query", "left")
    j = j.withColumn("g", F.split("b.species", " ")[0]).join(up, "g", "left")
    no_local = F.col("rank_reached") == "none"
    own_names = F.when(_name("species").isNotNull(), F.array("species")).otherwise(F.filter(F.transform(F.split(F.coalesce("best_name", F.lit("")), r"\|"), F.trim), lambda x: x != ""))
    shares = F.arrays_overlap(own_names, F.coalesce("sp", F.array().cast("array<string>")))
    bp, lp = F.col("b.pident"), F.coalesce("pident", F.lit(0.0))
    word = (
        F.when(F.col("was_checked").isNull(), "not_checked").when(F.col("b0").isNull(), "ncbi_no_hit").when(no_local, "ncbi_only").when(F.col("b").isNull(), "ncbi_no_hit")
        .when(shares & ((F.size("sp") == 1) | _name("species").isNull()), "agree").when(shares, "ncbi_tie").when(bp < lp - tie, "local_better")
        .when((F.col("target") == "no") & (bp <= lp + tie), "outside_limit").otherwise("differ")
    )
    j = j.withColumn("agreement", word)
    by_species = (F.col("agreement") == "ncbi_only") & (bp >= limits["species"]) & (F.size("sp") == 1)
    by_genus = (F.col("agreement") == "ncbi_only") & (bp >= limits["genus"]) & (F.size("gen") == 1)
    known = F.col("up").isNotNull() | (F.col("g") == F.col("genus"))
    out, same = [], F.lit(True)
    for i, r in enumerate(RANKS):
        mine = _name(r)
        theirs = F.when(F.col("up").isNotNull(), F.col(f"up.{r}")).otherwise(mine) if i < 5 else F.lit(None).cast("string")
        same = same & F.coalesce(mine == theirs, mine.isNull() & theirs.isNull())
        cut = F.lit(None).cast("string") if i == 5 else F.when(known, F.when(same, mine)).when(F.lit(i < 3), mine)
        lifted = F.col("b.species") if r == "species" else F.col("g") if r == "genus" else F.col(f"up.{r}")
        value = F.when(by_species, lifted).when(by_genus, F.lit(None).cast("string") if r == "species" else lifted)
        value = value.when(F.col("agreement") == "differ", cut)
        if r == "species":
            value = value.when(F.col("agreement") == "ncbi_tie", F.lit(None).cast("string"))
        if r == "genus":
            value = value.when((F.col("agreement") == "ncbi_tie") & (F.size("gen") > 1), F.lit(None).cast("string"))
        out.append(value.otherwise(mine).alias(r))
    check = F.when(F.col("agreement").isin("ncbi_tie", "differ") | by_species | by_genus, "yes").otherwise("")
    return j.select("query", *out, F.col("b0.species").alias("second_best"), F.round("b0.pident", 2).alias("second_pident"), "agreement", check.alias("check")).withColumn("rank_reached", deepest_rank(RANKS))


def genus_lineages(lineages: DataFrame, order: str = "subject") -> DataFrame:
    """(genus, phylum, class, order, family): of each genus the first record that has a family, by that column."""
    full = lineages.where((F.coalesce(F.col("genus"), F.lit("")) != "") & (F.coalesce(F.col("family"), F.lit("")) != ""))
    return full.groupBy("genus").agg(F.min_by(F.struct(*RANKS[:4]), order).alias("up")).select("genus", "up.*")


def placed(names: DataFrame, lineages: DataFrame, order: str = "subject") -> DataFrame:
    """Rows (query, genus) with the ranks above their genus, null where no record has it."""
    return names.join(genus_lineages(lineages, order), "genus", "left")


def verdict(ani: str, borderline: float = 94.0, known: float = 96.0) -> Column:
    """known, borderline or novel by average nucleotide identity; null without one."""
    return F.when(F.col(ani) >= known, "known").when(F.col(ani) >= borderline, "borderline").when(F.col(ani).isNotNull(), "novel")
