"""Reference collections: lineages of wanted records, gaps filled by genus, what a set of headers holds, and groups of raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions.labels import natural_key

RANKS = ["phylum", "class", "order", "family", "genus", "species"]
#: Levels by number and kind of a reference's headers.
LEVELS = ["Domain", "Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species"]
PR2_LEVELS = ["Kingdom", "Supergroup", "Phylum", "Subdivision", "Class", "Order", "Family", "Genus", "Species"]
# How sequencers name files, barcodes, chunks and folders of failed reads.
FASTQ = r"(?i)\.(fastq|fq)(\.gz)?$"
BARCODE = r"(?i)(?<![A-Za-z0-9])(barcode\d+|unclassified)(?![0-9])"
FAILED = r"(?i)(^|[_\-./])fail([_\-./]|$)"
SEQUENCER = r"(?i)^([A-Z]{3}\d{4,6}_(pass|fail|skip)_|fastq_runid_)"
RUN = r"(?i)^(fastq_runid_[0-9a-f-]+)(?:_\d+)+$"
CHUNK = r"[_.-]\d+$"


def accession_core(c: str | Column) -> Column:
    """An accession without source prefix and version."""
    return F.split(F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), "^(RS_|GB_)", ""), r"\.")[0]


def read_lineages(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(accession, ranks...): lineages of the wanted accessions (accession) alone, without rank prefixes. The list is small and meets the file as it is read."""
    t = spark.read.option("header", True).csv(path)
    key = next(c for c in ("ident", "accession") if c in t.columns)
    ranks = [r for r in ("superkingdom", "domain", *RANKS) if r in t.columns]
    own = wanted.select("accession", accession_core("accession").alias("core")).distinct()
    return t.select(accession_core(key).alias("core"), *(F.regexp_replace(F.trim(r), "^[a-z]__", "").alias(r) for r in ranks)).join(own, "core").select("accession", *ranks)


def filled_lineages(lineages: DataFrame, order: str = "id") -> DataFrame:
    """Lineages whose phylum or class is missing take missing ranks above the species from the first record of their genus that has both.

    The genus of a record without one is the first word of its species.
    """
    full = (F.coalesce(F.col("phylum"), F.lit("")) != "") & (F.coalesce(F.col("class"), F.lit("")) != "")
    upper = RANKS[:-1]
    source = lineages.where(full & (F.coalesce(F.col("genus"), F.lit("")) != "")).groupBy(F.col("genus").alias("g")).agg(F.min_by(F.struct(*upper), order).alias("up"))
    g = F.coalesce(F.nullif(F.col("genus"), F.lit("")), F.split(F.coalesce("species", F.lit("")), " ")[0])
    j = lineages.withColumn("g", g).join(source, "g", "left").withColumn("full", full)
    own = [(F.when(F.col("full"), F.col(r)).otherwise(F.coalesce(F.nullif(F.col(r), F.lit("")), F.col(f"up.{r}"), F.col(r))).alias(r) if r in upper else F.col(r)) for r in lineages.columns]
    return j.select(*own)


def gene_regions(annotations: DataFrame, judged: DataFrame, taxa: DataFrame, lineages: DataFrame, gene: str) -> DataFrame:
    """(accession, start, end, strand, ranks...): first region of a gene in each record, without records judged to be of another species.

    annotations: (accession, gene, start, end, strand); judged: (accession, gene, judge); taxa: (accession, species_id); lineages: (species_id, ranks...).
    """
    bad = judged.where((F.col("gene") == gene) & (F.col("judge") == "Heterospecific")).select("accession").distinct()
    first = annotations.where(F.col("gene") == gene).groupBy("accession").agg(F.min(F.struct("start", "end", "strand")).alias("r")).select("accession", "r.*")
    return first.join(bad, "accession", "left_anti").join(taxa, "accession", "left").join(lineages, "species_id", "left").drop("species_id")


def header_levels(headers: DataFrame) -> DataFrame:
    """(parts) of headers (header): the filled cells of a lineage."""
    return headers.select(F.filter(F.transform(F.split(F.regexp_replace("header", "^>", ""), ";"), F.trim), lambda x: x != "").alias("parts"))


# What tells a record, a kingdom, a taxon number and a bare species epithet; which share of headers decides, how
# many headers must be able to tell, and which share must end in a number.
RECORD, KINGDOM, TAXON_NUMBER, EPITHET = r"^\S+\s+\S+\s+\S+", "ati$", r"_[0-9]+$", "^[a-z][a-z-]+$"
MOSTLY, ENOUGH, NEARLY_ALL = 0.5, 20, 0.8


def inspected(headers: DataFrame) -> DataFrame:
    """One row (n, depth, kind, has_species, has_kingdom, numbered): what a reference's headers hold.

    kind: trainset, species_assignment (accession, genus, species) or unknown. has_species: whether most full lineages end
    in a species; has_kingdom: whether most second names end in ``ati``; numbered: whether over 80 per cent end in a taxon
    number. Null where fewer than 20 headers can tell.
    """
    p = header_levels(headers).withColumn("d", F.size("parts"))
    depth = p.agg(F.count("*").alias("n"), F.max("d").alias("depth"), F.percentile("d", 0.5).alias("med"))
    last, before = F.element_at("parts", -1), F.try_element_at("parts", F.lit(-2))
    full = F.col("d") == F.col("depth")
    species = (F.coalesce(before, F.lit("")) != "") & (last.startswith(F.concat(before, F.lit(" "))) | last.startswith(F.concat(before, F.lit("_"))) | last.rlike(EPITHET))
    share = lambda test, among: F.avg(F.when(among, F.coalesce(test, F.lit(False)).cast("int")))
    count = lambda among: F.count(F.when(among, 1))
    long = F.col("d") >= 3
    s = p.join(depth).agg(
        F.first("n").alias("n"), F.first("depth").alias("depth"), F.first("med").alias("med"), share(F.get("parts", F.lit(0)).rlike(RECORD), F.lit(True)).alias("b"),
        share(species, full).alias("s"), count(full).alias("sn"), share(F.get("parts", F.lit(1)).rlike(KINGDOM), long).alias("k"), count(long).alias("kn"), share(last.rlike(TAXON_NUMBER), full).alias("m"),
    )
    short = F.col("med") <= 2
    return s.where("n > 0").select(
        "n", "depth", F.when(short & (F.col("b") > MOSTLY), "species_assignment").when(short, "unknown").otherwise("trainset").alias("kind"), F.when(~short & (F.col("sn") >= ENOUGH), F.col("s") > MOSTLY).alias("has_species"),
        F.when(~short & (F.col("kn") >= ENOUGH), F.col("k") > MOSTLY).alias("has_kingdom"), (~short & (F.col("sn") >= ENOUGH) & (F.col("m") > NEARLY_ALL)).alias("numbered"),
    )


def rank_levels(depth: int, has_species: bool | None, has_kingdom: bool | None, numbered: bool) -> list[str]:
    """Names of the levels of a reference of that shape."""
    to_species = not has_kingdom if depth == 7 and has_kingdom is not None else bool(has_species)
    if numbered and depth <= 7:
        return LEVELS[1:][7 - depth :]
    if depth >= 9:
        return PR2_LEVELS
    if depth == 8:
        return LEVELS
    if depth == 7 and not to_species:
        return LEVELS[:7]
    return LEVELS[1:7] if depth == 6 else LEVELS[1:][: min(depth, 7)]


def lineage_count(headers: DataFrame) -> DataFrame:
    """One row (lineages, gigabytes): different lineages, and the memory that a classifier of 8-mers needs for them."""
    s = headers.select(F.regexp_replace(F.trim("header"), "^>", "").alias("l")).agg(F.count_distinct("l").alias("lineages"))
    return s.withColumn("gigabytes", F.col("lineages") * 65536 * 4 / 1e9)


def merged_species_columns(table: DataFrame, columns: list[str], name: str = "species") -> DataFrame:
    """Of several columns for the same rank the fullest stays, under that name; ties go to the first."""
    filled = table.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns))).first()
    kept = columns[max(range(len(columns)), key=lambda i: (filled[i], -i))]
    return table.select(*(F.col(f"`{c}`") for c in table.columns if c not in columns), F.col(f"`{kept}`").alias(name))


def exact_species(sequences: DataFrame, reference: DataFrame, most: int = 1) -> DataFrame:
    """(feature_id, species): species of the references that hold a feature's very sequence and are of its genus; null for more than ``most`` of them.

    sequences: (feature_id, seq, genus); reference: (seq, genus, species). Suffixes such as ``--other`` don't count in a
    genus, nor do parts of a split genus: one name may begin the other, up to a blank, dash, bar or underscore.
    """
    clean = lambda c: F.regexp_replace(c, r"(?i)--+(other|unclassified|uncultured|unknown)$", "")
    own = sequences.select("feature_id", F.upper("seq").alias("seq"), clean("genus").alias("genus"))
    # equal features and equal references meet once, however many there are
    known = reference.select(F.upper("seq").alias("seq"), F.col("genus").alias("ref"), "species").distinct()
    j = own.select("seq", "genus").distinct().join(known, "seq")
    head = lambda c: F.split(c, r"[ \-_/(]")[0]
    same = (F.col("genus") == F.col("ref")) | (head(F.col("genus")) == F.col("ref")) | (F.col("genus") == head(F.col("ref")))
    found = j.where(F.coalesce(same, F.lit(False))).groupBy("seq", "genus").agg(F.collect_set("species").alias("s"))
    each = own.join(found, ["seq", "genus"], "left").groupBy("feature_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    return each.select("feature_id", F.when((F.size("s") > 0) & (F.size("s") <= most), F.array_join("s", "/")).alias("species"))


def grouped_files(files: DataFrame) -> DataFrame:
    """(sample, folder, unit, files): chunks of raw reads by sample. files: (name, folder).

    The unit is a barcode, a run number or the file's stem without its chunk counter; files of failed reads are left out. A
    folder that holds one unit names it; equal names of several folders get the first folder or a number behind them.
    """
    own = files.withColumn("folder", F.coalesce("folder", F.lit(""))).where(F.col("name").rlike(FASTQ))
    stem = F.regexp_replace("name", FASTQ, "")
    own = own.where(~stem.rlike(FAILED) & ~F.col("folder").rlike(FAILED)).withColumn("stem", stem)
    barcode, run = F.lower(F.regexp_extract("stem", BARCODE, 1)), F.regexp_extract("stem", RUN, 1)
    made = F.col("name").rlike(SEQUENCER)
    unit = F.when(barcode != "", barcode).when(run != "", run).when(made, F.regexp_replace("stem", CHUNK, "")).otherwise(F.col("stem"))
    g = own.withColumn("unit", unit).withColumn("made", made).groupBy("folder", "unit").agg(F.sort_array(F.collect_list(F.struct(natural_key("name").alias("k"), "name"))).alias("fs"), F.bool_or("made").alias("made"), F.min("stem").alias("stem"))
    g = g.withColumn("units", F.count("*").over(Window.partitionBy("folder")))
    base = F.element_at(F.split("folder", "/"), -1)
    generic = base.rlike("(?i)^(fastq(_pass)?|pass|data|reads|raw(_data)?|upload(s)?|basecalling|no_sample|)$")
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "(?i)^sample[_-]", ""), r"[^A-Za-z0-9._-]+", "_")
    name = F.when((F.col("units") == 1) & ~generic, clean(base)).when(~F.col("made") & (F.size("fs") == 1), clean(F.col("stem"))).otherwise(clean(F.col("unit")))
    same = Window.partitionBy("base").orderBy("folder", "unit")
    g = g.withColumn("base", name).withColumn("r", F.row_number().over(same))
    top = F.split("folder", "/")[0]
    unique = F.when(F.col("r") == 1, F.col("base")).when((F.col("r") == 2) & (top != ""), F.concat_ws("_", "base", clean(top))).otherwise(F.concat_ws("_", "base", F.col("r").cast("string")))
    return g.select(unique.alias("sample"), "folder", "unit", F.transform("fs", lambda x: x["name"]).alias("files"))
