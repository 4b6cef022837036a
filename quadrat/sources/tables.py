"""Readers of wide and tool-specific tables into the canonical long ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat import schemas
from quadrat.functions.labels import folded_key, missing_to_null

#: Column names that stand for the feature in the different layouts, and for the sample where samples are rows.
FEATURE_COLUMNS = ["sequence", "tax_id", "ASV_ID", "ASV", "OTU", "feature_id", "_c0", ""]
SAMPLE_COLUMNS = ["sample_id", "sample", "SampleID"]


def found_separator(spark: SparkSession, path: str) -> str:
    """Tab, semicolon, comma or bar: the one that the first line has most often; comma without any."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    return max("\t;,|", key=lambda c: (line.count(c), c == ","))


def read_tool_lines(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose header line begins with #, all columns as text; short rows are filled with nulls, other lines with # go."""
    v = F.split("value", "\t")
    rows = spark.read.text(path)
    head = rows.where("value LIKE '#%' AND instr(value, chr(9)) > 0").limit(1).collect()
    names = head[0]["value"].lstrip("#").strip("\r\n").split("\t") if head else []
    return rows.where("value NOT LIKE '#%' AND trim(value) <> ''").select(*(F.get(v, F.lit(i)).alias(n.strip()) for i, n in enumerate(names)))


def found_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is, else the Thai code page cp874 if every byte stands for a letter there, else ISO-8859-1."""
    lines = spark.read.text(path)  # the bytes as they are
    free = "|".join(f"{b:02X}" for b in range(256) if not bytes([b]).decode("cp874", "ignore"))
    row = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_and(~F.hex(F.col("value").cast("binary")).rlike(f"^(..)*?({free})")).alias("thai")).first()
    return "UTF-8" if row["utf8"] in (True, None) else "cp874" if row["thai"] else "ISO-8859-1"


def _from_thai(value):
    """Text that was read as ISO-8859-1, by cp874: each byte above 127 has one letter."""
    pairs = [(chr(b), bytes([b]).decode("cp874", "ignore")) for b in range(128, 256)]
    pairs = [(x, y) for x, y in pairs if y and x != y]
    if isinstance(value, str):
        return value.translate(str.maketrans(dict(pairs)))
    return F.translate(value, "".join(x for x, _ in pairs), "".join(y for _, y in pairs))


def read_csv(spark: SparkSession, path: str, sep: str | None = ",", header: bool = True, encoding: str | None = "UTF-8") -> DataFrame:
    """All columns as text, byte order mark and ragged rows tolerated. Without a separator, the one that the first line tells; without an encoding, the first of UTF-8, cp874 and ISO-8859-1 that fits."""
    sep, encoding = sep or found_separator(spark, path), encoding or found_encoding(spark, path)
    thai = encoding.lower() == "cp874"  # unknown to Spark
    df = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("encoding", "ISO-8859-1" if thai else encoding).csv(path)
    if thai:
        df = df.select([_from_thai(F.col(f"`{c}`")).alias(_from_thai(c)) for c in df.columns])
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample, file1, file2) of a JSON list of samples and their files; separators of paths in a sample's name become _."""
    name = F.regexp_replace(F.trim("sample"), r"[\\/]+", "_")
    return spark.read.option("multiLine", True).schema("sample string, file1 string, file2 string").json(path).select(name.alias("sample"), F.trim("file1").alias("file1"), F.trim("file2").alias("file2"))


def features_from_wide(wide: DataFrame, truncate: bool = False, drop_empty: bool = True) -> DataFrame:
    """(feature_id, sample, reads) of a count table in either orientation, by the name of its first column.

    truncate: whole numbers towards zero, else as read. Cells that are no numbers count as 0, which drop_empty leaves out.
    """
    first = wide.columns[0]
    key, var = ("sample", "feature_id") if first in SAMPLE_COLUMNS else ("feature_id", "sample")
    name = next((c for c in wide.columns if c in FEATURE_COLUMNS), first) if key == "feature_id" else first
    values = [c for c in wide.columns if c != name]
    long = wide.select(F.col(f"`{name}`").alias(key), *(F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(c) for c in values)).unpivot([key], values, var, "reads")
    reads = F.col("reads").cast("long").cast("double") if truncate else F.col("reads")
    out = long.select("feature_id", "sample", reads.alias("reads"))
    return out.where("reads > 0") if drop_empty else out


def taxonomy_from_wide(wide: DataFrame) -> DataFrame:
    """Canonical taxonomy: rank columns by name in any case, missing cells null, others null."""
    known = {c.lower(): c for c in wide.columns}
    key = next((c for c in wide.columns if c in FEATURE_COLUMNS), wide.columns[0])
    return wide.select(F.col(f"`{key}`").alias("feature_id"), *((missing_to_null(F.col(f"`{known[r]}`")) if r in known else F.lit(None).cast("string")).alias(r) for r in schemas.RANKS))


def shifted_ranks_repaired(taxonomy: DataFrame) -> DataFrame:
    """Tables whose names stand one rank too high (most genera hold a blank, as species do) are moved down one rank; taxon numbers go."""
    ranks = schemas.RANKS
    clean = taxonomy.select("feature_id", *(F.regexp_replace(r, r"_\d+$", "").alias(r) for r in ranks))
    share = clean.where("genus IS NOT NULL").agg(F.avg(F.col("genus").contains(" ").cast("int")).alias("s")).first()["s"]
    if not share or share <= 0.5:
        return clean
    return clean.select("feature_id", F.lit(None).cast("string").alias(ranks[0]), *(F.col(a).alias(b) for a, b in zip(ranks[:-1], ranks[1:], strict=True)))


def tracking_from_wide(wide: DataFrame) -> DataFrame:
    """(sample, stage, stage_no, reads); a stage without a number repeats the one before."""
    sample, *stages = wide.columns
    long = wide.select(F.col(f"`{sample}`").alias("sample"), F.posexplode(F.array(*(F.struct(F.lit(c).alias("stage"), F.col(f"`{c}`").try_cast("long").alias("reads")) for c in stages))).alias("stage_no", "s"))
    before = Window.partitionBy("sample").orderBy("stage_no")
    return long.select("sample", "s.stage", "stage_no", F.last("s.reads", ignorenulls=True).over(before).alias("reads"))


def metadata_for(wide: DataFrame, samples: list[str]) -> DataFrame:
    """(sample, attrs): rows of the known samples. The id column is the one whose values match most of them, case and punctuation ignored.

    Columns of running numbers are dropped; a sample that stands twice is refused.
    """
    spark, keys = wide.sparkSession, {}
    for s in samples:
        keys.setdefault("".join(ch for ch in s.lower() if ch.isalnum() and ch.isascii()), s)
    known = spark.createDataFrame(list(keys.items()), "key string, sample string")
    scores = wide.agg(*(F.count_distinct(F.when(folded_key(F.col(f"`{c}`")).isin(list(keys)), folded_key(F.col(f"`{c}`")))).alias(str(i)) for i, c in enumerate(wide.columns))).first()
    best = max(range(len(wide.columns)), key=lambda i: (scores[i], -i))
    if not scores[best]:
        raise ValueError("no column holds the names of the samples")
    name = wide.columns[best]
    n = wide.count()
    running = wide.agg(*((F.count_distinct(F.col(f"`{c}`").try_cast("int")) == n).alias(str(i)) for i, c in enumerate(wide.columns)), *((F.max(F.col(f"`{c}`").try_cast("int")) == n).alias(f"m{i}") for i, c in enumerate(wide.columns))).first()
    kept = [c for i, c in enumerate(wide.columns) if c != name and not (running[str(i)] and running[f"m{i}"])]
    pairs = [x for c in kept for x in (F.lit(c), F.coalesce(missing_to_null(F.col(f"`{c}`")), F.lit("")))]
    out = wide.withColumn("key", folded_key(F.col(f"`{name}`"))).join(known, "key").select("sample", (F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")).alias("attrs"))
    twice = [r["sample"] for r in out.groupBy("sample").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"samples stand more than once: {twice}")
    return out


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignment hits: query, subject, pident, length, qlen, bitscore, qcov, evalue; other rows are dropped. ``lcl|`` goes."""
    v = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(v) == 8)
    typed = [v[i].try_cast(f.dataType).alias(f.name) if i > 1 else F.regexp_replace(v[i], r"^lcl\|", "").alias(f.name) for i, f in enumerate(schemas.HITS)]
    return rows.select(*typed)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Pairwise alignments with the optional de and cs tags."""
    v = F.split("value", "\t")
    tag = lambda t: F.get(F.filter(F.slice(v, 13, 10_000), lambda x: x.startswith(t)), F.lit(0)).substr(len(t) + 1, 1 << 30)
    rows = spark.read.text(path).where(F.size(v) >= 12)
    return rows.select(*(v[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.PAF.fields[:12])), tag("de:f:").try_cast("double").alias("de"), tag("cs:Z:").alias("cs"))


def read_stratified(spark: SparkSession, path: str, suffixes: str = r"[_-](Abundance|RPKs|CPM)([_-].*)?$", keep: str | None = None) -> DataFrame:
    """Function table (sample, feature, taxon, value) of rows ``feature|taxon``; rows of unmapped reads are left out. keep: expression that features must match, tested before the table is made long."""
    wide = read_csv(spark, path, sep="\t")
    key, *samples = wide.columns
    wide = wide if keep is None else wide.where(F.split(F.col(f"`{key}`"), r"\|")[0].rlike(keep))
    long = wide.select(F.col(f"`{key}`").alias("k"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in samples)).unpivot(["k"], samples, "sample", "value")
    parts = F.split("k", r"\|", 2)
    out = long.select(F.regexp_replace("sample", suffixes, "").alias("sample"), parts[0].alias("feature"), F.get(parts, F.lit(1)).alias("taxon"), "value")
    return out.where(~F.col("feature").isin("UNMAPPED", "UNINTEGRATED", "UNGROUPED") & (F.col("value") > 0))


def lineage_columns(header: str | object) -> dict:
    """Ranks of reference headers, told apart by what their levels are.

    Prefixed (``...|k__Fungi;p__...``); numbered (``Arthropoda_6656;...``, from the phylum on, or from the kingdom if there
    are seven); nine levels with supergroup and subdivision; plain lists from the domain on, with or without a kingdom that
    ends in ``ati`` behind it. kingdom is the first level, domain or kingdom.
    """
    c = F.col(header) if isinstance(header, str) else header
    text = F.element_at(F.split(c, r"\|"), -1)
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "^>", ""), ";"), F.trim), lambda x: x != "")
    n = F.size(parts)
    prefixed = F.exists(parts, lambda x: x.rlike("^[dkpcofgs]__"))
    with_number = F.size(F.filter(parts, lambda x: x.rlike(r"_\d+$")))
    numbered = (n > 0) & (with_number >= F.greatest(F.lit(1), n - 1))
    second = F.get(parts, F.lit(1))
    lpsn = (n >= 3) & F.coalesce(second.endswith("ati"), F.lit(False))
    at = lambda i: F.get(parts, F.lit(i))

    def marked(letter: str, rank: str):
        v = F.regexp_replace(F.get(F.filter(parts, lambda x: x.startswith(f"{letter}__")), F.lit(0)), "^[a-z]__", "")
        known = F.when(~v.rlike("(?i)^(unidentified|.*_incertae_sedis|incertae_sedis)$") & ~F.lower(v).endswith("_sp"), v)
        return F.translate(known, "_", " ") if rank == "species" else known

    def named(i: int):
        v = F.when(n == 7, at(i)).otherwise(at(i - 1) if i else F.lit(None).cast("string"))
        v = F.regexp_replace(v, r"_\d+$", "")
        return F.when(~v.rlike("^(kingdom|phylum|class|order|family|genus|species)_"), v)

    nine = [0, 2, 4, 5, 6, 7, 8]
    out = {}
    for i, (letter, rank) in enumerate(zip("kpcofgs", ["kingdom", "phylum", "class", "order", "family", "genus", "species"], strict=True)):
        long = F.translate(at(nine[i]), "_", " ") if rank == "species" else at(nine[i])
        plain = F.when(lpsn, at(i + 1 if i else 0)).otherwise(at(i))
        out[rank] = missing_to_null(F.when(prefixed, marked(letter, rank)).when(numbered, named(i)).when(n >= 9, long).otherwise(plain))
    return out


def read_gene_panels(spark: SparkSession, path: str, enabled: list[str] | None = None) -> DataFrame:
    """(panel, group, gene, ko array, pattern) of a tab-separated file with comments; of the enabled panels alone, if given. Rows with a pattern that is no expression are left out.

    A panel file is written by hand, some dozen rows, so patterns are tried where they are read.
    """
    rows = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    rows = rows if enabled is None else rows.where(F.trim("panel").isin(enabled))
    ko = F.filter(F.transform(F.split(F.coalesce("ko", F.lit("")), "[,; ]+"), F.trim), lambda x: x != "")
    out = rows.select("panel", "group", "gene", ko.alias("ko"), missing_to_null("uniref_pattern").alias("pattern"))
    bad = []
    for r in out.select("pattern").where("pattern IS NOT NULL").distinct().toLocalIterator():
        try:
            re.compile(r["pattern"])
        except re.error:
            bad.append(r["pattern"])
    return out.where(F.col("pattern").isNull() | ~F.col("pattern").isin(bad)) if bad else out


def cleaned_taxonomy(taxonomy: DataFrame, numbered: bool = False) -> DataFrame:
    """Taxonomy without rank prefixes, taxon numbers and placeholder names (if numbered), undecided placements, and species that only repeat their genus."""
    ranks = [r for r in schemas.RANKS if r in taxonomy.columns]

    def clean(r: str):
        v = F.regexp_replace(F.trim(r), "^[a-z]__", "")
        if numbered:
            v = F.regexp_replace(v, "_[0-9]+$", "")
            v = F.when(~v.rlike("^(kingdom|phylum|class|order|family|genus|species)_"), v)
        return F.when(~v.rlike(r"(?i)^(unidentified|.*_incertae_sedis)$"), missing_to_null(v))

    out = taxonomy.select(*(c for c in taxonomy.columns if c not in ranks), *(clean(r).alias(r) for r in ranks))
    if "species" in ranks and "genus" in ranks:
        out = out.withColumn("species", F.when(F.coalesce(F.col("species") != F.col("genus"), F.lit(True)), F.col("species")))
    return out
