"""Resistance genes, function panels, bins and assemblies."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quadrat.operators.intervals import union_length

ROWS = 500_000  # contigs of one task


def gene_families(paf: DataFrame, catalogue: DataFrame, total_reads: float, platform: str = "illumina", least_identity: float = 0.9, least_breadth: float = 60.0) -> DataFrame:
    """One row per gene family: representative allele, reads, breadth, depth, RPKM and identity.

    paf: alignments of reads (qname, qlen, qs, qe, tname, tlen, ts, te, nmatch, alen, de). catalogue: (tname, allele, symbol,
    length, type, class). Alleles within 5 % of the representative's length share its coordinates.
    """
    # a row for each allele: never broadcast
    h = paf.where("alen > 0").join(catalogue.hint("merge"), "tname").withColumn("identity", F.coalesce(1 - F.col("de"), F.col("nmatch") / F.col("alen")))
    span, at_end = F.col("te") - F.col("ts"), (F.col("ts") <= 10) | (F.col("te") >= F.col("tlen") - 10)
    enough = (span >= 50) & ((F.col("qe") - F.col("qs") >= 0.8 * F.col("qlen")) | at_end) if platform == "illumina" else span >= F.least(F.lit(200.0), 0.5 * F.col("tlen"))
    h = h.where((F.col("identity") >= least_identity) & enough).withColumn("read", F.regexp_replace("qname", r"/[12]$", ""))
    per = h.groupBy("symbol", "tname").agg(F.count("*").alias("n"))
    first = per.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "tname"))).where("r = 1").select("symbol", F.col("tname").alias("rep"))
    reps = first.join(catalogue.select(F.col("tname").alias("rep"), "allele", "type", "class", F.greatest("length", F.lit(1)).alias("rlen")).hint("merge"), "rep")
    # a family meets its representative, and its window, with each different span once, not with each alignment
    spans = h.select("symbol", "length", "ts", "te").distinct().join(reps.select("symbol", "rlen"), "symbol")
    same = spans.where(F.abs(F.col("length") - F.col("rlen")) <= 0.05 * F.col("rlen")).select("symbol", F.least("ts", "rlen").alias("start"), F.least("te", "rlen").alias("end"))
    sums = h.groupBy("symbol").agg(F.count_distinct("read").alias("reads"), F.sum(span).alias("bases"), F.avg("identity").alias("identity"))
    out = reps.join(sums, "symbol").join(union_length(same, ["symbol"]), "symbol", "left").withColumn("breadth", 100 * F.coalesce("covered", F.lit(0)) / F.col("rlen"))
    return out.where(F.col("breadth") >= least_breadth).select(
        F.col("symbol").alias("gene"), "allele", "type", "class", F.col("rlen").alias("length"), "reads", F.bround("breadth", 1).alias("breadth"), F.bround(F.col("bases") / F.col("rlen"), 2).alias("depth"),
        F.bround(F.col("reads") / (F.col("rlen") / 1e3) / max(1e-9, total_reads / 1e6), 2).alias("rpkm"), F.bround(100 * F.col("identity"), 2).alias("identity"),
    )


def _largest(counts: DataFrame, by: list[str], name: str, n: str) -> DataFrame:
    return counts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(n), name))).where("__r = 1").drop("__r")


def gene_hosts(reads: DataFrame) -> DataFrame:
    """(gene, host_taxon, host_share, host_status, host_reads): the genus of most of a gene's classified reads.

    reads: (gene, classified, genus, species) for each read of a gene. A species stands if it has 70 % of the genus's reads.
    The share is of all classified reads; 60 % makes it clear.
    """
    own = reads.where("classified")
    total = own.groupBy("gene").agg(F.count("*").alias("n"))
    genus = _largest(own.where("genus IS NOT NULL").groupBy("gene", "genus").agg(F.count("*").alias("gc")), ["gene"], "genus", "gc")
    sp = own.where("genus IS NOT NULL AND species IS NOT NULL").groupBy("gene", F.split("species", " ")[0].alias("genus"), "species").agg(F.count("*").alias("sc"))
    sp = _largest(sp, ["gene", "genus"], "species", "sc")
    j = total.join(genus, "gene", "left").join(sp, ["gene", "genus"], "left")
    taxon = F.when(F.col("sc") >= 0.7 * F.col("gc"), F.col("species")).otherwise(F.col("genus"))
    return j.select("gene", taxon.alias("host_taxon"), F.bround(100 * F.col("gc") / F.col("n"), 1).alias("host_share"), F.when(F.col("gc") >= 0.6 * F.col("n"), "clear").when(F.col("gc").isNotNull(), "mixed").alias("host_status"), F.col("n").alias("host_reads"))


def panel_values(functions: DataFrame, panels: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, panel, gene, cpm): community values of panel genes, zeros included.

    functions: (sample, feature, taxon, value), taxon null for the community. panels: (panel, gene, ko array, pattern), a
    small table. Genes with KO ids meet features by equality; only those without are matched by pattern against the names.
    """
    whole = functions.where("taxon IS NULL")
    by_id = panels.where("size(ko) > 0").select("panel", "gene", F.explode("ko").alias("id"))
    equal = whole.withColumn("id", F.trim(F.split("feature", ":")[0])).join(by_id, "id").select("sample", "panel", "gene", "value")
    named = panels.where("coalesce(size(ko), 0) <= 0 AND pattern IS NOT NULL").select("panel", "gene", "pattern")
    # panels are a hand-written list of a few dozen rows: each feature is tested against the patterns
    like = whole.join(named, F.expr("feature rlike concat('(?i)', pattern)")).select("sample", "panel", "gene", "value")
    found = equal.unionByName(like).groupBy("sample", "panel", "gene").agg(F.sum("value").alias("cpm"))
    grid = samples.select("sample").distinct().crossJoin((panels.select("panel", "gene").distinct()))
    return grid.join(found, ["sample", "panel", "gene"], "left").select("sample", "panel", "gene", F.round(F.coalesce("cpm", F.lit(0.0)), 6).alias("cpm"))


def tier(completeness: str | Column, contamination: str | Column) -> Column:
    comp, cont = (F.col(c) if isinstance(c, str) else c for c in (completeness, contamination))
    return F.when(comp.isNull() | cont.isNull(), "—").when((comp > 90) & (cont < 5), "High").when((comp >= 50) & (cont < 10), "Medium").otherwise("Low")


def bin_species(contigs: DataFrame, least: float = 0.5) -> DataFrame:
    """(bin, species): the species of at least that share of a bin's classified length, else null. contigs: (bin, length, classified, species)."""
    total = contigs.where("classified").groupBy("bin").agg(F.sum("length").alias("t"))
    best = _largest(contigs.where("classified AND species IS NOT NULL").groupBy("bin", "species").agg(F.sum("length").alias("v")), ["bin"], "species", "v")
    return contigs.select("bin").distinct().join(total, "bin", "left").join(best, "bin", "left").select("bin", F.when(F.col("v") >= least * F.col("t"), F.col("species")).alias("species"))


def split_bins(contigs: DataFrame, least_length: int = 300_000, least_share: float = 0.15, orphans: str = "largest") -> DataFrame:
    """(bin, contig, part): contigs of bins in which two or more genera are large. Contigs of other genera join the largest, or are left out (drop)."""
    # dealt once by bin, so many rows to a task as its sorts hold: contigs pack too well to tell that by the size of a partition
    tasks = max(contigs.sparkSession.sparkContext.defaultParallelism, -(-contigs.count() // ROWS))
    contigs = contigs.repartition(tasks, "bin")
    genus = contigs.groupBy("bin", "genus").agg(F.sum("length").alias("g")).withColumn("t", F.sum("g").over(Window.partitionBy("bin")))
    large = genus.where(F.col("genus").isNotNull() & (F.col("g") >= least_length) & (F.col("g") / F.col("t") >= least_share))
    parts = large.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct((-F.col("g")).alias("less"), "genus"))).alias("own")).where(F.size("own") > 1)
    # contigs meet one row for their bin; its large genera are few
    out = contigs.join(parts.select("bin", F.col("own.genus").alias("own")).hint("merge"), "bin")
    part = F.when(F.array_contains("own", F.col("genus")), F.col("genus"))
    return out.select("bin", "contig", (F.coalesce(part, F.get("own", F.lit(0))) if orphans == "largest" else part).alias("part")).where("part IS NOT NULL")


def assembly_summary(contigs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., contigs, total, n50, gc, depth): GC and depth weighted by length."""
    from quadrat.operators.intervals import n50

    total = F.sum("length")
    s = contigs.groupBy(*by).agg(F.try_divide(F.sum(F.col("gc") * F.col("length")), total).alias("gc"), F.try_divide(F.sum(F.col("depth") * F.col("length")), total).alias("depth"))
    return n50(contigs, by).join(s, by).select(*by, F.col("n").alias("contigs"), "total", "n50", "gc", "depth")


def gc_windows(sequences: DataFrame, size: int) -> DataFrame:
    """(name, start, gc, skew): windows of that size; the last may be shorter."""
    from quadrat.functions.sequences import fragments, gc_percent, gc_skew

    w = sequences.select("name", F.posexplode(fragments("seq", size)).alias("k", "part"))
    return w.select("name", (F.col("k") * size).alias("start"), gc_percent("part").alias("gc"), gc_skew("part").alias("skew"))


_BASES = np.full(256, 4, np.int64)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _BASES[list(_pair)] = _i
_SHORT = {k: np.array(["".join(x) for x in itertools.product("ACGT", repeat=k)]) for k in (2, 3, 4)}


def _known_runs(base: np.ndarray, least: int) -> np.ndarray:
    """The bases, where runs of fewer than that many known ones count as unknown."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], base < 4, [False])).astype(np.int8)))
    out = base.copy()
    for lo, hi in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] < least].tolist():
        out[lo:hi] = 4
    return out


def _short_kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, kmer, n) of each batch: k-mers of two to four bases within runs of at least four known ones, and an empty one for each name."""
    for batch in batches:
        sums: dict = {}
        for name, seq in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not seq.is_valid:
                continue
            base = _known_runs(_BASES[np.frombuffer(seq.as_buffer(), np.uint8)], 4)
            own = sums.setdefault(name, {k: np.zeros(4**k, np.int64) for k in _SHORT})
            for k, total in own.items():
                n = len(base) - k + 1
                if n > 0:
                    parts = [base[j : n + j] for j in range(k)]
                    code = sum(x << 2 * (k - 1 - j) for j, x in enumerate(parts))
                    known = np.max(parts, axis=0) < 4
                    total += np.bincount(code[known], minlength=4**k)
        rows = [(name, "", 0) for name in sums] + [(name, kmer, n) for name, own in sums.items() for k, total in own.items() for kmer, n in zip(_SHORT[k][total > 0].tolist(), total[total > 0].tolist(), strict=True)]
        names, kmers, counts = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(kmers, pa.string()), pa.array(counts, pa.int64())], ["name", "kmer", "n"])


def tetramer_profile(sequences: DataFrame) -> DataFrame:
    """(name, kmer, z): over- and under-use of each of the 256 tetramers, on both strands, against what its trimers and dimers predict."""
    own = sequences.where("name IS NOT NULL").select("name", "seq")
    schema = StructType([own.schema["name"], StructField("kmer", StringType()), StructField("n", LongType())])
    counts = own.mapInArrow(_short_kmers, schema).groupBy("name", "kmer").agg(F.sum("n").cast("double").alias("n"))
    # at most 337 entries for each name
    per = counts.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("c"))
    j = per.select("name", "c", F.explode(F.array(*(F.lit(x) for x in _SHORT[4].tolist()))).alias("kmer"))

    def both(at: int, n: int) -> Column:
        part = F.substring("kmer", at, n)
        other = F.reverse(F.translate(part, "ACGT", "TGCA"))
        return F.coalesce(F.try_element_at("c", part), F.lit(0.0)) + F.coalesce(F.try_element_at("c", other), F.lit(0.0))

    j = j.select("name", "kmer", *(both(at, n).alias(x) for x, at, n in (("n4", 1, 4), ("a", 1, 3), ("b", 2, 3), ("m", 2, 2))))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("m"))
    variance = F.try_divide(expected * (F.col("m") - F.col("a")) * (F.col("m") - F.col("b")), F.col("m") * F.col("m"))
    return j.select("name", "kmer", F.when(variance > 0, (F.col("n4") - expected) / F.sqrt(variance)).otherwise(0.0).alias("z"))
