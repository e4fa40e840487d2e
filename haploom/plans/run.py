"""The two stages from alignments to a phased graph, on files.

``phase`` finds SNPs and clusters the reads of each eligible unitig;
``transform`` makes segments and links of the clusters. Each stage's tables are
written as Parquet under ``<out>/intermediate/tables`` and read again by what follows, so a
run that is broken off starts again from them.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploom.functions import sequence as fn
from haploom.operators import alleles, clustering, coverage, distances, graphs, haplotypes, pileup, reports
from haploom.plans.checkpoints import cut
from haploom.plans.config import Config
from haploom.sources import formats


class Tables:
    """Parquet tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def _segments(spark: SparkSession, graph: str) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of a GFA file, or of a FASTA file, which has no links."""
    if graph.endswith((".fa", ".fasta", ".fa.gz", ".fasta.gz")):
        links = spark.createDataFrame([], "from_seg string, from_orient string, to_seg string, to_orient string, overlap string, ex int")
        return formats.read_fasta(spark, graph).withColumn("dp", F.lit(None).cast("int")), links
    return formats.read_gfa(spark, graph)


def _alignments(spark: SparkSession, sam: str, lengths: DataFrame) -> DataFrame:
    """unitig, read_id, s, e, q_start, q_end, mapq, de, rev, supplementary, cigar, seq, length of every aligned record with bases."""
    rows = formats.read_sam(spark, sam).where("cigar <> '*' AND seq <> '*'")
    span = fn.cigar_span(F.col("cigar"), F.col("ref_start").cast("long"), F.col("is_reverse"))
    at = rows.withColumn("span", span).join(lengths, "unitig")
    return at.select(
        "unitig", "read_id", F.col("ref_start").cast("long").alias("s"), F.col("span.ref_end").alias("e"), F.col("span.query_start").alias("q_start"), F.col("span.query_end").alias("q_end"),
        "mapq", "de", F.col("is_reverse").alias("rev"), F.col("is_supplementary").alias("supplementary"), "cigar", "seq", F.col("length").cast("long").alias("length"),
    )


def clips(records: DataFrame, near: int = 100) -> DataFrame:
    """unitig, read_id, side, next, strand: where a read goes on, for both unitigs of each two neighbouring alignments.

    Neighbours follow each other on the read with less than ``near`` between them, and both lie that near to a tip.
    """
    w = Window.partitionBy("read_id").orderBy("q_start", "q_end", "unitig", "s")
    tip = F.least(F.col("s"), F.col("length") - F.col("e")) < near
    rows = records.select("read_id", "unitig", "q_start", "q_end", "s", "e", F.when(F.col("rev"), "-").otherwise("+").alias("strand"), tip.alias("tip"))
    after = rows.withColumn("n", F.lead(F.struct("unitig", "q_start", "strand", "tip")).over(w))
    both = after.where((F.abs(F.col("q_end") - F.col("n.q_start")) < near) & F.col("tip") & F.col("n.tip") & (F.col("unitig") != F.col("n.unitig")))
    first, second = F.col("strand"), F.col("n.strand")
    out = F.struct("unitig", F.when(first == "+", "R").otherwise("L").alias("side"), F.col("n.unitig").alias("next"), F.when(first == "+", second).otherwise(fn.flipped(second)).alias("strand"))
    back = F.struct(F.col("n.unitig").alias("unitig"), F.when(second == "+", "L").otherwise("R").alias("side"), F.col("unitig").alias("next"), F.when(second == "+", first).otherwise(fn.flipped(first)).alias("strand"))
    return both.select("read_id", F.inline(F.array(out, back))).select("unitig", "read_id", "side", "next", "strand")


def _name() -> Column:
    return F.concat_ws("_", F.col("unitig"), F.col("cluster").cast("string"))


def _coloured(reads: DataFrame) -> DataFrame:
    """``reads`` with yc, the colour of their cluster among those of the unitig."""
    rank = reads.where("cluster IS NOT NULL").select("unitig", "cluster").distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy("unitig").orderBy("cluster")))
    ranked = rank.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("unitig")))
    return reads.join(ranked, ["unitig", "cluster"], "left").withColumn("yc", fn.colour(F.col("rank"), F.col("n"))).drop("rank", "n")


def phase(spark: SparkSession, graph: str, sam: str, out: str, c: Config, vcf: str | None = None) -> DataFrame:
    """Clusters (unitig, read_id, cluster, s, e, length) of the reads of all eligible unitigs; writes them, SNPs and coloured reads."""
    t = Tables(spark, f"{out}/intermediate/tables")
    segments, links = _segments(spark, graph)
    segments, _ = t.put("segments", segments), t.put("links", links)
    lengths = segments.select("unitig", "length")
    records = t.put("records", _alignments(spark, sam, lengths))
    depths = t.put("depths", coverage.depth(records, lengths).withColumn("mean", F.col("bases") / F.col("length")))
    chosen = t.put("eligible", coverage.eligible(depths, c.min_depth, c.max_depth, c.min_length).select("unitig"))
    segments.select("unitig").exceptAll(chosen).write.mode("overwrite").text(f"{out}/intermediate/filtered_out.txt")
    mine = records.join(chosen, "unitig", "left_semi")
    kept = coverage.one_per_read(coverage.accepted(mine, c), ["unitig", "read_id"], "supplementary", ["s", "e"])
    kept = t.put("reads", kept)
    if vcf is None:
        snps = alleles.strand_supported(pileup.all_bases(mine.where(F.col("mapq") >= c.min_mapq)), c.allele_frequency, c.min_alt)
    else:
        snps = formats.read_vcf(spark, vcf).select(F.col("CHROM").alias("unitig"), (F.col("POS") - 1).cast("long").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"))
    snps = t.put("snps", snps.select("unitig", "pos", "ref", "alt").distinct())
    formats.write_vcf(_snp_rows(snps), f"{out}/intermediate/snps.vcf", once=True)
    seen = t.put("bases", pileup.bases_at(kept, snps))
    known = seen.select("unitig", "read_id", "pos", "base").join(snps.groupBy("unitig", "pos").agg(F.min("ref").alias("ref")), ["unitig", "pos"])
    found = clustering.phase(kept.select("unitig", "read_id", "s", "e", "length"), known, c)
    number = F.dense_rank().over(Window.partitionBy("unitig").orderBy("cluster"))
    numbers = found.where("cluster IS NOT NULL").select("unitig", "cluster").distinct().withColumn("number", number.cast("long"))
    numbered = found.join(numbers, ["unitig", "cluster"], "left").select("unitig", "read_id", F.col("number").alias("cluster"))
    clusters = t.put("clusters", kept.select("unitig", "read_id", "s", "e", "length").join(numbered, ["unitig", "read_id"]))
    formats.write_clusters(clusters.select("unitig", "read_id", "cluster", F.col("s").alias("start")), f"{out}/intermediate/clusters")
    formats.write_sam(lengths, _coloured(kept.join(clusters.select("unitig", "read_id", "cluster"), ["unitig", "read_id"])), f"{out}/intermediate/phased_reads.sam")
    return clusters


def _snp_rows(snps: DataFrame) -> DataFrame:
    dot = F.lit(".")
    return snps.select(F.col("unitig").alias("CHROM"), (F.col("pos") + 1).alias("POS"), dot.alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), dot.alias("QUAL"), F.lit("PASS").alias("FILTER"), dot.alias("INFO"), dot.alias("FORMAT"), dot.alias("sample"))


def _clusters_of(t: Tables, c: Config) -> tuple[DataFrame, DataFrame]:
    """(clusters with extents, roles and consensus changes; consensus by site)."""
    reads = t.get("clusters").where("cluster IS NOT NULL")
    key = ["unitig", "cluster"]
    votes = t.get("bases").join(reads.select(*key, "read_id"), ["unitig", "read_id"]).join(t.get("snps").select("unitig", "pos", "ref"), ["unitig", "pos"])
    cons = t.put("consensus", alleles.consensus(votes, key, c.allele_frequency, c.split_allele_frequency, c.min_alt))
    ext = alleles.extent(reads, key).where("n_reads > 1 AND last > first")
    dense = haplotypes.covered_enough(ext, t.get("depths"), c.min_cluster_share)
    tails = coverage.strong_tails(reads, key, c.end_gap, c.tip_reads).drop("spans")
    lengths = t.get("segments").select("unitig", F.col("length").cast("long").alias("length"))
    changes = cons.where("base IS NOT NULL").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("changes"), F.count_if("alt_flag").alias("n_snp"))
    at = dense.withColumn("c_start", F.col("first")).withColumn("c_end", F.col("last")).join(tails, key).join(lengths, "unitig")
    nodes = haplotypes.roles(at, c.end_gap).join(changes, key, "left").withColumn("node", _name())
    return t.put("nodes", nodes), cons


def _children(t: Tables, nodes: DataFrame, cons: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """(new segments, links along paths)."""
    several = nodes.where("NOT single")
    d = distances.cluster_distances(several, cons.where("alt_flag AND base IS NOT NULL").select("unitig", "cluster", "pos", "base"), c.min_overlap).where("d = 0")
    edges = cut(d.select(F.concat_ws("_", "unitig", F.col("a").cast("string")).alias("src"), F.concat_ws("_", "unitig", F.col("b").cast("string")).alias("dst")))
    graph, left = haplotypes.overlap_graph(edges, several.select("node", "first", "last", "root", "leaf", "full"))
    paths = cut(haplotypes.usable_paths(cut(graph), left, c.max_hops))
    cuts = cut(haplotypes.boundaries(paths, several.select("node", "first", "last", "length", "root", "leaf")).where("left <> right"))
    steps = haplotypes.path_links(paths).join(cuts.select(F.col("node").alias("src")), "src", "left_semi").join(cuts.select(F.col("node").alias("dst")), "dst", "left_semi")
    full, single = nodes.where("full"), nodes.where("single")
    used = full.select("node").union(cuts.select("node"))
    rest = haplotypes.remaining(several.select("node", "first", "last"), edges, used)
    # clusters that nothing was made of tell how deep the parent still is
    emitted = several.join(used, "node", "left_semi").select("unitig").distinct().withColumn("emitted", F.lit(True))
    idle = several.join(rest, "node", "left_semi")
    depth = idle.groupBy("unitig").agg((F.sum(F.col("cov") * (F.col("last") - F.col("first"))) / F.max("length")).alias("rest_depth"))
    deep = depth.join(emitted, "unitig", "left").where(F.col("emitted").isNull() | (F.rint("rest_depth") >= c.min_parent_depth)).select("unitig")
    kinds = [
        full.select("node", F.col("first").alias("left"), F.col("last").alias("right"), F.lit(True).alias("fill"), F.lit("full").alias("kind")),
        single.select("node", F.col("first").alias("left"), F.col("last").alias("right"), F.lit(True).alias("fill"), F.lit("single").alias("kind")),
        cuts.select("node", "left", "right", F.lit(True).alias("fill"), F.lit("path").alias("kind")),
        idle.join(deep, "unitig", "left_semi").select("node", F.col("first").alias("left"), F.col("last").alias("right"), F.lit(False).alias("fill"), F.lit("other").alias("kind")),
    ]
    chosen = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    rows = chosen.join(nodes, "node").join(t.get("segments").select("unitig", F.col("seq").alias("parent")), "unitig")
    none = F.array().cast(nodes.schema["changes"].dataType)
    consensus = fn.patched(F.col("parent"), F.col("c_start"), F.col("c_end"), F.coalesce("changes", none))
    child = fn.child_sequence(F.col("parent"), consensus, F.col("c_start"), F.col("c_end"), F.col("left"), F.col("right"), F.col("fill"))
    seq = F.when(F.col("kind") == "single", F.col("parent")).otherwise(child)
    ends = F.col("kind").isin("full", "single")
    made = rows.select(
        "unitig", "cluster", F.col("node").alias("seg"), seq.alias("seq"), F.rint("cov").cast("int").alias("dp"), "left", "right", "kind", F.coalesce("n_snp", F.lit(0)).cast("long").alias("n_snp"),
        (ends | (F.col("kind") == "path") & F.col("root")).alias("is_src"), (ends | (F.col("kind") == "path") & F.col("leaf")).alias("is_sink"),
    )
    return t.put("made", made), t.put("path_links", steps.select(F.col("src").alias("from_seg"), F.lit("+").alias("from_orient"), F.col("dst").alias("to_seg"), F.lit("+").alias("to_orient"), F.col("weight").alias("ex")))


_LINK = ["from_seg", "from_orient", "to_seg", "to_orient", "ex"]


def _graph(t: Tables, made: DataFrame, steps: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of the graph in which clusters have taken their unitigs' places."""
    segments, links = t.get("segments"), t.get("links").select("from_seg", "from_orient", "to_seg", "to_orient", "ex")
    reads = t.get("clusters").where("cluster IS NOT NULL").select("unitig", "read_id", "cluster")
    removed = made.select("unitig").distinct()
    going_on = t.put("clips", clips(t.get("records")))
    around = links.select(F.col("from_seg").alias("src"), F.col("to_seg").alias("dst"))
    near = graphs.within_hops(around, c.max_hops - 1, going_on.select(F.col("unitig").alias("node"))).select(F.col("src").alias("unitig"), F.col("dst").alias("next"))
    ends = made.where("is_src OR is_sink")
    joined = haplotypes.linked_clusters(going_on, reads, ends.select("unitig", "cluster", "is_src", "is_sink"), near, removed)
    name = lambda u, k: F.concat_ws("_", u, F.col(k).cast("string"))  # noqa: E731  the unitig alone without a cluster
    new = joined.select(name("from_unitig", "from_cluster").alias("from_seg"), "from_orient", name("to_unitig", "to_cluster").alias("to_seg"), "to_orient", F.col("weight").alias("ex")).union(steps.select(_LINK))
    new = cut(new)
    parental = haplotypes.parental_links(links, ends.select("seg", "unitig", "is_src", "is_sink"), removed, new)
    old = graphs.without_segments(links, removed.select(F.col("unitig").alias("node")), "from_seg", "to_seg")
    fresh = made.select(F.col("seg").alias("unitig"), "seq", F.length("seq").alias("length"), "dp")
    means = t.get("depths").select("unitig", F.rint("mean").cast("int").alias("mean"))
    stay = segments.join(removed, "unitig", "left_anti").join(means, "unitig", "left").select("unitig", "seq", "length", F.coalesce("mean", "dp").alias("dp"))
    whole = t.put("new_segments", stay.unionByName(fresh))
    every = old.select(_LINK).unionByName(new.select(_LINK)).unionByName(parental.select(_LINK))
    return whole, t.put("new_links", graphs.clean_links(every, whole))


def _write_graph(segments: DataFrame, links: DataFrame, *paths: str) -> None:
    for path in paths:
        formats.write_gfa(segments, links.withColumn("overlap", F.lit("0M")), path)


def transform(spark: SparkSession, out: str, c: Config, link_simplify: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of the phased graph; writes graphs, tables, report, variants and merged clusters."""
    inter = f"{out}/intermediate"
    t = Tables(spark, f"{inter}/tables")
    nodes, cons = _clusters_of(t, c)
    made, steps = _children(t, nodes, cons, c)
    segments, links = _graph(t, made, steps, c)
    _write_graph(segments, links, f"{inter}/10_fine_clusters.gfa", f"{out}/strain_unitigs.gfa")
    formats.write_fasta(segments, f"{inter}/strain_unitigs.fasta")
    merged, merged_links, members = haplotypes.merged_segments(segments, links)
    merged, merged_links, members = t.put("merged", merged), t.put("merged_links", merged_links), t.put("members", members)
    simple = haplotypes.simplified_links(links, segments.select(F.col("unitig").alias("seg"), "dp"), c.depth_ratio)
    plain, plain_links, _ = haplotypes.merged_segments(segments, cut(simple))
    plain, plain_links = t.put("simplified", plain), t.put("simplified_links", plain_links)
    _write_graph(merged, merged_links, f"{inter}/20_extended_haplotypes.gfa")
    _write_graph(plain, plain_links, f"{inter}/30_links_simplification.gfa")
    _write_graph(*((plain, plain_links) if link_simplify else (merged, merged_links)), f"{out}/strain_contigs.gfa")
    counts = made.groupBy("unitig").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("full", "path", "other")])
    formats.write_table(counts, f"{inter}/stats_clusters")
    phased, reference = statistics(t, made)
    formats.write_table(phased, f"{out}/phased_unitig_info_table")
    formats.write_table(reference, f"{out}/reference_unitig_info_table")
    formats.write_table(reports.per_unitig(phased), f"{out}/unitig_summary_table")
    strain_report(t.put("phased", phased), t.put("reference", reference), c).write.mode("overwrite").text(f"{out}/multiplicity_stats")
    formats.write_vcf(strain_variants(t, made), f"{out}/strain_variants.vcf", lengths=t.get("segments").select("unitig", "length"))
    clusters = t.get("clusters")
    renamed = clusters.join(members.select(F.col("seg"), "merged"), _name() == F.col("seg"), "left").select("unitig", "read_id", F.coalesce("merged", _name()).alias("cluster"), F.col("s").alias("start")).withColumn("cluster", F.when(F.col("cluster") == F.col("unitig"), F.lit(None)).otherwise(F.col("cluster")))
    formats.write_clusters(renamed, f"{inter}/clusters_merged")
    formats.write_sam(t.get("segments").select("unitig", "length"), _coloured(t.get("reads").join(renamed.select("unitig", "read_id", "cluster"), ["unitig", "read_id"])), f"{out}/alignment_phased.sam")
    return merged, merged_links


def statistics(t: Tables, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the new segments and of the reference unitigs."""
    depths = t.get("depths").select("unitig", F.rint("mean").cast("long").alias("ref_cov"))
    n = F.length("seq")
    density = fn.three_digits(F.col("n_snp") / n)
    phased = made.join(depths, "unitig").select(
        F.col("seg").alias("Strain_unitig"), F.col("unitig").alias("Reference_unitig"), n.alias("Length"), F.col("dp").alias("Coverage"), F.coalesce(F.floor(F.try_divide(100 * F.col("dp"), F.col("ref_cov"))), F.lit(0)).cast("long").alias("Abundance_Ratio"),
        F.col("n_snp").alias("#SNP"), density.alias("SNP_density"), F.col("left").alias("Start_position"), F.col("right").alias("End_position"),
    )
    sites = t.get("snps").groupBy("unitig").agg(F.count(F.lit(1)).alias("n"))
    children = made.groupBy("unitig").agg(F.count(F.lit(1)).alias("k"))
    chosen = t.get("eligible").distinct().withColumn("chosen", F.lit(True))
    rows = t.get("segments").select("unitig", "length").join(depths, "unitig", "left").join(sites, "unitig", "left").join(children, "unitig", "left").join(chosen, "unitig", "left")
    reference = rows.select(
        F.col("unitig").alias("Reference_unitig"), F.col("length").alias("Length"), F.coalesce("ref_cov", F.lit(0)).alias("Coverage"), fn.three_digits(F.coalesce("n", F.lit(0)) / F.col("length")).alias("SNP_density"),
        F.coalesce("chosen", F.lit(False)).alias("Is_processed"), (F.coalesce("k", F.lit(0)) > 1).alias("Is_phased"),
    )
    return phased, reference


def strain_report(phased: DataFrame, reference: DataFrame, c: Config, only: DataFrame | None = None) -> DataFrame:
    """value: lines of the text report on totals, multiplicity, depth and divergence; ``only`` (id) restricts the unitigs."""
    if only is not None:
        phased = phased.join(only.select(F.col("id").alias("Reference_unitig")), "Reference_unitig", "left_semi")
        reference = reference.join(only.select(F.col("id").alias("Reference_unitig")), "Reference_unitig", "left_semi")
    w = c.report_window
    ref = reference.select(F.col("Reference_unitig").alias("unitig"), F.col("Length").alias("length"), "Is_processed", "Is_phased")
    own = phased.select(F.col("Reference_unitig").alias("unitig"), F.col("Length").alias("length"), F.col("Coverage").alias("cov"), F.col("SNP_density").cast("double").alias("rate"), F.col("Start_position").alias("s"), F.col("End_position").alias("e"))
    names = {"Reference utgs input": ref, "Reference utgs select": ref.where("Is_processed"), "Reference utgs phased": ref.where("Is_phased"), "Strain utgs assembled": own}
    sums = reports.totals({f"{k}{name}": df for k, (name, df) in enumerate(names.items())})
    bins = coverage.binned(own.join(ref.select("unitig", F.col("length").alias("whole")), "unitig").withColumn("e", F.least("e", F.floor(F.col("whole") / w) * w)), "unitig", w)
    order = lambda part, df, at, text: df.select(F.lit(part).alias("part"), at.cast("double").alias("at"), text.alias("value"))
    bar = lambda x: F.repeat(F.lit("*"), F.floor(F.col(x) / F.max(x).over(Window.partitionBy(F.lit(1))) * 20).cast("int"))  # noqa: E731  a row for each bar
    share = lambda x: F.col(x) / F.max(x).over(Window.partitionBy(F.lit(1)))
    deep = reports.depth_histogram(own, w).withColumn("share", share("bins")).withColumn("bar", bar("bins")).where("share > 0.05")
    far = reports.divergence_histogram(own, c.min_divergence).where("label <= 1").withColumn("share", share("bp")).withColumn("bar", bar("bp")).where("share > 0.01")
    head = lambda part, text: reference.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(-1.0).alias("at"), F.lit(text).alias("value"))
    lines = [
        order(0, sums, F.substring("stage", 1, 1), F.format_string("%s:\tlen: %d\tnum: %d\tN50:%d", F.expr("substring(stage, 2)"), "total", "n", "n50")),
        head(1, "\nMultiplicity\nMul\tRefSeqLength"),
        order(1, reports.multiplicity(bins, w), F.col("multiplicity"), F.concat_ws("\t", F.col("multiplicity").cast("string"), F.col("bp").cast("string"), "bar")),
        head(2, "\nRead depth"),
        order(2, deep, F.col("cov"), F.concat_ws("\t", F.col("cov").cast("string"), (F.col("bins") * w).cast("string"), "bar")),
        head(3, "\nSNP divergence\nRate\tStrainSeq"),
        order(3, far, F.col("bin"), F.concat_ws("\t", F.format_string("%.5f", "label"), F.col("bp").cast("string"), "bar")),
    ]
    whole = lines[0]
    for df in lines[1:]:
        whole = whole.union(df)
    return whole.coalesce(1).sortWithinPartitions("part", "at").select("value")  # a few dozen lines


def strain_variants(t: Tables, made: DataFrame) -> DataFrame:
    """Variant rows of the sites at which a new segment's consensus differs from its unitig."""
    base = F.substring("parent", (F.col("pos") + 1).cast("int"), F.lit(1))
    at = t.get("snps").select("unitig", "pos").distinct().join(t.get("segments").select("unitig", F.col("seq").alias("parent")), "unitig").select("unitig", "pos", F.upper(base).alias("ref"))
    own = t.get("consensus").where("base IS NOT NULL").select("unitig", "cluster", "pos", "base").join(made.where("kind <> 'single'").select("unitig", "cluster", "seg"), ["unitig", "cluster"]).join(at, ["unitig", "pos"])
    differs = F.col("base") != F.col("ref")
    hap = own.groupBy("unitig", "pos", "ref").agg(
        F.sort_array(F.collect_set(F.when(differs, F.col("base")))).alias("alts"), F.sort_array(F.collect_set(F.when(differs, F.col("seg")))).alias("ah"), F.sort_array(F.collect_set(F.when(~differs, F.col("seg")))).alias("rh"), F.count_if(differs).alias("dv"), F.count(F.lit(1)).alias("dp")
    )
    rows = hap.where("size(alts) > 0")
    info = F.concat(F.lit("ALT_HAP="), F.array_join("ah", ","), F.when(F.size("rh") > 0, F.concat(F.lit(";REF_HAP="), F.array_join("rh", ","))).otherwise(""))
    return rows.select(
        F.col("unitig").alias("CHROM"), (F.col("pos") + 1).alias("POS"), F.concat_ws("_", F.lit("SNP"), "unitig", (F.col("pos") + 1).cast("string")).alias("ID"), F.col("ref").alias("REF"), F.array_join("alts", ",").alias("ALT"), F.lit(60).alias("QUAL"), F.lit("PASS").alias("FILTER"),
        info.alias("INFO"), F.lit("GT:DV:DP").alias("FORMAT"), F.concat_ws(":", F.lit("0/1"), F.col("dv").cast("string"), F.col("dp").cast("string")).alias("sample"),
    )


def run(spark: SparkSession, graph: str, sam: str, out: str, c: Config, stage: str = "e2e", vcf: str | None = None, link_simplify: bool = False) -> None:
    """One stage, or both."""
    if stage not in ("phase", "transform", "e2e"):
        raise ValueError(f"no such stage: {stage}")
    if stage in ("phase", "e2e"):
        phase(spark, graph, sam, out, c, vcf)
    if stage in ("transform", "e2e"):
        transform(spark, out, c, link_simplify)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m haploom", description="Phase reads on an assembly graph.")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-g", "--graph", required=True, help="GFA or FASTA")
    p.add_argument("-b", "--alignments", required=True, help="SAM text, one file or a folder")
    p.add_argument("-m", "--mode", choices=["hifi", "nano"], default="nano")
    p.add_argument("-s", "--stage", choices=["phase", "transform", "e2e"], default="e2e")
    p.add_argument("--snp", help="VCF of known SNPs")
    p.add_argument("--link-simplify", action="store_true")
    p.add_argument("-d", "--cluster-divergence", type=float, default=Config.cluster_divergence)
    p.add_argument("-a", "--allele-frequency", type=float, default=Config.allele_frequency)
    p.add_argument("--min-unitig-length", type=float, default=Config.min_length / 1000, help="kb")
    p.add_argument("--min-unitig-coverage", type=int, default=Config.min_depth)
    p.add_argument("--max-unitig-coverage", type=int, default=Config.max_depth)
    a = p.parse_args(argv)
    if not 0 < a.allele_frequency < 1:
        p.error("the allele frequency is a share between 0 and 1")
    if a.cluster_divergence is not None and not 0 <= a.cluster_divergence < 1:
        p.error("the divergence is a share between 0 and 1")
    if a.min_unitig_length < 0 or not 0 <= a.min_unitig_coverage <= a.max_unitig_coverage:
        p.error("lengths and depths are not negative, and the smallest depth isn't above the largest")
    if not a.graph.endswith((".gfa", ".fa", ".fasta", ".fa.gz", ".fasta.gz")):
        p.error("the graph is a .gfa, .fa or .fasta file")
    c = replace(
        Config.of_mode(a.mode), cluster_divergence=a.cluster_divergence, allele_frequency=a.allele_frequency, min_length=int(1000 * a.min_unitig_length), min_depth=a.min_unitig_coverage, max_depth=a.max_unitig_coverage,
    )
    spark = SparkSession.builder.appName("haploom").getOrCreate()
    for path in filter(None, (a.graph, a.alignments, a.snp)):
        if not formats.exists(spark, path):
            p.error(f"there is no {path}")
    run(spark, a.graph, a.alignments, a.output, c, a.stage, a.snp, a.link_simplify)


if __name__ == "__main__":
    main()
