from pyspark.sql import functions as F

from haploom.functions import sequence as fn
from haploom.sources import formats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_cigar(spark):
    span = lambda rev: tuple(value(spark, fn.cigar_span(F.lit("5S10M2I3D20M100H"), F.lit(1000).cast("long"), F.lit(rev))))
    assert span(False) == (1033, 5, 37, 137)
    assert span(True) == (1033, 100, 132, 137)


def test_numbers_and_gaps(spark):
    assert [value(spark, fn.three_digits(F.lit(x))) for x in (0.0, 0.00123456, 1.2345)] == ["0.000", "0.00123", "1.23"]
    assert value(spark, fn.inner_gap_runs(F.lit("---AC-----GT--A------"), 5)) == [5]
    assert value(spark, fn.reverse_complement(F.lit("AACGT"))) == "ACGTT"


def test_pileup(spark):
    assert value(spark, fn.pileup_tokens(F.lit("..^]A$+2AC,*"))) == "MMMMS"
    assert value(spark, fn.pileup_indels(F.lit("..^]A$+2AC,*"))) == "+"
    assert value(spark, fn.pileup_tokens(F.lit(""))) == ""


def test_gfa_round_trip(spark, tmp_path):
    (tmp_path / "a.gfa").write_text("S\tu1\tACGT\tLN:i:4\tDP:f:20\nS\tu2\tGG\tLN:i:2\tDP:f:7\nL\tu1\t+\tu2\t-\t0M\tex:i:3\n")
    s, l = formats.read_gfa(spark, str(tmp_path / "a.gfa"))
    assert {tuple(r) for r in s.collect()} == {("u1", "ACGT", 4, 20), ("u2", "GG", 2, 7)}
    formats.write_gfa(s, l, str(tmp_path / "b"))
    s2, l2 = formats.read_gfa(spark, str(tmp_path / "b"))
    assert {tuple(r) for r in s2.collect()} == {tuple(r) for r in s.collect()}
    assert [tuple(r) for r in l2.collect()] == [("u1", "+", "u2", "-", "0M", 3)]


def test_fasta_vcf_bed_sam(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">u1 x\nAC\nGT\n>u2\nGG\n")
    fa = formats.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {tuple(r) for r in fa.collect()} == {("u1", "ACGT", 4), ("u2", "GG", 2)}
    formats.write_fasta(fa, str(tmp_path / "fa2"))
    assert {tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "fa2")).collect()} == {tuple(r) for r in fa.collect()}
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n" + "u1\t5\t.\tA\tC\t30\tPASS\t.\n" + "u1\t6\t.\tAG\tC\t30\tPASS\t.\n" + "u1\t7\t.\tA\tC\t30\tLOW\t.\n")
    assert [r["POS"] for r in formats.read_vcf(spark, str(tmp_path / "a.vcf")).collect()] == [5]
    (tmp_path / "a.bed").write_text("u1\t0\t10\t3\nbroken\nu1\t10\t20\t5\n")
    assert [r["cov"] for r in formats.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [3, 5]
    (tmp_path / "a.sam").write_text("@HD\nr1\t2064\tu1\t11\t60\t5M\t*\t0\t0\tACGTA\t*\tde:f:0.01\tSA:Z:u2,5,-,5M,60;\n")
    r = formats.read_sam(spark, str(tmp_path / "a.sam")).withColumn("x", formats.supplementary(F.col("sa"))).first()
    assert (r["ref_start"], r["is_reverse"], r["is_supplementary"], r["de"], r["x"][0]["unitig"], r["x"][0]["pos"]) == (10, True, True, 0.01, "u2", 5)


def test_missing_and_first_records(spark, tmp_path):
    import pytest

    (tmp_path / "a.fa").write_text(">u1\nAC\n>u2\nGG\n>u2\nTTT\n")
    assert formats.lookup_fasta(spark, str(tmp_path / "a.fa"), "u1").first()["seq"] == "AC"
    assert formats.lookup_fasta(spark, str(tmp_path / "a.fa"), "u2").count() == 1
    with pytest.raises(KeyError):
        formats.lookup_fasta(spark, str(tmp_path / "a.fa"), "u3")
    assert formats.read_clusters(spark, str(tmp_path / "none")).count() == 0


def test_layers_of_a_circle(spark):
    import pytest

    from haploom.operators import graphs

    with pytest.raises(ValueError):
        graphs.layers(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, dst long"))


def test_arguments_are_checked(spark, tmp_path):
    import pytest

    from haploom.plans.run import main

    (tmp_path / "a.gfa").write_text("S\tu1\tACGT\n")
    graph = ["-o", str(tmp_path / "out"), "-g", str(tmp_path / "a.gfa")]
    for wrong in (["-b", str(tmp_path / "none.sam")], ["-b", "x", "-a", "2"], ["-b", "x", "-d", "1.5"], ["-b", "x", "--min-unitig-coverage", "9", "--max-unitig-coverage", "3"]):
        with pytest.raises(SystemExit):
            main([*graph, *wrong])
    with pytest.raises(SystemExit):
        main(["-o", "x", "-g", "graph.txt", "-b", "y"])
