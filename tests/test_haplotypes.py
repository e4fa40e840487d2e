from pyspark.sql import functions as F

from haploom.functions import align
from haploom.functions import sequence as fn
from haploom.operators import graphs, haplotypes, pileup


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_aligned_blocks(spark):
    got = value(spark, fn.aligned_blocks(F.lit("5S10M2I3D20=4N1X100H"), F.lit(1000)))
    assert [tuple(b) for b in got] == [(1000, 5, 10), (1013, 17, 20), (1037, 37, 1)]


def test_child_sequence(spark):
    child = lambda left, right, fill: value(spark, fn.child_sequence(F.lit("AAAAACCCCC"), F.lit("GGG"), F.lit(4), F.lit(7), F.lit(left), F.lit(right), F.lit(fill)))
    assert child(2, 6, True) == "AAGGG"
    assert child(5, 6, True) == "GG"
    assert child(2, 6, False) == "GGG"
    assert child(9, 3, True) == "A"


def test_patched(spark):
    changes = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(b).alias("base")) for p, b in ((1, "T"), (3, "G"), (9, "C"))])
    assert value(spark, fn.patched(F.lit("AAAAAAAA"), F.lit(1), F.lit(6), changes)) == "TAGAA"
    assert value(spark, fn.patched(F.lit("AAAAAAAA"), F.lit(4), F.lit(6), changes)) == "AA"


def test_link_orients(spark):
    got = [tuple(value(spark, fn.link_orients(F.lit(s), F.lit(o)))) for s in "RL" for o in "+-"]
    assert got == [("+", "+"), ("+", "-"), ("-", "-"), ("-", "+")]


def test_pileup_reads(spark):
    got = value(spark, fn.pileup_reads(F.lit("..^]A$+2AC,*-11ACGTACGTACG")))
    assert got["tokens"] == "..A,*"
    assert [tuple(x) for x in got["indels"]] == [(2, "+", "AC"), (4, "-", "ACGTACGTACG")]


def test_variants_are_numbered_over_unitigs(spark):
    rows = [("b", 1, "A", ".C", "JJ", "x,y"), ("a", 9, "A", "..", "JJ", "x,y"), ("a", 7, "A", "G.", "JJ", "x,y"), ("a", 8, "A", ".+1T.", "JJ", "x,y")]
    df = spark.createDataFrame(rows, "unitig string, pos long, ref string, bases string, mapqs string, names string")
    got = {r["ID"]: (r["REF"], r["ALT"], r["INFO"]) for r in pileup.variants(df).collect()}
    assert got == {"SNP_0": ("A", "G", "ALT_HAP=x;REF_HAP=y"), "INS_1": ("A", "AT", "ALT_HAP=x;REF_HAP=y"), "SNP_2": ("A", "C", "ALT_HAP=y;REF_HAP=x")}


def test_merged_segments_on_both_strands(spark):
    segments = spark.createDataFrame([("a", "AC", 10), ("b", "GGT", 20), ("c", "T", 5), ("d", "CC", 5)], "unitig string, seq string, dp int")
    links = spark.createDataFrame([("a", "+", "b", "-"), ("c", "+", "b", "+"), ("c", "-", "d", "+"), ("c", "-", "d", "-")], "from_seg string, from_orient string, to_seg string, to_orient string")
    new, left, members = haplotypes.merged_segments(segments, links)
    # a+ b- c- in a row; beyond c there are two ways on
    assert {tuple(r) for r in new.collect()} == {("a_b_c", "ACACCA", 6, 14), ("d", "CC", 2, 5)}
    assert {tuple(r) for r in left.collect()} == {("a_b_c", "+", "d", "+"), ("a_b_c", "+", "d", "-")}
    assert {r["seg"]: r["orient"] for r in members.where("merged = 'a_b_c'").collect()} == {"a": "+", "b": "-", "c": "-"}


def test_merging_without_chains(spark):
    segments = spark.createDataFrame([("a", "AC", 10)], "unitig string, seq string, dp int")
    links = spark.createDataFrame([("a", "+", "a", "+")], "from_seg string, from_orient string, to_seg string, to_orient string")
    new, left, _ = haplotypes.merged_segments(segments, links)
    assert [tuple(r) for r in new.collect()] == [("a", "AC", 2, 10)] and left.count() == 1


def test_remaining_is_longest_first(spark):
    nodes = spark.createDataFrame([("a", 0, 9), ("b", 0, 8), ("c", 0, 7), ("d", 0, 6)], "node string, first long, last long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    used = spark.createDataFrame([("a",)], "node string")
    assert {r[0] for r in haplotypes.remaining(nodes, edges, used).collect()} == {"c"}


def test_long_paths_go_on_from_files(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(7)], "src long, dst long")
    ends = lambda n: spark.createDataFrame([(n,)], "node long")
    assert [r["path"] for r in graphs.full_paths(e, ends(0), ends(7), 10).collect()] == [list(range(8))]
    assert graphs.full_paths(e, ends(0), ends(7), 6).count() == 0
    assert graphs.within_hops(e, 2, ends(0)).count() == 2


def test_lift_and_mask():
    # own AC-GT against the reference, which lacks nothing and has one base more
    assert align.lifted("AC-GT", 3, "ACG-T", "ACGGT") == 3
    assert align.lifted("ACGT", 3, "AC-GT", "ACTGT") == 5
    assert align.lifted("AC", 1, "A", "A") == -1
    assert align.masked("ACG", "ATG", "|.|", lambda _: 9, lambda _: 2, 3) == "|||"
    assert align.masked("ACG", "ATG", "|.|", lambda _: 9, lambda _: 9, 3) == "|.|"


def test_colours(spark):
    assert value(spark, fn.colour(F.lit(1), F.lit(1))) == "#440154"
    assert value(spark, fn.colour(F.lit(None).cast("int"), F.lit(2))) == "#505050"
