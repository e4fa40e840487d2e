"""The whole run on a small made-up graph: three haplotypes of one unitig, one of which goes on in another."""

import random

import pytest

from haploom.plans import run
from haploom.plans.config import Config
from haploom.sources import formats

SITES = list(range(450, 5600, 300))


def _files(folder):
    rnd = random.Random(7)
    u1, u2 = ("".join(rnd.choice("ACGT") for _ in range(n)) for n in (6000, 3000))
    other = str.maketrans("ACGT", "CGTA")
    haps = []
    for h in range(3):
        s = list(u1)
        for k, p in enumerate(SITES):
            if h and k % 2 == h - 1:
                s[p] = s[p].translate(other)
        haps.append("".join(s))
    lines, truth = ["@HD\tVN:1.6"], {}
    for h, s in enumerate(haps):
        for i in range(44):
            start, n = min(i // 2 * 200, 4000), 2200
            seq = s[start : start + n]
            name = f"r{h}_{i:02d}"
            truth[name] = h
            split = h == 0 and start + n >= 6000
            tail = u2[:1500] if split else ""
            cigar = f"{len(seq)}M" + (f"{len(tail)}S" if split else "")
            lines.append(f"{name}\t{16 * (i % 2)}\tu1\t{start + 1}\t60\t{cigar}\t*\t0\t0\t{seq + tail}\t*\tde:f:0.01")
            if split:
                lines.append(f"{name}\t{2048 + 16 * (i % 2)}\tu2\t1\t60\t{len(seq)}H{len(tail)}M\t*\t0\t0\t{tail}\t*\tde:f:0.01")
    for i in range(20):
        start = 100 * (i % 10)
        lines.append(f"x{i:02d}\t{16 * (i % 2)}\tu2\t{start + 1}\t60\t{3000 - start}M\t*\t0\t0\t{u2[start:]}\t*\tde:f:0.01")
    (folder / "g.gfa").write_text(f"S\tu1\t{u1}\tLN:i:6000\nS\tu2\t{u2}\tLN:i:3000\nS\tu3\tACGT\tLN:i:4\nL\tu1\t+\tu2\t+\t0M\nL\tu2\t+\tu3\t-\t0M\n")
    (folder / "a.sam").write_text("\n".join(lines) + "\n")
    return haps, u2, truth


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    haps, u2, truth = _files(folder)
    out = str(folder / "out")
    run.run(spark, str(folder / "g.gfa"), str(folder / "a.sam"), out, Config(min_depth=5))
    return out, haps, u2, truth


def test_clusters_are_the_haplotypes(spark, done):
    out, _, _, truth = done
    found = {}
    for r in spark.read.parquet(f"{out}/intermediate/tables/clusters").where("unitig = 'u1'").collect():
        found.setdefault(r["cluster"], set()).add(truth[r["read_id"]])
    assert len(found) == 3 and None not in found
    assert sorted(map(list, found.values())) == [[0], [1], [2]]


def test_segments_are_the_haplotypes(spark, done):
    out, haps, u2, _ = done
    segments, links = formats.read_gfa(spark, f"{out}/strain_unitigs.gfa")
    got = {r["unitig"]: r["seq"] for r in segments.collect()}
    assert sorted(got) == ["u1_1", "u1_2", "u1_3", "u2_1", "u3"]
    assert got["u2_1"] == u2
    assert all(any(got[f"u1_{k}"] in h for h in haps) for k in (1, 2, 3))
    assert len({got[f"u1_{k}"] for k in (1, 2, 3)}) == 3 and min(len(got[f"u1_{k}"]) for k in (1, 2, 3)) > 5500
    pairs = {(r["from_seg"], r["from_orient"], r["to_seg"], r["to_orient"]) for r in links.collect()}
    own = next(k for k in (1, 2, 3) if got[f"u1_{k}"] in haps[0])
    assert (f"u1_{own}", "+", "u2_1", "+") in pairs or ("u2_1", "-", f"u1_{own}", "-") in pairs
    assert ("u2_1", "+", "u3", "-") in pairs
    assert not any(a.startswith("u1") and a != f"u1_{own}" for a, *_ in pairs)


def test_contigs_are_merged(spark, done):
    out, haps, u2, _ = done
    got = {r["unitig"]: r["seq"] for r in formats.read_gfa(spark, f"{out}/strain_contigs.gfa")[0].collect()}
    long = [s for s in got.values() if u2 in s or formats_reverse(u2) in s]
    assert len(got) == 3 and len(long) == 1 and len(long[0]) > 8500


def formats_reverse(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_reports(spark, done):
    out = done[0]
    lines = [r[0] for r in spark.read.text(f"{out}/multiplicity_stats").collect()]
    assert lines[0].startswith("Reference utgs input:\tlen: 9004\tnum: 3")
    assert any(x.startswith("Strain utgs assembled") and "num: 4" in x for x in lines)
    v = formats.read_vcf(spark, f"{out}/strain_variants.vcf").collect()
    assert sorted(r["POS"] for r in v) == [p + 1 for p in SITES]
    assert formats.read_ids(spark, f"{out}/intermediate/filtered_out.txt").count() == 1
    reads = formats.read_sam(spark, f"{out}/alignment_phased.sam")
    assert reads.count() == spark.read.parquet(f"{out}/intermediate/tables/reads").count()
    table = spark.read.option("header", True).option("sep", "\t").csv(f"{out}/phased_unitig_info_table")
    assert table.count() == 4 and "SNP_density" in table.columns


def test_transform_starts_again_from_the_tables(spark, done):
    out = done[0]
    before = {r["unitig"] for r in formats.read_gfa(spark, f"{out}/strain_contigs.gfa")[0].collect()}
    run.run(spark, "", "", out, Config(min_depth=5), stage="transform", link_simplify=True)
    assert {r["unitig"] for r in formats.read_gfa(spark, f"{out}/strain_contigs.gfa")[0].collect()} == before


def test_unknown_stage(spark):
    with pytest.raises(ValueError):
        run.run(spark, "", "", "", Config(), stage="polish")
