import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from haploom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from oracle import SF, same  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name])


def test_independent_set_is_maximal(spark):
    from pyspark.sql import functions as F

    from haploom.plans.projection import table

    taken = {r[0] for r in QUERIES["independent_set"](spark, SF).collect()}
    e = table(spark, SF, "lineitem").select(F.col("l_partkey"), (F.col("l_partkey") * 31 + F.col("l_linenumber")) % 997).distinct().collect()
    pairs = [(a, b) for a, b in e if a != b]
    assert not any(a in taken and b in taken for a, b in pairs)
    near = {x for a, b in pairs for x in (a, b) if a in taken or b in taken}
    assert near == {x for p in pairs for x in p}


def test_label_propagation_stays_in_components(spark):
    from haploom.operators.components import components
    from haploom.operators.graphs import label_propagation

    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)], "src long, dst long, w double")
    labels = dict(label_propagation(e).collect())
    parts = dict(components(e, "src", "dst").collect())
    assert all(parts[n] == parts[label] for n, label in labels.items())
    assert len({labels[n] for n in (1, 2, 3)}) == 1


def test_simplify_links(spark):
    from haploom.operators.graphs import simplified

    # 1 -> 3 is the only way on from 1; 2 has another way, so 2 -> 3 goes
    e = spark.createDataFrame([(1, 3), (2, 3), (2, 4)], "src long, dst long")
    depth = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "node long, depth long")
    assert {tuple(r) for r in simplified(e, depth, 1.6).collect()} == {(1, 3), (2, 4)}


def test_simplify_links_goes_on_until_nothing_changes(spark):
    from haploom.operators.graphs import simplified

    # each drop leaves the next node with one way on: one drop a round
    e = [(k, 100 + k + d) for k in range(26) for d in (0, 1) if k or d]
    depth = [(n, 100 if n < 100 else 10) for n in {x for p in e for x in p}]
    left = simplified(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame(depth, "node long, depth long"), 1.6)
    assert {tuple(r) for r in left.collect()} == {(k, 101 + k) for k in range(26)}


def test_label_propagation_goes_on_until_nothing_changes(spark):
    from haploom.operators.graphs import label_propagation

    # every node follows the one before it; the first two swap their labels
    e = spark.createDataFrame([(n, n + 1, 100.0 - n) for n in range(1, 26)], "src long, dst long, w double")
    assert dict(label_propagation(e).collect()) == dict.fromkeys(range(1, 27), 1)


def test_phased_clusters(spark):
    rows = QUERIES["phased_clusters"](spark, SF).collect()
    assert rows and all(r["n_reads"] >= 6 and r["last"] > r["first"] for r in rows)


def test_child_segments_joins_no_sequences(spark):
    """A sequence of thousands of letters counts as 20 bytes when Spark decides on a broadcast, so joins carry lengths alone."""

    def joined(plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        here = [c.output().mkString(",") for c in children] if "Join" in plan.nodeName() else []
        return here + [x for c in children for x in joined(c)]

    sides = joined(QUERIES["child_segments"](spark, SF)._jdf.queryExecution().optimizedPlan())
    assert sides and not any("seq" in side for side in sides)


def test_distances_deal_the_reads_once(spark):
    """Reads, observations and sites are dealt by unitig alone, so that nothing but the alignments is written for a shuffle."""
    import re

    from haploom.plans import queries
    from haploom.plans.checkpoints import dealt_once

    with dealt_once(spark):
        plan = queries._distances(spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert keys and not any("," in key for key in keys)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_cluster_edges_are_made_where_reads_lie(spark):
    """What the overlap graph's edges come from joins by unitig and position, and by unitig and read, without another shuffle."""
    import re

    from haploom.operators import alleles, distances
    from haploom.plans import queries
    from haploom.plans.checkpoints import dealt_once

    with dealt_once(spark):
        ext = alleles.extent(queries._clusters(spark, SF), ["unitig", "cluster"]).where("n_reads > 1")
        cons = queries._consensus(spark, SF).where("alt_flag").select("unitig", "cluster", "pos", "base")
        plan = distances.cluster_distances(ext, cons, queries.C.min_overlap)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert keys and not any("," in key for key in keys)


@pytest.mark.parametrize("name", ["overlap_graph", "path_boundaries", "usable_paths", "read_components"])
def test_parts_of_unitigs_equal_the_sql(spark, monkeypatch, name):
    # what is between the steps is on disk for one part of the unitigs at once
    from haploom.plans import projection

    seen, whole = set(), projection.alignments
    from haploom.plans import haplotype_queries, queries

    for module in (queries, haplotype_queries):
        monkeypatch.setattr(module, "alignments", lambda spark, d, part=projection.WHOLE: seen.add(part) or whole(spark, d, part))
    monkeypatch.setattr(projection, "PART_ROWS", 4000)
    assert same(spark, QUERIES[name], ORACLES[name])
    assert len(seen) > 1 and seen == {(k, len(seen)) for k in range(len(seen))}


@pytest.mark.parametrize("name", ["phased_clusters", "label_propagation"])
def test_parts_of_unitigs_equal_the_whole(spark, monkeypatch, name):
    # F7, F9
    from haploom.plans import projection

    whole = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(projection, "PART_ROWS", 4000)
    assert projection.table(spark, SF, "lineitem").count() > 4000
    assert sorted(map(str, QUERIES[name](spark, SF).collect())) == whole


def test_phased_clusters_are_those_of_accepted_reads(spark):
    # reads of eligible unitigs are filtered, sites have support on both strands, and clusters come from cluster_reads, not from components of all reads
    import duckdb
    import numpy as np
    from haploom.operators.clustering import cluster_reads
    from haploom.plans.queries import _ALN, _OBS, C

    db = duckdb.connect()
    for name in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    eligible = {r[0] for r in db.execute(ORACLES["eligible_unitigs"]).fetchall()}
    accepted = {(r[0], r[1]): (r[2], r[3]) for r in db.execute(ORACLES["read_filter"]).fetchall() if r[0] in eligible}
    good = f"WITH {_OBS.replace('FROM placed)', 'FROM placed WHERE round(l_discount*600) >= 20)')}"
    strand = ORACLES["strand_filter"].replace("FROM placed)", "FROM placed WHERE round(l_discount*600) >= 20)")
    assert good != f"WITH {_OBS}" and strand != ORACLES["strand_filter"]
    sites = {(r[0], r[1]): ord(r[2]) for r in db.execute(strand).fetchall()}
    bases = {(r[0], r[1], r[2]): ord(r[3]) for r in db.execute(f"WITH {_OBS} SELECT unitig, read_id, pos, base FROM obs").fetchall()}
    length = dict(db.execute(f"WITH {_ALN} SELECT DISTINCT unitig, length FROM aln").fetchall())
    want = set()
    for unitig in eligible:
        reads = sorted(r for u, r in accepted if u == unitig)
        pos = sorted(p for u, p in sites if u == unitig)
        pos = [p for p in pos if any((unitig, r, p) in bases for r in reads)]
        at = np.array([accepted[unitig, r] for r in reads], np.int64).reshape(-1, 2)
        if not reads:
            continue
        label = np.zeros(len(reads), np.int64)
        if pos:
            seen = np.array([[bases.get((unitig, r, p), 0) for p in pos] for r in reads], np.int8)
            label = cluster_reads(seen, at[:, 0], at[:, 1], C, np.array(pos), np.array([sites[unitig, p] for p in pos]), length[unitig])
        for k in set(label[label >= 0].tolist()):
            mine = np.flatnonzero(label == k)
            if len(mine) >= C.min_final_size:
                want.add((unitig, reads[k], len(mine), int(np.sort(at[mine, 0])[1]), int(np.sort(at[mine, 1])[-2])))
    rows = QUERIES["phased_clusters"](spark, SF).collect()
    assert len(rows) == len(want) > 20 and {tuple(r[k] for k in ("unitig", "cluster", "n_reads", "first", "last")) for r in rows} == want
    several = [r for r in rows if r["consensus"]]
    assert several and all((r["unitig"], int(x[:-1])) in sites for r in several for x in r["consensus"].split(","))
