import random

import numpy as np

from haploom.functions.align import align, score
from haploom.operators.clustering import cluster_reads, communities, twin_groups, unbranched
from haploom.plans.config import Config


def test_two_haplotypes_come_apart():
    rng = random.Random(4)
    sites = [200 * k + 100 for k in range(30)]
    truth, rows, s, e = [], [], [], []
    for k in range(60):
        start = rng.randrange(0, 2500)
        end = start + 3500
        truth.append(k % 2)
        rows.append([(65 if (j + k % 2) % 2 else 67) if start < p <= end else 0 for j, p in enumerate(sites)])
        s.append(start)
        e.append(end)
    found = cluster_reads(np.array(rows, np.int8), np.array(s), np.array(e), Config())
    assert (found >= 0).all()
    assert len(set(zip(found.tolist(), truth, strict=True))) == len(set(found.tolist())) == 2


def test_long_haplotypes_are_put_together():
    # reads reach a fifth of the unitig; each haplotype differs from the reference at two sites of three
    rng = random.Random(9)
    pos = np.arange(150, 20000, 300)
    haps = np.array([[b"ACG"[(j + h) % 3] for j in range(len(pos))] for h in range(3)], np.int8)
    ref = np.full(len(pos), ord("A"))
    truth, rows, s, e = [], [], [], []
    for k in range(180):
        start = rng.randrange(0, 16000)
        truth.append(k % 3)
        rows.append(np.where((pos > start) & (pos <= start + 4000), haps[k % 3], 0))
        s.append(start)
        e.append(start + 4000)
    found = cluster_reads(np.array(rows, np.int8), np.array(s), np.array(e), Config(), pos, ref, 20000)
    kept = [(f, t) for f, t in zip(found.tolist(), truth, strict=True) if f >= 0]
    assert len(kept) >= 150
    of = {}
    for f, t in kept:
        of.setdefault(f, set()).add(t)
    assert all(len(t) == 1 for t in of.values()) and len(of) < 12


def test_reads_without_communities_are_one_cluster():
    bases = np.array([[65, 67]] * 3 + [[67, 65]] * 3 + [[0, 0]] * 2, np.int8)
    found = cluster_reads(bases, np.zeros(8, int), np.full(8, 3000), Config())
    assert (found == 0).all()
    assert (cluster_reads(bases[:5], np.zeros(5, int), np.full(5, 3000), Config()) == -1).all()
    assert (cluster_reads(np.zeros((7, 2), np.int8), np.zeros(7, int), np.full(7, 3000), Config()) == -1).all()


def _matrix(n, edges):
    out = np.zeros((n, n), bool)
    for a, b in edges:
        out[a, b] = True
    return out


def test_graph_steps_of_clusters():
    cliques = _matrix(7, [(a, b) for g in ((0, 1, 2, 3), (4, 5, 6)) for a in g for b in g if a != b] + [(3, 4), (4, 3)])
    assert sorted(map(list, communities(cliques))) == [[0, 1, 2, 3], [4, 5, 6]]
    # 0 -> 2 goes along 0 -> 1 -> 2; 2 forks
    kept = unbranched(_matrix(5, [(0, 1), (1, 2), (0, 2), (2, 3), (2, 4)]))
    assert {tuple(map(int, x)) for x in np.argwhere(kept)} == {(0, 1), (1, 2)}
    linked = _matrix(4, [(0, 1), (1, 2), (0, 2), (2, 3)])
    assert sorted(map(list, twin_groups(linked | linked.T))) == [[0, 1], [2], [3]]


def test_alignment_is_cheapest():
    rng = random.Random(8)
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 50)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 50)))
        q, t, track = align(a, b, 4)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert (q.replace("-", ""), t.replace("-", "")) == (a, b)
        assert len(track) - track.count("|") == row[-1]


def test_score_counts_sites_and_inner_gaps():
    assert score("ACGTACGTAC", "ACCTACGTAC", "||.|||||||", 100, {102}) == 1
    assert score("ACGTACGTAC", "ACCTACGTAC", "||.|||||||", 100, {103}) == 0
    assert score("AC------GT", "ACTTTTTTGT", "||------||", 0, set()) == 6
    assert score("------ACGT", "TTTTTTACGT", "------||||", 0, set()) == 0


def test_components_within_groups(spark, monkeypatch):
    """Groups in one task, in pieces and beyond what a task holds give the same as the steps over all edges."""
    import random

    import pyarrow as pa

    from haploom.operators import components as parts

    rng = random.Random(5)
    rows = [(k, rng.randrange(60 * k), rng.randrange(60 * k)) for k in range(1, 9) for _ in range(50 * k)] + [(None, 1, 2), (3, None, 1), (4, 7, 7)]
    e = spark.createDataFrame(rows, "unitig long, a long, b long")
    from pyspark.sql import functions as F

    key = lambda c: F.struct("unitig", F.col(c).alias("n"))
    want = {(r[0], r[1], r[2]) for r in parts.components(e.where("unitig IS NOT NULL AND a <> b").select(key("a").alias("a"), key("b").alias("b"))).select("node.unitig", "node.n", "component.n").collect()}
    got = parts.components_within(e, "unitig").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want

    # the same in one process, with room for a few edges: large groups come as edges that aren't whole
    edges = sorted((k, a, b) for k, a, b in rows if None not in (k, a, b) and a != b)
    for held in (1, 7, 40, 300, 10_000):
        monkeypatch.setattr(parts, "_HELD", held)
        batches = [pa.RecordBatch.from_pydict({n: [r[i] for r in edges[at : at + 9]] for i, n in enumerate(("key", "node", "root"))}) for at in range(0, len(edges), 9)]
        out = [r for b in parts._joined(iter(batches)) for r in b.to_pylist()]
        whole = {(r["key"], r["node"], r["root"]) for r in out if r["whole"]}
        open_keys = {r["key"] for r in out if not r["whole"]}
        assert whole == {w for w in want if w[0] not in open_keys} and not open_keys & {w[0] for w in whole}
        late = parts._forest(*(np.array([r[c] for r in out if not r["whole"]], np.int64) for c in ("key", "node", "root")))
        assert set(zip(*map(list, late), strict=True)) == {w for w in want if w[0] in open_keys}


def test_labels_within_groups(spark, monkeypatch):
    # a group's labels settle in one task; groups that are too large for it come as edges
    from haploom.operators import graphs

    rng = random.Random(8)
    rows = [(k, rng.randrange(9 * k), rng.randrange(9 * k), rng.choice([1e-6, 2e-6, 0.5])) for k in range(1, 9) for _ in range(16 * k)]
    rows += [(20, n, n + 1, 100.0 - n) for n in range(1, 20)] + [(21, 5, 6, 1.0), (22, 1, 2, 1.0), (22, 3, 2, 1.0), (22, 3, 4, 1.0), (22, 1, 4, 1.0), (23, 4, 4, 1.0), (None, 1, 2, 1.0)]
    e = spark.createDataFrame(rows, "unitig long, a long, b long, w double")
    want = set()
    for k in {r[0] for r in rows} - {None, 23}:
        one = e.where(f"unitig = {k}").selectExpr("a AS src", "b AS dst", "w")
        want |= {(k, r.node, r.label) for r in graphs.label_propagation(one).collect()}
    done, rest = graphs.label_propagation_within(e, "unitig")
    got = done.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and rest.isEmpty()
    monkeypatch.setattr(graphs, "_LARGE", 60)
    monkeypatch.setattr(graphs, "_TOGETHER", 10)
    done, rest = graphs.label_propagation_within(e, "unitig")
    large = {r.unitig for r in rest.collect()}
    assert {4, 5, 6, 7, 8} <= large and {tuple(r) for r in done.collect()} == {w for w in want if w[0] not in large}
    assert sorted(map(tuple, rest.collect())) == sorted(r for r in rows if r[0] in large and r[1] != r[2])


def test_label_propagation_takes_no_rounds_of_shuffles(spark, monkeypatch):
    # it wrote and shuffled all edges, in both directions, in every round
    from haploom.operators import graphs
    from haploom.plans.catalog import QUERIES

    rounds = []
    cut = graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: rounds.append(1) or cut(df))
    assert QUERIES["label_propagation"](spark, "/root/testdata/sf0.001").count() and not rounds
