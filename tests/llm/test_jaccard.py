import numpy as np
import pytest

from impactrec.llm import jaccard
from impactrec.llm.components import components


def plain(texts, percent=85, n=4):
    """Smallest index reachable by links, over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [len(s) for s in sets], root


def family(seed):
    """Edited copies of a few texts, so that many pairs lie around the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(4):
        base = [f"w{k}" for k in rng.integers(0, 400, rng.integers(3, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(len(copy))] = f"v{rng.integers(0, 50)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("limits", [{}, {"block_grams": 300, "sharers": 2}])
def test_components_match_all_pairs(spark, limits):
    texts = [t for seed in range(3) for t in family(seed)] + [None, "", "a", "a", "a b", " A  B "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = jaccard.near_duplicates(docs, **limits).orderBy("doc_id").collect()
    sizes, roots = plain(texts)
    assert [r["n_shingles"] for r in rows] == sizes
    assert [r["component_id"] for r in rows] == roots


def test_few_known_counts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "COUNTED_GRAMS", 100)
    texts = family(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.near_duplicates(docs).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == plain(texts)[1]


def test_odd_rows(spark, odd):
    rows = jaccard.near_duplicates(spark.read.parquet(f"{odd}/documents.parquet")).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by_id[0] == {(0, 0)} and by_id[2] == {(0, 2)}
    assert by_id[7] == {(117, 6)} and by_id[9] == {(117, 6)} and (117, 6) in by_id[8] | by_id[6]
    # Without an id: the row "one two" links with nothing, the other one is a copy of row 8.
    assert {c for _, c in by_id[None]} == {None, 6}


@pytest.mark.parametrize("seed", range(4))
def test_connected_components(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    links = [(int(a), int(b)) for a, b in rng.integers(0, n, (200, 2))] + [(i, i + 1) for i in range(0, 60)]
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["root"], set()).add(root[r["node"]])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({next(iter(g)) for g in groups.values()})
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"] for r in out} == touched


@pytest.mark.parametrize("seed", range(30))
def test_tree_walk_matches_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(1 << 60, rng.integers(1, 40), replace=False).astype(np.uint64)
    sets = {}
    for _ in range(25):
        s = base[rng.random(len(base)) < rng.choice([0.5, 0.9, 0.97, 1])]
        s = np.unique(np.concatenate([s, rng.choice(50, rng.integers(0, 4)).astype(np.uint64)]))
        if len(s):
            sets[s.tobytes()] = s
    sets = list(sets.values())
    whole, local = np.unique(np.concatenate(sets), return_inverse=True)
    order = rng.permutation(len(whole))
    ranked = [np.sort(x) for x in np.split(order[local], np.cumsum([len(s) for s in sets])[:-1])]
    tree = jaccard.PrefixTree(ranked, len(whole))
    for p in ranked:
        wanted = {j for j, q in enumerate(ranked) if 100 * len(np.intersect1d(p, q)) >= 85 * len(np.union1d(p, q))}
        assert set(tree.walk([p], 85)[1].tolist()) == wanted


def test_probes_go_down_together(monkeypatch):
    """A family of near copies and many small sets: the same components however many probes share a walk."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.04, rng.integers(0, 2**62, 60).astype(np.uint64), base)) for _ in range(120)]
    pool = rng.integers(0, 2**62, 40).astype(np.uint64)
    sets += [np.unique(rng.choice(pool, rng.integers(3, 9))) for _ in range(300)]
    sets = list({s.tobytes(): s for s in sets}.values())

    def groups(links):
        parent = list(range(len(sets)))
        for a, b in links:
            a, b = jaccard._find(parent, a), jaccard._find(parent, b)
            parent[max(a, b)] = min(a, b)
        return [jaccard._find(parent, i) for i in range(len(sets))]

    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if 185 * len(np.intersect1d(a, sets[j])) >= 85 * (len(a) + len(sets[j]))]
    for cells in (1, 1 << 25):
        monkeypatch.setattr(jaccard, "_HELD", cells)
        links = jaccard.linked_sets(sets, 85)
        assert {tuple(sorted(x, reverse=True)) for x in links} <= set(pairs)
        assert groups(links) == groups(pairs)
