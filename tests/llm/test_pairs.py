"""Cover trees and SimHash against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tracewell.llm import covertree, overlap, shared, simhash
from tracewell.llm.shared import components


def least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_a_path_a_star_and_a_ring(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_EDGES", few)
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 400)] + [(900 + k, 900 + (k + 1) % 9) for k in range(9)] + [(1, 1), (2, 1)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == least_reachable({x for e in edges for x in e}, edges)


@pytest.mark.parametrize("few", [-1, 200_000])
def test_components_of_no_edges(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_EDGES", few)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(30):
            centre = rng.normal(size=8)
            for scale in [0, 0, 0.03, 0.05, 0.08, 0.1][: rng.integers(1, 7)]:
                rows.append((i, [float(x) for x in (centre + rng.normal(size=8) * scale)], label))
                i += 1
    return rows


@pytest.mark.parametrize("block", [10_000, 16])
def test_cover_tree_finds_exactly_the_pairs(spark, block):
    rows = vectors(3)
    odd = [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, rows[0][1], None), (1004, [], 1), (1005, [1.0, None, *[0.0] * 6], 1), (1006, [float("inf")] + [0.0] * 7, 1), (None, rows[0][1], 0), (1007, rows[0][1][:4], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: r for r in covertree.near_duplicates(df, block=block).collect()}
    x = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    label = {i: l for i, _, l in rows}
    linked = [(a, b) for a in x for b in x if a < b and label[a] == label[b] and x[a] @ x[b] / np.sqrt(x[a] @ x[a]) / np.sqrt(x[b] @ x[b]) >= 0.98]
    assert len(linked) > 50
    want = least_reachable(x, linked)
    for i in x:
        assert found[i]["n_links"] == sum(i in e for e in linked)
        assert found[i]["component_id"] == want[i]
        assert found[i]["kept"] == (want[i] == i)
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert found[None]["n_links"] == 0 and len(found) == len(rows) + len(odd)


def test_an_id_with_several_vectors_counts_for_each(spark):
    rows = [(1, [1.0, 0.0], "A"), (2, [0.999, 0.01], "A"), (1, [0.0, 1.0], "B"), (3, [0.01, 0.999], "B"), (9, [0.02, 0.998], "B"), (4, [1.0, 1.0], "A")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 0, 4), (9, 2, 1)]


@pytest.mark.parametrize("n", [600, 2400])
def test_copies_of_clustered_vectors_do_not_grow_with_the_label(spark, n):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(n // 10, 16))
    x = np.repeat(centres, 10, axis=0) + rng.normal(size=(n, 16)) * 0.1
    rows = [(k, v.astype(np.float64).tobytes(), f"{k:064x}") for k, v in enumerate(x)]
    one = spark.createDataFrame(rows, "id long, v binary, digest string").selectExpr("'a' as label", "16 as dim", "*", "id as node", "1L as copies")
    placed = covertree.cells(one, 0.98, 64).select("cell", "home", "id").collect()
    assert sorted(r["id"] for r in placed if r["home"]) == list(range(n))
    assert len(placed) < 6 * n and len({r["cell"] for r in placed}) > n / 200
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    there = {}
    for r in placed:
        there.setdefault(r["cell"], set()).add(r["id"])
    homes = {r["id"]: r["cell"] for r in placed if r["home"]}
    for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98)):
        assert int(j) in there[homes[int(i)]]


def test_cover_tree_counts_copies_and_repeated_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 7) for i in (5, 5, 6, 9)] + [(1, [2.0, -1.0], 7)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (5, 3, 5), (5, 3, 5), (6, 3, 5), (9, 3, 5)]
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_the_tree_nests_and_covers():
    x = np.random.default_rng(1).normal(size=(500, 6))
    x /= np.sqrt((x * x).sum(1))[:, None]
    tree, todo = covertree.CoverTree(x), []
    todo.append(tree.root)
    while todo:
        n = todo.pop()
        d = covertree._distance(x[[n.centre]], x[n.points])
        assert d.max() <= n.radius + 1e-9
        if n.children:
            assert n.children[0].centre == n.centre
            assert sorted(p for c in n.children for p in c.points) == sorted(n.points)
            todo += n.children


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, " \t\n", "A", "a  B", "Ä b\x0bc", " x y z", "word " * 700, "the cat sat on the mat " * 60, "The Cat\nsat on the mat " * 60, "x" * 100_000]


def test_fingerprints_equal_those_by_hand():
    got = simhash.fingerprints([(t or "").encode() for t in TEXTS])
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in TEXTS]


def test_bit_counts_beyond_a_block():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    first = np.array([0, 0, 1, 256, 256, 2999, 3000])
    got = simhash.bit_counts(h, first)
    for d in range(len(first) - 1):
        own = h[first[d] : first[d + 1]]
        assert got[d].tolist() == [int(((own >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def near_values(seed, n=400):
    rng, out = random.Random(seed), []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(set(out))


def test_bk_tree_finds_all_within_the_radius():
    values = near_values(1)
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for x in values[:60]:
        assert sorted(tree.value[k] for k in tree.within(x, 3)) == [v for v in values if (v ^ x).bit_count() <= 3]


@pytest.mark.parametrize("full", [2048, 3])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL", full)  # with 3, shards are cut again and again
    base = random.Random(9).getrandbits(64)
    values = near_values(2) + [base ^ (1 << a) ^ (1 << b) for a in range(0, 30, 3) for b in range(40, 60, 4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(values)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    place = {v: k for k, v in enumerate(signed)}
    got = [(place[r["u"]], place[r["v"]]) for r in simhash.links(df).collect()]
    every = [(a, b) for a in range(len(signed)) for b in range(a) if ((signed[a] ^ signed[b]) & (1 << 64) - 1).bit_count() <= 3]
    assert set(map(frozenset, got)) <= set(map(frozenset, every))
    assert least_reachable(range(len(signed)), got) == least_reachable(range(len(signed)), every)


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_a_shard_is_cut_on_until_its_parts_are_small(most):
    rng = random.Random(most)
    base = rng.getrandbits(64)
    values = sorted({base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(300)})
    x = np.array([v for v in values if v & 0xFFFF == base & 0xFFFF], np.uint64)
    found = list(simhash.parts(x, (0, 0), most))
    assert all(len(p) <= most or most < 4 for p in found)
    shared = {frozenset(e) for p in found for e in ((a, b) for a in p.tolist() for b in p.tolist() if a < b)}
    assert all(frozenset((a, b)) in shared for a in x.tolist() for b in x.tolist() if a < b and (a ^ b).bit_count() <= 3)


def test_a_null_id_links_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, *_: docs.selectExpr("doc_id", "fp0 as fp"))
    rows = [(1, 0), (None, 7), (2, 63), (None, -1)]
    df = spark.createDataFrame(rows, "doc_id long, fp0 long")
    assert sorted(((r["fp"], r["component_id"]) for r in simhash.groups(df).collect())) == [(-1, None), (0, 1), (7, 1), (63, 1)]


def test_groups_and_the_one_that_stays(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(3, long), (2, long), (2, long), (9, long.replace("w7 ", "v7 ")), (4, None), (5, ""), (6, "alone in here"), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as `a.b`", "'x' as fp")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect()), key=str)
    want = {3: 2, 2: 2, 9: 2, 4: 4, 5: 4, 6: 6, None: 2}
    assert got == sorted(((i, want[i]) for i, _ in rows), key=str)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 4, 6, None], key=str)
    assert simhash.groups(df.limit(0)).count() == 0


def test_all_pairs_of_similar_shingle_sets_link(spark):
    rng, texts = random.Random(5), []
    for _ in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 9, 40, 120]))]
        for changes in [0, 0, 1, 1, 2, 3, 4, 6][: rng.randint(1, 8)]:
            own = list(words)
            for _ in range(changes):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(own).upper() if changes == 2 else " ".join(own))
    base = [f"b{k}" for k in range(200)]
    texts += [" ".join([*base[:k], "odd", *base[k:], *(["end"] * (k % 3))]) for k in range(0, 200, 5)] + [None, "", " "]
    texts += [f"this line stands in very many texts of the table {' '.join(f'y{rng.randrange(9999)}' for _ in range(8))}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    s, fp = [shingles(t) for t in texts], [brute_fingerprint(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    near = [(a, b) for a, b in pairs if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8]
    close = [(a, b) for a, b in pairs if (fp[a] ^ fp[b]).bit_count() <= 3]
    want = least_reachable(range(len(texts)), near + close)
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df, width=5, threshold=0.8).collect()}
    assert got == want and want != least_reachable(range(len(texts)), close)
    assert sorted(r["doc_id"] for r in simhash.keep_first(df, width=5).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("least", [0, 2])
def test_a_family_of_near_copies_links_by_few_pairs(spark, monkeypatch, least):
    rng, made = random.Random(7), []
    base, texts = [f"b{k}" for k in range(150)], []
    for k in range(500):
        own = list(base)
        for _ in range(max(least, k % 6)):  # with least > 0, there is no text that is near to most others
            own[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def counted(frame, small=False):
        out = shared.cut(frame, small)
        if out.columns == ["a", "b", "u", "v"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(overlap, "cut", counted)
    monkeypatch.setattr(overlap, "MANY", 2, raising=False)  # all rounds
    prints = shared.cut(simhash.with_fingerprint(df, width=5))
    none = spark.createDataFrame([], "u long, v long")
    found = {r["node"]: r["component"] for r in components(overlap.links(df, prints, none, 5, 0.8)).collect()}
    home = {r["doc_id"]: r["fp"] for r in prints.collect()}
    s = [{tuple(w[k : k + 5]) for k in range(146)} for w in map(str.split, texts)]
    near = [(a, b) for b in range(500) for a in range(b) if len(s[a] & s[b]) >= 0.8 / 1.8 * (len(s[a]) + len(s[b])) - 1e-9]
    want = least_reachable(set(home.values()), [(home[a], home[b]) for a, b in near])
    assert {i: found.get(i, i) for i in want} == want
    assert least or sum(made) <= 10 * len(texts)
