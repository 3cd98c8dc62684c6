import random

import numpy as np
import pytest
import xxhash

from regidx.llm.components import components
from regidx.llm.embedding_dedup import learn_forest, meet, near_vectors, planted, units_of
from regidx.llm.simhash import anchors, fingerprint, keep_one, near_duplicates


def roots(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    expected = roots(500, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: expected[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_anchors_meet_within_distance():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 400)
    other = base.copy()
    for i in range(len(other)):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            other[i] ^= np.int64(np.uint64(1) << np.uint64(bit))
    sides = []
    for prints in (base, other):
        row, block, anchor = anchors(prints, 5)
        sides.append({(r, b, a) for r, b, a in zip(row.tolist(), block.tolist(), anchor.tolist())})
    met = {r for r, _, _ in sides[0] & sides[1]}
    assert met == set(range(len(base)))


def test_simhash_equals_brute_force(spark, docs_of):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "Straße", "中 文"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(30)]
    texts = [None, "", " \t\n", "one", "ONE", "a b c", "a\x0bb\x0cc d", "a\xa0b c d e"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            changed[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append("  ".join(changed).upper() if rng.random() < 0.3 else "\n".join(changed))
    texts += [texts[10]] * 20 + ["lang " * 40_000]
    prints = [slow_fingerprint(t) for t in texts]
    assert [fingerprint(t) & (2**64 - 1) for t in texts] == prints
    expected = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    df = docs_of(texts).withColumnRenamed("lang", "print").withColumnRenamed("source", "COMPONENT_ID")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df.repartition(3)).collect()}
    assert found == {i: (f"{p:016x}", expected[i]) for i, p in enumerate(prints)}
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))
    assert near_duplicates(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(df, distance=6)


def check_vectors(spark, vectors, **options):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS name", "1 AS leaf")
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scaled = {i: np.array(vectors[i], float) / np.abs(np.array(vectors[i], float)).max() for i in good}
    units = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    links = [(i, j) for i in good for j in good if j < i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    expected = roots(len(vectors), links)
    degree = [0] * len(vectors)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = near_vectors(df.repartition(3), **options).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert len(found) == len(vectors)
    return got, {i: (degree[i], expected[i], expected[i] == i) for i in range(len(vectors))}, sum(degree)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vectors = [*base, *(base[:30] + rng.normal(size=(30, 16)) * 0.2), *(base[:5] * 3), *([base[0]] * 12), *(base[:2] * 2.0**600), *(base[:2] * 2.0**-600),
               None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [2.0, 0.0]]
    got, expected, _ = check_vectors(spark, [None if v is None else list(v) for v in vectors], leaf=1000)
    assert got == expected


def test_forest_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 32))
    near = base[:300] + rng.normal(size=(300, 32)) * 0.4
    got, expected, total = check_vectors(spark, [list(v) for v in [*base, *near]], leaf=40)
    assert sum(n for n, _, _ in got.values()) >= 0.9 * total
    assert all(got[i][0] <= expected[i][0] for i in got)


def test_one_row_of_each_component_stays(spark):
    words = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcd"]
    rows = [(1, words[0]), (1, words[0]), (2, words[0]), (2, words[1]), (None, words[1]), (None, words[2]), (None, words[2]), (3, words[3]), (3, words[0])]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == [(words[0], 1), (words[1], 2), (words[2], None), (words[3], 3)]


@pytest.mark.parametrize("common", [0.0, 0.8])
def test_forest_is_grown_to_its_depth(common):
    rng = np.random.default_rng(6)
    spread = rng.normal(size=(24_000, 64)) / 8
    ray = np.zeros(64)
    ray[0] = 1
    units = units_of(np.sqrt(common) * ray + np.sqrt(1 - common) * spread)
    forest = learn_forest(units[:20_000], 16, 0.9)
    met = np.zeros(4_000, bool)
    one, other = planted(units[20_000:], 0.905, len(met), seed=8)
    for tree, levels in enumerate(forest):
        met |= meet(one, other, levels, tree, 0.9)
        if tree == 6:
            assert met.mean() < 0.997  # what the fixed number of trees found
    assert len(forest) > 7 and met.mean() >= 0.997
