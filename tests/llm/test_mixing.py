import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from regidx.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """The excess over the caps goes to the others by weight, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                free.remove(s)
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rest int, BLOCK int, target string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " \t\n".join(["w é"] * rng.randrange(1, 40)), "hot" if i % 3 else f"s{i % 8}", 1, 2, "t") for i in range(900)]
    out += [(1000 + i, "a b c", None, None, None, None) for i in range(5)]
    out += [(2000, None, "s1", 0, 0, ""), (2001, "", "only empty", 0, 0, ""), (None, "x y", "s2", 0, 0, ""), (None, "x y", "s2", 0, 0, "")]
    out += [(3000, " ".join(["long"] * 30_000), "é", 0, 0, ""), (3001, "tiny", "\U0001f600", 0, 0, ""), (3001, "tiny", "\U0001f600", 0, 0, "")]
    return out


def test_targets_takes_and_shards(spark, rows):
    docs = frame(spark, rows)
    kept = dict(block_words=50, shard_blocks=7)
    mixed = mixing.mix(mixing.measured(docs.repartition(5)), **kept).cache()
    got = mixed.collect()
    assert mixed.columns == ["doc_id", "text", "source", "rest", "BLOCK", "size", "source_size", "target", "copies", "taken"]
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
    sizes, took, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r.size == len(WORDS(r.text or "")) and r.taken == r.size * len(r.copies) <= 3 * r.size
        sizes[r.source] += r.size
        took[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    wanted = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], abs_tol=1e-6)
    assert all(abs(took[s] - wanted[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert all(sorted(c["pass"] for c in r.copies) == list(range(len(r.copies))) for r in got)

    again = mixing.mix(mixing.measured(docs.repartition(2, "text")), **kept).select("doc_id", "text", "taken", "copies")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixed.select(*again.columns).collect()))

    dealt = mixing.shuffled(mixed).collect()
    assert len(dealt) == sum(len(r.copies) for r in got)
    places = defaultdict(list)
    for r in dealt:
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert len(places) > 20


def test_shard_quotas_are_exact(spark):
    plan = spark.createDataFrame([(p, 10, q) for p, q in enumerate([500, 0, 13, 1, 200])], "place int, blocks long, draws long")
    quotas = mixing.shard_quotas(plan, 33).collect()
    by_place, by_shard = defaultdict(list), Counter()
    for r in quotas:
        by_place[r.place] += range(r.first, r.first + r.quota)
        by_shard[r.shard] += r.quota
    assert {p: sorted(x) for p, x in by_place.items()} == {0: [*range(500)], 2: [*range(13)], 3: [0], 4: [*range(200)]}
    assert all(math.floor(714 / 33 * (s + 1)) - math.floor(714 / 33 * s) == by_shard[s] for s in range(33))
    draws = mixing.block_draws(plan, spark.createDataFrame(quotas)).collect()
    assert sum(len(r.copies) for r in draws) == 714
    assert sorted(len(r.copies) for r in draws if r.place == 2) == [1] * 7 + [2] * 3


@pytest.mark.parametrize("everyone,marked,drawn", [(20, 7, 9), (1000, 30, 400), (10, 10, 3), (10, 0, 3), (5, 2, 5), (1, 1, 0), (0, 0, 0)])
def test_hypergeometric_law(spark, everyone, marked, drawn):
    grid = 4000
    number = [F.lit(x).cast("long") for x in (everyone, marked, drawn)]
    picks = spark.range(grid).select(mixing.hypergeometric(*number, (F.col("id") + 0.5) / grid).alias("k"))
    got = Counter(r.k for r in picks.collect())
    low, high = max(0, drawn + marked - everyone), min(drawn, marked)
    for k in range(low, high + 1):
        share = math.comb(marked, k) * math.comb(everyone - marked, drawn - k) / math.comb(everyone, drawn)
        assert abs(got[k] - grid * share) <= 1.01


def test_nothing_to_mix(spark):
    assert mixing.mix(mixing.measured(frame(spark, []))).collect() == []
    blank = mixing.mix(mixing.measured(frame(spark, [(1, None, None, 1, 1, ""), (2, "", "a", 1, 1, "")]))).collect()
    assert sorted((r.doc_id, r.source_size, r.target, r.taken) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
