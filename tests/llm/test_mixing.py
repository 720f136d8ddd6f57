import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from inquest.llm import mixing


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by giving out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        total = sum(w[s] for s in rest)
        for s in rest:
            target[s] = left * w[s] / total
        above = [s for s in rest if target[s] > most * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = most * sizes[s]
            capped.add(s)
            left -= target[s]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def make(n=400):
    return [(i, None if i % 17 == 3 else f"s{i % 7 if i % 3 else 0}", " ".join(["w"] * (i * 7919 % 40))) for i in range(n)]


def test_targets_and_taken(spark):
    rows = make()
    out = mixing.mix(table(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    want, taken = filled(sizes), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    assert sum(r.target for r in {r.source: r for r in out}.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_the_order_is_that_of_exponential_keys(spark):
    rows = [(i, "a" if i % 2 else "b", "w " * (1 + i % 9)) for i in range(300)]
    flat = [r for r in mixing.mix(table(spark, rows), weights=(1.0,), quality=None).collect() if r.source == "a"]
    keys = {r.doc_id: r.k for r in table(spark, rows).withColumn("size", mixing.F.lit(1)).select("doc_id", mixing.uniform(17).alias("k")).collect()}
    assert len(set(keys.values())) == 300 and all(0 < k < 1 for k in keys.values())
    again = [r for r in mixing.mix(table(spark, rows[::-1]), weights=(1.0,)).collect() if r.source == "a"]
    assert {r.doc_id: r.taken for r in flat} == {r.doc_id: r.taken for r in again}


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "a", "w w w w") for i in range(600)] + [(1000 + i, "b", "w w w w") for i in range(600)]
    out = mixing.mix(table(spark, rows), weights=(1.0, 9.0), budget_share=0.6, quality=mixing.F.when(mixing.F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0)).collect()
    a = [r for r in out if r.source == "b" and r.target < r.source_size * 2]
    even, odd = (sum(r.copies for r in out if r.source == "a" and r.doc_id % 2 == k) for k in (0, 1))
    assert even > 2 * odd and a


def test_edges(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, "one two"), (3, None, "one two"), (4, "b", "x"), (None, "b", "x y")]
    out = mixing.mix(table(spark, rows)).collect()
    assert len(out) == 6 and all(r.taken == 0 for r in out if r.source == "a") and {r.target for r in out if r.source == "a"} == {0.0}
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0


def picked(rows, quality, words):
    """Copies of each row by sorting each source's keys: rows of (doc_id, text, source), one weight for each."""
    sizes, order = defaultdict(int), defaultdict(list)
    for k, (i, t, s) in enumerate(rows):
        sizes[s] += words(t)
        own = str(i) if i is not None else hashlib.md5(t.encode()).hexdigest() if t is not None else "null"
        u = (int(hashlib.md5(f"{own}:17".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        order[s].append((-math.log(u) / quality[k], i is not None, i, words(t), k))
    target, copies = filled(sizes), {}
    for s, keys in order.items():
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, so_far = target[s] - epochs * sizes[s], 0
        for *_, n, k in sorted(keys):
            so_far += n
            copies[k] = (epochs + (so_far - n / 2 <= rest)) if n else 0
    return copies


@pytest.mark.parametrize("weight", [None, "even", 0.01, 1e9])
def test_null_and_repeated_ids_are_taken_as_sorting_says(spark, weight):
    rng = random.Random(5)
    rows = [(None if i % 9 == 0 else i // 2, f"s{i % 4}" if i % 7 else None, " ".join(f"w{rng.randrange(9)}{i}" for _ in range(rng.randrange(12)))) for i in range(400)]
    rows += [(7, "s1", "the same row"), (7, "s1", "the same row"), (None, "s2", None), (5, "s3", ""), (6, "s3", "x " * 30_000 + "x")]
    quality = [weight if isinstance(weight, float) else rng.random() + 0.1 for _ in rows]
    kept = [max(q, 0.01) for q in quality] if weight else [0.01] * len(rows)
    docs = spark.createDataFrame([(*r, q if weight else None, k, "z", "y") for k, (r, q) in enumerate(zip(rows, quality, strict=True))], "doc_id long, source string, text string, q double, size long, __whole string, `a.b` string")
    want = picked([(i, t, s) for i, s, t in rows], kept, lambda t: len(t.split(" ")) if t else 0)
    out = mixing.mixed(docs.repartition(5), quality=mixing.F.col("q"))
    assert out.columns == docs.columns
    twins = {r: [k for k, x in enumerate(rows) if x == r] for r in set(rows)}
    got = Counter((r.doc_id, r.source, r.text) for r in out.collect())
    if weight == "even":  # keys of their own: rows are known by their number
        assert Counter(r.size for r in out.collect()) == Counter({k: n for k, n in want.items() if n})
    assert got == Counter({r: sum(want[k] for k in ks) for r, ks in twins.items() if sum(want[k] for k in ks)})


def test_string_ids_and_shares(spark):
    rows = make(200)
    docs = table(spark, rows)
    a, b = ({str(r.doc_id): (r.size, r.source_size, r.target, r.taken) for r in mixing.shares(d).collect()} for d in (docs, docs.withColumn("doc_id", mixing.F.col("doc_id").cast("string"))))
    assert a == b and mixing.shares(docs.limit(0)).count() == 0 == mixing.mixed(docs.limit(0)).count()
