import random

import numpy as np
import pyarrow as pa

from inquest.llm import near_dedup as nd
from inquest.llm.components import components


def union_find(pairs, nodes):
    p = {n: n for n in nodes}

    def f(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = f(a), f(b)
        if a != b:
            p[max(a, b)] = min(a, b)
    return {n: f(n) for n in nodes}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    h = np.arange(1, 151, dtype=np.uint64) * np.uint64(7919)
    a = rng.integers(1, 12, 150)
    b = np.maximum(1, a + rng.integers(-3, 4, 150))
    keys = [nd.mix64(h + np.uint64(t * 1000003)) for t in range(60)]
    got = np.mean([(x[0] == x[1]).mean() for x in (nd.signatures([(k, a), (k, b)]) for k in keys)])
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(got - want) < 0.02
    weighty = np.mean([(x[0] == x[1]).mean() for x in (nd.signatures([(k[:1], np.array([3])), (k[:1], np.array([4]))]) for k in keys)])
    assert abs(weighty - 0.75) < 0.03


def test_empty_bag_has_infinite_registers():
    assert np.isinf(nd.signatures([(np.zeros(0, np.uint64), np.zeros(0, int))])).all()


def test_overlap_counts_copies():
    h = np.array([5, 5, 5, 9, 9, 1], np.uint64)
    g = np.array([5, 9, 9, 9, 2], np.uint64)
    assert abs(nd.overlap(nd.bag(h).tobytes(), nd.bag(g).tobytes()) - 3 / 8) < 1e-12
    assert nd.shared_counts([nd.bag(h)], [nd.bag(g), nd.bag(h)], columns=2).tolist() == [[3.0, 6.0]]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, "  \n"), (5, "one two"), (6, "one  two"), (7, "one two three")]
    for i in range(10, 60):  # near copies of the base, of which few are near each other
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(60, 90):
        rows.append((i, " ".join(word() for _ in range(rng.randrange(4, 60)))))
    rows += [(90, "na " * 50), (91, "na " * 41), (92, "na " * 20)]
    return rows


def test_groups_as_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if texts[a].split() and texts[b].split() and nd.jaccard(texts[a], texts[b]) >= 0.8]
    want = union_find(links, ids)
    got = {r.doc_id: r.group_id for r in nd.groups(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in nd.deduplicated(docs).collect()}
    assert kept == set(want.values())


def test_strangers_in_a_bucket_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd._Buckets, "BLOCK", 8)
    test_groups_as_brute_force(spark)


def test_nulls_copies_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, [(r.doc_id, r.group_id, r.kept) for r in nd.membership(docs).collect()]))
    assert got == sorted(map(str, [(None, None, None), (2, 1, False), (2, 1, False), (1, 1, True)]))
    assert nd.membership(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in nd.deduplicated(docs).collect()) == ["1", "None"]


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(3)
    mixed = list(range(200))
    rng.shuffle(mixed)
    for edges in ([(i, i + 1) for i in range(60)], list(zip(mixed, mixed[1:], strict=False)), [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(5, i) for i in range(6, 90)] + [(1, 1)]):
        want = union_find(edges, {x for e in edges for x in e if e[0] != e[1]} | {x for e in edges for x in e})
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: want[n] for n in {x for e in edges for x in e if e[0] != e[1]}}


def test_ties_between_very_long_documents():
    all_ = np.arange(100_000, dtype=np.uint64)
    for n in range(4_500, 20_000, 311):  # 5 n and 4 n shingles are at exactly 0.8, one less below it
        for short, links in ((4 * n, 1), (4 * n - 1, 0)):
            block = pa.table({"role": [0, 1], "id": [1, 2], "c": [1, 2], "bag": [all_[: 5 * n].tobytes(), all_[:short].tobytes()]})
            assert nd._blocks(0.8)(block).num_rows == links


def test_texts_that_share_an_id_keep_their_own_groups(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    a, b, c, long = (" ".join(word() for _ in range(n)) for n in (60, 60, 60, 60_000))
    near = c.rsplit(" ", 1)[0] + " other"
    rows = [("k2", a), ("k2", b), ("k3", b), ("k5", c), ("k4", near), ("k6", c), ("k9", long), ("k8", long + " end"), ("k7", None), ("k7", ""), (None, a), ("k2", a)]
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id string, text string, id int, group_id string")
    got = sorted(map(str, ((r.doc_id, r.group_id) for r in nd.groups(docs).collect())))
    want = {a: "k2", b: "k2", c: "k4", near: "k4", long: "k8", long + " end": "k8", None: "k7", "": "k7"}
    assert got == sorted(map(str, ((i, want[t] if i else None) for i, t in rows)))
    stay = [(i, t) for i, t in rows if i is None or want[t] == i]
    out = nd.deduplicated(docs)
    assert out.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, stay))
    assert {t for _, t in rows if t} - {c, long} == {r.text for r in out.collect() if r.text}
