import hashlib
import random

import pytest

from inquest.llm import line_dedup as ld


def brute(rows, least=10):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(x))
    held = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= least:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()], key=str)


ROWS = [
    (1, "The shared line here\nown line one\n"), (2, "  THE SHARED LINE HERE\t\nÉtoile du matin x\nshort"), (3, "étoile du matin x\nthe shared line here"), (4, None), (5, ""),
    (6, "short\nshort"), (7, "twice in one doc\ntwice in one doc"), (None, "the shared line here\nx"), (3, "étoile du matin x\nthe shared line here"), (9, "\n\n"),
]


def test_as_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert rows_of(ld.digests(docs)) == brute(ROWS)
    assert ld.digests(docs.limit(0)).count() == 0


def test_without_broadcast_the_result_is_the_same(spark):
    rng = random.Random(1)
    pool = [f"common line number {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {j}" for j in range(8))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near, far = ld.dedup_lines(docs), ld.dedup_lines(docs, broadcast_bytes=0)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    assert rows_of(ld.digests(docs)) == brute(rows)


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_texts_that_share_a_doc_id_and_very_long_and_frequent_lines(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(ld, "TASK_LINES", 7)
    rows = [("b", "only once, far down\nthe shared line here\nx"), ("b", "the shared line here\nonly once, far down here"), ("a", "THE SHARED LINE HERE \ncompletely own line"), ("b", "the shared line here\nonly once, far down here")]
    rows += [(f"c{i}", f"the shared line here\nown line of {i}") for i in range(60)] + [(None, "the shared line here"), ("d", None), ("e", "")]
    rows += [("f", "y" * 300_000 + "\n" + "\n".join(f"line {i} of many" for i in range(9_000))), ("g", "y" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    out = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in ld.dedup_lines(docs, broadcast_bytes=broadcast_bytes).collect()]
    assert sorted(out, key=str) == brute(rows)


def test_edits_with_repeated_rows(spark):
    a = spark.createDataFrame([(3, "a line of some length"), (3, "a line of some length")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "a line of some length")], "doc_id long, text string")
    more = ld.LineIndex.build(a, shards=1).insert(b)
    assert [(r.n_docs, r.first_doc) for r in more.shared.collect()] == [(2, 3)]
    assert {(r.doc_id, r.n_dropped) for r in ld.dedup_lines(a.union(b), index=more).collect()} == {(3, 0), (5, 1)}
    assert more.delete(b).shared.count() == 0


def test_edits_are_reversible(spark):
    a = spark.createDataFrame([(1, "a line of some length\nsecond long line"), (2, "a line of some length")], "doc_id long, text string")
    b = spark.createDataFrame([(0, "second long line\nthird long line"), (3, "a line of some length")], "doc_id long, text string")
    index = ld.LineIndex.build(a, shards=2)
    more = index.insert(b)
    assert {(r.n_docs, r.first_doc) for r in more.shared.collect()} == {(3, 1), (2, 0)}
    back = more.delete(b)
    assert sorted(map(str, back.postings.collect())) == sorted(map(str, index.postings.collect()))
    assert sorted(map(str, back.shared.collect())) == sorted(map(str, index.shared.collect()))
    both = a.union(b)
    assert sorted(map(str, ld.dedup_lines(both, index=more).collect())) == sorted(map(str, ld.dedup_lines(both).collect()))
    assert sorted(map(str, ld.dedup_lines(a, index=back).collect())) == sorted(map(str, ld.dedup_lines(a).collect()))


def test_cuckoo_filter_holds_all_keys_and_forgets_deleted_ones():
    import numpy as np

    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 20_000))
    f = ld.CuckooFilter.holding(h1, h2)
    assert f.contains(h1, h2).all()
    other = rng.integers(-(2**62), 2**62, (2, 20_000))
    assert f.contains(*other).mean() < 0.01
    f.delete(h1[:10_000], h2[:10_000])
    assert f.contains(h1[10_000:], h2[10_000:]).all() and f.contains(h1[:10_000], h2[:10_000]).mean() < 0.01
    with pytest.raises(ValueError):
        ld.CuckooFilter.parse(b"abc")


def test_other_columns_with_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a shared long line", 5, 6), (2, "a shared long line\nb", 7, 8)], "doc_id long, text string, n_lines int, __dropped int")
    out = {r.doc_id: r for r in ld.dedup_lines(docs).collect()}
    assert (out[2]["n_lines"], out[2]["__dropped"], out[2].text, out[2]["_n_lines"]) == (7, 8, "b", 2)
