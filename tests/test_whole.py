"""Registered queries on tables of their own, against answers worked out in Python and not from the twin."""

from inquest.operators.backends import NAMES, key_of, words_weight
from inquest.plans import catalogue


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def texts(spark, folder, rows):
    table(spark, folder, "documents", [(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars int")


def test_key_join_takes_all_documents_and_all_parts(spark, tmp_path):
    rows = [(i, "a" * (1 + 17 * i)) for i in range(40)] + [(99, None)]
    texts(spark, tmp_path, rows)
    table(spark, tmp_path, "part", [(k,) for k in range(1, 501)], "p_partkey long")
    parts = {"amber": [k for k in range(1, 501) if k % 3 == 0], "dune": [k for k in range(1, 501) if k % 3 == 1]}
    colour = {i: NAMES[(words_weight(t) + key_of("name its colour")) % 5] for i, t in rows if t is not None}
    want = {(i, c, len(parts[c]), parts[c][0], parts[c][-1]) for i, c in colour.items() if c in parts}
    assert any(i >= 18 for i, *_ in want)  # documents of 300 characters and more
    got = catalogue.QUERIES["ai_key_join"](spark, str(tmp_path)).select("doc_id", "colour", "parts", "first_part", "last_part").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_prompt_expression_asks_about_the_whole_text(spark, tmp_path):
    rows = [(i, " " + "Q" * (30 + i) + "abcdefg"[i % 7] + " ") for i in range(60)] + [(99, None)]
    texts(spark, tmp_path, rows)
    k = key_of("is it shouted {0}")
    want = {i for i, t in rows if t is not None and (words_weight(t.strip(" ").lower()) + k) % (k + 2) == 0}
    assert 0 < len(want) < 60
    assert {r.doc_id for r in catalogue.QUERIES["ai_prompt_expression"](spark, str(tmp_path)).collect()} == want


def test_extract_null_reads_the_whole_text(spark, tmp_path):
    rows = [(i, " ".join(["longish"] * (1 + i % 4)) + "x" * (i // 4)) for i in range(40)] + [(98, ""), (99, None)]
    texts(spark, tmp_path, rows)
    k = key_of("what is it about")
    want = {i for i, t in rows if not t or (words_weight(t) + k) % 3 >= len(t.split(" "))}
    assert {98, 99} < want and len(want) < 40
    assert {r.doc_id for r in catalogue.QUERIES["ai_extract_null"](spark, str(tmp_path)).collect()} == want


def test_null_order_places_all_documents(spark, tmp_path):
    texts(spark, tmp_path, [(i, "a") for i in range(200)])
    toxic = {i: i % 2 for i in range(0, 200, 3)}
    table(spark, tmp_path, "labels", list(toxic.items()), "doc_id long, toxic int")
    order = sorted(range(200), key=lambda i: (-toxic.get(i, 2), i))  # no label comes before 1 and 0
    got = {r.doc_id: r.place for r in catalogue.QUERIES["null_order"](spark, str(tmp_path)).collect()}
    assert got == {i: n for n, i in enumerate(order, 1)}
