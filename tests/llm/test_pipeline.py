import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from inquest.llm import bpe, langid, near_dedup
from tests.llm.test_mixing import picked
from tests.llm.test_near import union_find

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_is_its_stages_and_each_stage_keeps_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, SF)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, given = given, spark.read.parquet(str(tmp_path / name))
        if name == "near_dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            kept = {r.doc_id for r in given.collect()}
            ids = sorted(kept)
            for i, a in enumerate(ids):
                for b in ids[i + 1 : i + 40]:
                    assert near_dedup.jaccard(texts[a], texts[b]) < 0.8
            assert kept <= set(texts)
    last = {(r.doc_id, r.ids_sha256) for r in given.collect()}
    assert last == {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert bpe.digests(before).count() == given.count()


def odd_rows():
    long = "que eau oi " * 3000
    return [
        (1, None, None, None, 0), (2, "", "en", "a", 0), (None, "the ing tion thing", "en", None, 3), (3, "the ing tion thing", "en", "a", 3), (3, "the ing tion thing", "en", "a", 3),
        (3, "another text of the same id altogether", "en", "a", 3), (4, long, "fr", "b", 9), (5, long + "fin", "fr", "b", 9), (None, "123 456", None, "b", 1), (6, " \n\t", "fr", None, 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_rows_as_brute_force(spark, tmp_path, kind):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert seen(corpus_pipeline.run(spark, str(tmp_path))) == brute(spark, docs)


def test_no_rows_go_through(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_corpus_as_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = {"aa": ["the", "thing", "action", "her", "inging"], "bb": ["que", "eau", "moi", "element", "quoi"]}
    shared = ["A line that many documents hold.", "another line of that kind "]
    rows = []
    for i in range(160):
        lang = "aa" if i % 3 else "bb"
        made = [" ".join(rng.choice(words[lang]) + rng.choice("aeiou") * rng.randrange(3) for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 4))]
        rows.append((i, "\n".join(made + rng.sample(shared, rng.randrange(3))), lang if i % 7 else None, f"s{i % 4}" if i % 9 else None, i))
    for i in range(160, 200):
        old = rows[rng.randrange(60)][1].replace("\n", " ")
        rows.append((i, old if i % 2 else old + " tail", "aa", "s9", i))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert seen(corpus_pipeline.run(spark, str(tmp_path))) == brute(spark, docs)


def seen(df):
    return Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def brute(spark, docs):
    """What run() gives, with Python's loops over all rows; the language model is tested by itself."""
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = langid.fit(docs, ~langid.held_out())
    said = {t: model.predict(t) for _, t, _ in rows}
    rows = [r for r in rows if said[r[1]][0] != "und" and said[r[1]][1] >= corpus_pipeline.SURE]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, _ in rows:
        for line in t.split("\n") if i is not None else ():
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    goes = lambda i, x: i is not None and len(held.get(key(x), ())) > 1 and min(held[key(x)]) != i
    rows = [(i, "\n".join(x for x in t.split("\n") if not goes(i, x)), s) for i, t, s in rows]
    rows = [r for r in rows if re.search(r"[^\x20\x09-\x0D]", r[1])]
    texts = sorted({t for i, t, _ in rows if i is not None})
    links = [(a, b) for k, a in enumerate(texts) for b in texts[k + 1 :] if near_dedup.jaccard(a, b) >= 0.8]
    group = union_find(links, texts)
    least = {g: min(i for i, t, _ in rows if i is not None and group[t] == g) for g in group.values()}
    rows = [(i, t, s) for i, t, s in rows if i is None or least[group[t]] == i]
    mean = lambda t: len(t) / len(re.findall(r"[^\x20\x09-\x0D]+", t))
    copies = picked(rows, [max(0.25, math.exp(-abs(mean(t) - 6) / 4)) for _, t, _ in rows], lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for k, (i, t, _) in enumerate(rows):
        ids = codec.encode(t, add_special_tokens=False).ids
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), codec.decode(ids, skip_special_tokens=False).encode())]
        out[i, len(ids), *digests] += copies[k]
    return Counter({k: n for k, n in out.items() if n})
