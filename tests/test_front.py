import pyarrow as pa
import pyarrow.dataset
import pyarrow.parquet
import pytest

from inquest.errors import CompileError, RefusalError, SimilarCallWarning
from inquest.operators.backends import ArrowBackend, ExprBackend, locate, locate_span, match_label
from inquest.plans.session import AiSession

R = {"id": ["k1", "k2", "k3", "k4", "k5"], "note": ["fine thing", "bad", "so so", None, ""], "stars": [5, 1, 3, 4, None]}
U = {"id": ["k1", "k2", "u9"], "name": ["ann", "bob", None]}


@pytest.fixture
def s(spark):
    with AiSession(spark) as session:
        session.register("r", R, "id")
        session.register("u", pa.table(U))
        yield session


def rows(session, sql, **how):
    return session.sql(sql, **how).run().to_rows()


def one(session, sql, **how):
    return list(rows(session, sql, **how)[0].values())


def weight(x):
    return ord(x[0]) + len(x) + ord(x[-1]) if x else 0


def yes(x, question):
    k = sum(map(ord, question)) % 7
    return None if x is None else (weight(x) + k) % (k + 2) == 0


def test_if_in_every_clause(s):
    q = "is {0} good"
    call = f"AI.IF(PROMPT('{q}', r.note))"
    want = [i for i, b in zip(R["id"], R["note"], strict=True) if yes(b, q)]
    assert [r["id"] for r in rows(s, f"SELECT id FROM r WHERE {call} ORDER BY id")] == want
    not_ = [i for i, b in zip(R["id"], R["note"], strict=True) if yes(b, q) is False]
    assert [r["id"] for r in rows(s, f"SELECT id FROM r WHERE NOT {call} ORDER BY 1")] == not_
    assert [r["a"] for r in rows(s, f"SELECT {call} AS a FROM r ORDER BY id")] == [yes(b, q) for b in R["note"]]
    assert one(s, f"SELECT COUNT(*) FILTER (WHERE {call}) AS n FROM r") == [len(want)]
    for name in ("AI_IF", "ai.if", "AI_FILTER"):
        assert len(rows(s, f"SELECT id FROM r WHERE {name}(PROMPT('{q}', note))")) == len(want)


def test_null_documents(s):
    assert one(s, "SELECT AI.SCORE(PROMPT('{0}', note)) AS x FROM r WHERE id = 'k4'") == [None]
    assert rows(s, "SELECT id FROM r WHERE AI.IF(PROMPT('{0} {1}', id, note)) IS NULL") == [{"id": "k4"}]
    pair = "AI.IF(PROMPT('{0} by {1}', r.note, u.name))"
    assert {x["id"] for x in rows(s, f"SELECT DISTINCT r.id FROM r, u WHERE {pair}")} <= {"k1", "k2", "k3", "k5"}
    # NOT EXISTS reads a null document as the empty text
    text = rows(s, f"SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE {pair}) ORDER BY id")
    k = sum(map(ord, "{0} by {1}")) % 7
    want = [i for i, b in zip(R["id"], R["note"], strict=True) if not any((weight(b or "") + weight(n or "") + k) % 3 == 0 for n in U["name"])]
    assert [x["id"] for x in text] == want


def test_labels_scores_maps_and_extracts(s):
    assert {r["c"] for r in rows(s, "SELECT AI.CLASSIFY(note, ['a', 'b']) AS c FROM r")} <= {"a", "b", None}
    s.register_labels("tones", [("a", "it is a"), ("b", "it is b")])
    assert rows(s, "SELECT AI.CLASSIFY(note, tones) AS c FROM r ORDER BY id") == rows(s, "SELECT AI.CLASSIFY(note, [{'label': 'a', 'description': 'it is a'}, {'label': 'b', 'description': 'it is b'}]) AS c FROM r ORDER BY id")
    p = rows(s, "SELECT id, AI.CLASSIFY(note, ['a', 'b'], {'probabilities': true}) AS c FROM r ORDER BY id")
    assert dict(p[0]["c_probabilities"])[p[0]["c"]] == 1.0 and p[3]["c_probabilities"] is None
    assert all(r["x"] is None or 0 <= r["x"] <= 1 for r in rows(s, "SELECT AI.SCORE(PROMPT('{0}', note)) AS x FROM r"))
    got = rows(s, "SELECT note, AI.EXTRACT(note, {'w': 'who'}) AS e, AI.EXTRACT_SPAN(note, {'w': 'who'}) AS p FROM r ORDER BY id")
    for r in got:
        if r["e"]["w"] is not None:
            assert r["note"][r["p"]["w"]["start"] : r["p"]["w"]["end"]] == r["e"]["w"]
        else:
            assert r["p"]["w"] is None
    assert len(rows(s, "SELECT id, UNNEST(AI.SAE_FEATURES(PROMPT('{0}', note), {'pooling': 'max'}))['strength'] AS f FROM r")) == 12


def test_dialects(s):
    assert one(s, "SELECT 5/2 AS a, 7*3/2 AS b, CONCAT('a', NULL, 'b') AS c, STRPOS('abc', 'c') AS d") == [2, 10, "ab", 3]
    assert one(s, "SELECT 'abc' RLIKE 'b' AS a, REGEXP_LIKE('abc', 'a.c') AS b") == [False, True]
    assert one(s, 'SELECT REGEXP_CONTAINS("abc", "b") AS a, "x" AS b', dialect="bq") == [True, "x"]
    assert one(s, "SELECT 'it''s' AS a, 'a\\nb' AS b") == ["it's", "a\nb"]
    assert one(s, "SELECT '{\"a\": {\"b\": [1, 2]}}' ->> 'a' ->> 'b' AS x, json_get_int('{\"a\": 5}', 'a') AS y, json_get_str('{', 'a') AS z, json_length('[1, 2]') AS n") == ["[1,2]", 5, None, 2]
    assert one(s, "SELECT array_element([4, 5], 1) AS a, array_length(ARRAY[1, 2]) AS b, {'k': 1}['k'] AS c") == [4, 2, 1]
    assert [r["stars"] for r in rows(s, "SELECT stars FROM r ORDER BY stars DESC")] == [None, 5, 4, 3, 1]
    assert [r["stars"] for r in rows(s, "SELECT stars FROM r ORDER BY stars")] == [1, 3, 4, 5, None]
    assert [r["stars"] for r in rows(s, "SELECT stars FROM r ORDER BY stars DESC NULLS LAST LIMIT 2")] == [5, 4]
    assert [r["id"] for r in rows(s, "SELECT DISTINCT ON (stars % 2) id, stars FROM r WHERE stars IS NOT NULL ORDER BY stars % 2, stars DESC")] == ["k4", "k1"]


def test_several_lists_side_by_side(s):
    got = rows(s, "SELECT UNNEST([1, 2, 3]) AS a, 'x' AS k, UNNEST([{'f': 4}, {'f': 5}])['f'] AS b ORDER BY a")
    assert [(r["a"], r["b"], r["k"]) for r in got] == [(1, 4, "x"), (2, 5, "x"), (3, None, "x")]


def test_statements(s):
    s.sql("CREATE TABLE t AS SELECT id, AI.SCORE(PROMPT('{0}', note)) AS x FROM r").collect()
    s.sql("CREATE VIEW v AS SELECT id FROM t WHERE x IS NOT NULL").collect()
    assert len(rows(s, "SELECT * FROM v")) == 4
    s.sql("DROP VIEW v").collect()
    s.sql("DROP TABLE IF EXISTS nothing").collect()
    with pytest.raises(CompileError):
        s.sql("SELECT * FROM v")
    s.sql("PREPARE p AS SELECT id FROM r WHERE stars >= $1 AND id <> $2").collect()
    assert [r["id"] for r in rows(s, "EXECUTE p(4, 'k1')")] == ["k4"]
    assert "asks AI.IF" in rows(s, "EXPLAIN SELECT id FROM r WHERE AI.IF(PROMPT('{0}', note))")[0]["plan"]
    assert rows(s, "VALUES (1)")[0] == {"col1": 1}


@pytest.mark.parametrize(
    "sql, said",
    [
        ("SELECT AI.NOPE(note) FROM r", "unknown function AI.NOPE"),
        ("SELECT nofn(id) FROM r", "unknown function nofn"),
        ("SELECT MOD(5, 2)", "a % b"),
        ("SELECT id FROM r WHERE stars", "true or false"),
        ("SELECT id FROM r WHERE AI.MAP(note, 'x')", "true or false"),
        ("SELECT id, COUNT(*) FROM r", "neither grouped"),
        ("SELECT AI.CLASSIFY(note, ['a', 'A']) FROM r", "letter case"),
        ("SELECT AI.CLASSIFY(note, ['a']) FROM r", "two labels"),
        ("SELECT AI.IF(PROMPT('{0} {2}', id, note)) FROM r", "{2}"),
        ("SELECT AI.IF(PROMPT('{0}', id, note)) FROM r", "{1}"),
        ("SELECT AI.IF(PROMPT('{0}', note), {'select': 1}) FROM r", "unknown option"),
        ("SELECT AI.IF(PROMPT('{0}', note), {'selectivity': 'x'}) FROM r", "number"),
        ("SELECT AI.IF(PROMPT('{0}', r.note), {'anchor': 'u'}) FROM r", "one table"),
        ("SELECT AI.IF(PROMPT('{0} {1}', r.note, u.name), {'anchor': 'x'}) FROM r, u", "not a table"),
        ("SELECT AI.EXTRACT(note, {'a': 'x', 'a': 'y'}) FROM r", "twice"),
        ("SELECT AI.EXTRACT(note, {'a': ' '}) FROM r", "empty"),
        ("SELECT AI.MAP(note, 'of {0}') FROM r", "{N}"),
        ("SELECT id FROM r WHERE AI.CLASSIFY(note, ['up', 'down']) = 'left'", "up, down"),
        ("SELECT id FROM r WHERE AI.CLASSIFY(note, ['up', 'down']) IN ('up', 'left')", "not a label"),
        ("SELECT AI.MAP(note, 'x', 40000) FROM r", "max_tokens"),
        ("SELECT * FROM UNNEST([1])", "refused in FROM"),
        ("SELECT AI.IF(PROMPT('is it so: {0}', note)), AI.IF(PROMPT('Is it so {0}', note)) FROM r", "write them alike"),
        ("SELECT (1", "missing"),
        ("SELECT AI.PDF_PAGES(note, 33) FROM r", "multiple of 32"),
    ],
)
def test_mistakes_are_named_before_anything_runs(s, sql, said):
    with pytest.raises(CompileError, match=None) as e:
        s.sql(sql)
    assert said in str(e.value)


def test_a_likely_slip_is_a_warning(s):
    with pytest.warns(SimilarCallWarning):
        s.sql("SELECT AI.IF(PROMPT('does it name a city {0}', note)), AI.IF(PROMPT('does it name a citi {0}', note)) FROM r")


def test_catalog(spark, tmp_path):
    table = pa.table({"a": [1, 2], "b": ["x", "y"]})
    pa.parquet.write_table(table, tmp_path / "t.parquet")
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "t.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    with AiSession(spark) as s:
        s.register_parquet("p", str(tmp_path / "t.parquet"), "a")
        s.register_csv("c", str(tmp_path / "t.csv"))
        s.register_json("j", str(tmp_path / "t.json"))
        s.register_ipc("i", str(tmp_path / "t.arrow"))
        s.register("d", pa.dataset.dataset(str(tmp_path / "t.parquet")))
        s.register("m", table.to_batches()[0])
        s.register("f", spark.range(2).selectExpr("id + 1 AS a", "'x' AS b"))
        for name in "pcjidmf":
            assert rows(s, f"SELECT SUM(a) AS n FROM {name}") == [{"n": 3}]
        for name, source, id_col in (("p", table, ""), ("x@y", table, ""), ("z", table, "nope"), ("q", object(), "")):
            with pytest.raises(CompileError):
                s.register(name, source, id_col)
        with pytest.raises(RefusalError):
            s.register_hf("h", "some/dataset")


def test_results(s):
    query = s.sql("SELECT id, stars FROM r ORDER BY id")
    assert query.collect().num_rows == 5 and query.collect(2).num_rows == 2 and query.run().count() == 5
    assert [b.num_rows for b in query.execute_stream(2)] == [2, 2, 1]
    with pytest.raises(CompileError):
        query.collect(-1)
    assert "not executed" in query.explain() and "5 rows" in query.explain(analyze=True)
    assert s.estimate_calls("SELECT AI.IF(PROMPT('{0}', note)), AI.IF(PROMPT('{0}', note)) FROM r")[0].kind == "if"


def test_model_that_does_not_answer(spark):
    with AiSession(spark, ArrowBackend(ExprBackend().ask, kinds=("if",))) as s:
        s.register("r", R)
        with pytest.raises(RefusalError):
            s.sql("SELECT AI.SCORE(PROMPT('{0}', note)) FROM r")


def test_free_text_answers():
    assert match_label("thought: hm\nANSWER: Red wine", ["red", "red wine", "blue"]) == "red wine"
    assert match_label("green", ["red"]) is None
    assert locate("The  Quick\nFox ran", "the quick fox jumped") == "The  Quick\nFox"
    assert locate("abc", "zzz") is None and locate_span("a b", "b") == (2, 3) and locate("x", None) is None
