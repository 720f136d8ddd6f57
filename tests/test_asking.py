import random

import pytest

from inquest.operators import ask as ops
from inquest.operators.backends import ArrowBackend, ExprBackend
from inquest.operators.calls import ModelCall
from inquest.plans.asked import SHAPES, asked_of
from inquest.plans.eager import RULES
from inquest.plans.session import AiSession
from pyspark.sql import functions as F


@pytest.mark.parametrize("shape", list(SHAPES))
def test_questions_asked(spark, shape):
    few, rows = asked_of(spark, shape)
    many, same = asked_of(spark, shape, RULES)
    assert few <= SHAPES[shape][3] and few <= many
    assert rows == same or "limit" in shape and len(rows) == len(same)


R = {"id": ["k1", "k2", "k3", "k4", "k5", "k6"], "note": ["fine thing", "bad", "so so", None, "", "bad"], "stars": [5, 1, 3, 4, None, 1]}
U = {"uid": ["k1", "k2", "u9", "k2"], "name": ["ann", "bob", None, "bob"]}
CALL = "AI.IF(PROMPT('is {0} good', note))"
SCORE = "AI.SCORE(PROMPT('rate {0}', note))"
TEXTS = [
    f"SELECT id FROM r WHERE {CALL}",
    f"SELECT id FROM r WHERE NOT {CALL} AND stars > 1",
    f"SELECT id, {CALL} AS a, {SCORE} AS b FROM r WHERE {SCORE} >= 0.25 OR stars = 3",
    "SELECT AI.CLASSIFY(note, ['a', 'b']) AS c, COUNT(*) AS n FROM r GROUP BY AI.CLASSIFY(note, ['a', 'b']) HAVING COUNT(*) > 1",
    f"SELECT id, ROW_NUMBER() OVER (ORDER BY {SCORE} DESC, id) AS n FROM r",
    "SELECT t.id, AI.CLASSIFY(t.m, ['x', 'y']) AS l FROM (SELECT id, AI.MAP(note, 'name it') AS m FROM r WHERE stars IS NOT NULL) t",
    f"SELECT id FROM r WHERE {CALL} UNION SELECT uid FROM u ORDER BY id",
    "SELECT id, AI.EXTRACT(note, {'w': 'who', 'v': 'what'})['v'] AS w, AI.EXTRACT_SPAN(note, {'w': 'who'})['w']['start'] AS s FROM r",
    f"SELECT uid FROM u WHERE uid IN (SELECT id FROM r WHERE {CALL})",
    "SELECT uid FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = u.uid AND AI.IF(PROMPT('is {0} good', r.note)))",
    "SELECT r.id, u.name FROM r JOIN u ON r.id = u.uid AND AI.IF(PROMPT('{0} by {1}', r.note, u.name))",
    f"SELECT COUNT(*) FILTER (WHERE {CALL}) AS n, SUM(CASE WHEN {CALL} THEN stars END) AS m FROM r",
    f"WITH c AS (SELECT id, {SCORE} AS x FROM r) SELECT a.id FROM c a JOIN c b ON a.x = b.x AND a.id < b.id",
    f"SELECT id, CASE WHEN stars > 2 THEN {SCORE} ELSE 0.5 END AS x FROM r ORDER BY id LIMIT 3",
    "SELECT AI.MAP('a b', 'shorten') AS m",
    *(f"SELECT r.id, u.name FROM r {how} JOIN u ON r.id = u.uid AND AI.IF(PROMPT('{{0}} by {{1}}', r.note, u.name))" for how in ("LEFT", "RIGHT", "FULL OUTER")),
    "SELECT r.id FROM r LEFT SEMI JOIN u ON AI.IF(PROMPT('{0} by {1}', r.note, u.name))",
    "SELECT * FROM r, u WHERE r.stars > 1 AND AI.IF(PROMPT('{0} by {1}', note, u.name)) AND uid = id",
    "SELECT r.id FROM r WHERE EXISTS (SELECT 1 FROM u WHERE AI.IF(PROMPT('{0} by {1}', r.note, u.name)) AND u.uid <> r.id)",
    "SELECT r.id, r.stars FROM r WHERE stars > 0 AND NOT EXISTS (SELECT 1 FROM u WHERE AI.IF(PROMPT('{0} by {1}', r.note, u.name)))",
    "SELECT a.id, AI.CLASSIFY(PROMPT('{0} or {1}', a.note, b.note), ['x', 'y']) AS c FROM r a JOIN r b ON a.stars < b.stars AND AI.SCORE(PROMPT('{0} to {1}', a.note, b.note)) >= 0.25",
    "SELECT id FROM r WHERE AI.EXTRACT(note, {'w': 'who'})['w'] LIKE '%o%'",
    "SELECT uid, COUNT(*) AS n FROM u LEFT JOIN r ON r.id = u.uid AND AI.IF(PROMPT('is {0} good', r.note)) GROUP BY uid HAVING COUNT(*) >= 1",
]


@pytest.mark.parametrize("text", TEXTS)
def test_both_kinds_of_model_agree_with_rules_on_and_off(spark, text):
    found = []
    for model, without in ((ExprBackend(), ()), (ArrowBackend(ExprBackend().ask), ()), (ArrowBackend(ExprBackend().ask), RULES)):
        with AiSession(spark, model, without=without) as s:
            s.register("r", R)
            s.register("u", U)
            found.append(sorted(map(str, s.sql(text).run().to_rows())))
    assert found[0] == found[1] == found[2]


def frame(spark, table):
    return spark.createDataFrame(list(zip(*table.values(), strict=True)), ", ".join(f"{n} {'long' if n == 'stars' else 'string'}" for n in table))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("keyed", [True, False])
def test_joins_keep_copies_and_unmatched_rows(spark, how, keyed):
    left, right = frame(spark, R), frame(spark, U)
    call, log = ModelCall("if", "{0} by {1}", 2), ops.AskLog()
    on = (lambda a, b: a["id"] == b["uid"]) if keyed else None
    a, b = (ops.ai_join(left, right, call, "note", "name", m, on, how, log=log) for m in (ExprBackend(), ArrowBackend(ExprBackend().ask)))
    k = sum(map(ord, call.question)) % 7
    weigh = lambda x: ord(x[0]) + len(x) + ord(x[-1]) if x else 0
    rows_l, rows_r = list(zip(*R.values(), strict=True)), list(zip(*U.values(), strict=True))
    anti = how == "left_anti"
    true = lambda x, y: (not keyed or x[0] == y[0]) and (anti or x[1] is not None and y[1] is not None) and (weigh(x[1]) + weigh(y[1]) + k) % 3 == 0
    pairs = [(x, y) for x in rows_l for y in rows_r if true(x, y)]
    want = {"left_semi": [x for x in rows_l if any(p[0] is x for p in pairs)], "left_anti": [x for x in rows_l if not any(p[0] is x for p in pairs)]}.get(how)
    if want is None:
        want = [x + y for x, y in pairs]
        want += [x + (None, None) for x in rows_l if how in ("left", "full") and not any(p[0] is x for p in pairs)]
        want += [(None, None, None) + y for y in rows_r if how in ("right", "full") and not any(p[1] is y for p in pairs)]
    for got in (a, b):
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    docs = {(x[1] or "", y[1] or "") if anti else (x[1], y[1]) for x in rows_l for y in rows_r if (not keyed or x[0] == y[0]) and (anti or None not in (x[1], y[1]))}
    assert log.total == len(docs)


def test_fetch_stops_and_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, f"t{rng.randrange(1000)}", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, note string, k long")
    call = ModelCall("if", "is it so {0}")
    full = ops.ask(df, call, ["note"], "a", ExprBackend()).where("a").orderBy("id").collect()
    log = ops.AskLog()
    got = ops.ai_fetch(df, call, ["note"], 4, [F.col("id")], ArrowBackend(ExprBackend().ask), log=log)
    assert sorted(r.id for r in got.collect()) == [r.id for r in full[:4]] and log.total < 100
    keyed = ops.ai_fetch(df, call, ["note"], 2, [F.col("id")], ArrowBackend(ExprBackend().ask), key=["k"])
    want = [r.id for k in range(3) for r in [x for x in full if x.k == k][:2]]
    assert sorted(r.id for r in keyed.collect()) == sorted(want)
    assert ops.ai_fetch(df, call, ["note"], 0, [F.col("id")], ExprBackend()).count() == 0


def test_an_answer_is_asked_once_however_often_it_is_read(spark):
    log = ops.AskLog()
    df = spark.createDataFrame([(i, f"b{i % 3}") for i in range(30)], "id long, note string")
    out = ops.ask(df, ModelCall("classify", "tone {0}", labels=("a", "b")), ["note"], "c", ArrowBackend(ExprBackend().ask), log=log)
    assert out.count() == 30 and out.groupBy("c").count().count() <= 2 and log.total == 3


MORE = [
    ("SELECT n.id, '{x}' AS b, regexp_count(n.id, 'k{1}') AS c, AI.IF(PROMPT('is {0} good', note)) AS a FROM r n", 6),
    ("SELECT id, AI.SCORE(PROMPT('rate {0}', note)) AS s FROM r LIMIT 1 + 1", None),
    ("SELECT stars FROM r WHERE AI.IF(PROMPT('is {0} good', note)) GROUP BY stars HAVING COUNT(*) >= 0", None),
    ("SELECT stars FROM r WHERE AI.IF(PROMPT('is {0} good', note)) GROUP BY stars HAVING COUNT(*) >= 1 - 1", None),
    ("SELECT id, AI.IF(PROMPT('is {0} good', note)) AS a FROM r WHERE AI.SCORE(PROMPT('rate {0}', note)) > 0.1 LIMIT 0", 0),
    ("SELECT id FROM r WHERE AI.IF(PROMPT('is {0} good', note)) UNION SELECT uid FROM u WHERE AI.IF(PROMPT('is {0} good', name)) LIMIT 0", 0),
    ("SELECT t.id FROM (SELECT id, AI.IF(PROMPT('is {0} good', note)) AS a FROM r) t LIMIT 0", 0),
    ("SELECT * FROM r WHERE AI.IF(PROMPT('is {0} good', note)) OR stars = 3", None),
    ("SELECT r.* FROM r WHERE stars = 3 OR EXISTS (SELECT 1 FROM u WHERE AI.IF(PROMPT('{0} by {1}', r.note, u.name)) AND u.uid <> r.id)", None),
    ("SELECT r.id FROM r WHERE stars = 3 OR NOT EXISTS (SELECT 1 FROM u WHERE AI.IF(PROMPT('{0} by {1}', r.note, u.name)))", None),
    ("SELECT r.id FROM r WHERE EXISTS (SELECT 1 FROM u JOIN u v ON u.uid = v.uid WHERE AI.IF(PROMPT('{0} by {1}', r.note, v.name)) AND u.uid <> r.id)", None),
    ("SELECT r.id, u.name FROM r JOIN u ON r.id = u.uid WHERE r.stars = 5 OR EXISTS (SELECT 1 FROM u w WHERE AI.IF(PROMPT('{0} by {1}', r.note, w.name)))", None),
    ("SELECT id, CASE WHEN stars > 4 THEN 'top' WHEN AI.IF(PROMPT('is {0} good', note)) THEN AI.CLASSIFY(note, ['a', 'b']) ELSE CASE stars WHEN 1 THEN AI.MAP(note, 'name it') ELSE 'none' END END AS c FROM r", None),
    ("SELECT id, CASE WHEN stars > 2 THEN AI.SCORE(PROMPT('rate {0}', note)) END AS x, CASE WHEN stars = 1 THEN AI.SCORE(PROMPT('rate {0}', note)) END AS y FROM r ORDER BY AI.SCORE(PROMPT('rate {0}', note)), id", None),
    ("SELECT id FROM r WHERE CASE WHEN stars > 2 THEN AI.IF(PROMPT('is {0} good', note)) ELSE FALSE END", None),
    ("SELECT * FROM (SELECT DISTINCT stars AS s FROM r WHERE AI.IF(PROMPT('is {0} good', note)) OR stars = 1) t WHERE t.s > 1 AND s IN (3, 5)", None),
    ("SELECT t.id FROM (SELECT r.id, r.note AS n FROM r WHERE AI.IF(PROMPT('is {0} good', note))) t WHERE t.n LIKE 'f%' OR t.n IS NULL", None),
]


@pytest.mark.parametrize("text, most", MORE)
def test_more_shapes_agree_whatever_the_model(spark, text, most):
    found = []
    for model, without in ((ExprBackend(), ()), (ArrowBackend(ExprBackend().ask), ()), (ArrowBackend(ExprBackend().ask), RULES)):
        with AiSession(spark, model, without=without) as s:
            s.register("r", R)
            s.register("u", U)
            query = s.sql(text)
            table = query.collect()
            found.append((table.column_names, sorted(map(str, table.to_pylist()))))
            if most is not None and query.asked and not without:
                assert query.asked.total <= most
    assert found[0][0] == found[1][0] == found[2][0]
    assert "LIMIT" in text or found[0] == found[1] == found[2]
    assert len(found[0][1]) == len(found[1][1]) == len(found[2][1])


def test_tests_run_as_written_if_wanted(spark):
    def model(call, docs):
        return [len(d[0]) > 1 if call.question.startswith("cheap") else False for d in docs]

    text = "SELECT id FROM t WHERE AI.IF(PROMPT('cheap {0}', note)) AND AI.IF(PROMPT('dear {0}', note), {'selectivity': 0.01})"
    asked = []
    for order in ("as_written", "by_cost"):
        with AiSession(spark, ArrowBackend(model)) as s:
            s.register("t", {"id": [1, 2, 3], "note": ["a", "bb", "c"]})
            query = s.sql(text, order=order)
            query.collect()
            asked.append({c.question.split()[0]: n for c, n in query.asked.asked.items() if n})
    assert asked[0] == {"cheap": 3, "dear": 1} and asked[1] == {"dear": 3}


def test_take_reads_beginnings_and_goes_on_until_it_has_enough(spark):
    rows = [(i, f"b{i % 10}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, note string").repartition(3)
    model = ArrowBackend(lambda call, docs: [d[0] == "b7" for d in docs])
    for table in (df, ops.kept(df, "t")):
        for n in (1, 5, 399, 400, 1000):
            got = ops.ai_take(table, ModelCall("if", "is it so {0}"), ["note"], n, model).collect()
            assert len({r.id for r in got}) == len(got) == min(n, 400) and all(r.note == "b7" for r in got)
    assert ops.ai_take(df, ModelCall("if", "q {0}"), ["note"], 0, model).count() == 0


def test_fetch_in_order_with_ties_and_nulls(spark):
    rows = [(None if i % 5 == 0 else i % 3, f"t{i % 23}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, note string, id long").repartition(4)
    call = ModelCall("if", "is it so {0}")
    full = ops.ask(df, call, ["note"], "a", ExprBackend()).where("a")
    want = [r.id for r in full.orderBy("k", "id").limit(9).collect()]
    got = ops.ai_fetch(df, call, ["note"], 9, [F.col("k"), F.col("id")], ArrowBackend(ExprBackend().ask))
    assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == df.columns
    keyed = ops.ai_fetch(df, call, ["note"], 2, [F.col("id")], ArrowBackend(ExprBackend().ask), key=["k"])
    best = {}
    for r in full.orderBy("id").collect():
        best.setdefault(r.k, []).append(r.id)
    assert sorted(r.id for r in keyed.collect()) == sorted(x for ids in best.values() for x in ids[:2])


def test_questions_about_one_document_follow_one_another(spark):
    seen = []
    df = spark.createDataFrame([(f"a{i % 3}", f"b{i}") for i in range(30)], "x string, y string").coalesce(1)
    docs = df.select(F.xxhash64("x", "y").alias("h1"), F.xxhash64("y").alias("h2"), "x", "y")
    model = ArrowBackend(lambda call, docs: [d[0] for d in docs], kinds=("map",))
    with AiSession(spark, model) as s:
        s.register("l", {"x": ["p"]})
        s.register("r", {"y": ["q"]})
        with pytest.raises(Exception):
            s.sql("SELECT 1 FROM l, r WHERE AI.IF(PROMPT('{0} {1}', l.x, r.y), {'anchor': 'z'})")
    out = ops.answers(docs, ModelCall("map", "m", 2, anchor="0"), ArrowBackend(lambda call, docs: [f"{i}" for i, d in enumerate(docs)], batch=1000), beside=0)
    place = {r.h2: int(r.answer) for r in out.collect()}
    names = {r.h2: r.x for r in docs.collect()}
    seen = [names[h] for h in sorted(place, key=place.get)]
    assert sum(a != b for a, b in zip(seen, seen[1:], strict=False)) == 2


def test_prepared_values_stay_out_of_strings(spark):
    with AiSession(spark) as s:
        s.register("r", R)
        s.sql("PREPARE p AS SELECT id, '$1' AS t FROM r WHERE stars > $1 AND note <> $2").dataframe()
        got = s.sql("EXECUTE p(-1, 'x, (y)')").run().to_rows()
        assert {x["id"] for x in got} == {"k1", "k2", "k3", "k6"} and {x["t"] for x in got} == {"$1"}
        with pytest.raises(Exception, match=r"reads \$2"):
            s.sql("EXECUTE p(1)")


def test_streams_come_in_batches_of_any_type(spark):
    with AiSession(spark) as s:
        s.register("r", R)
        reader = s.sql("SELECT id, stars, array(stars, 1) AS a, named_struct('x', note) AS s, AI.SCORE(PROMPT('{0}', note)) AS v FROM r ORDER BY id").execute_stream(batch_rows=2)
        parts = list(reader)
        assert [p.num_rows for p in parts] == [2, 2, 2]
        rows = [x for p in parts for x in p.to_pylist()]
        assert [x["id"] for x in rows] == R["id"] and rows[0]["a"] == [5, 1] and rows[3]["s"] == {"x": None}


def test_bytes_reach_a_remote_model():
    import base64
    import http.server
    import json
    import threading

    from inquest.operators.backends import http_backend

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"answers": [base64.b64decode(d[0]["base64"]).hex() if isinstance(d[0], dict) else d[0] for d in given["documents"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = http_backend(f"http://127.0.0.1:{server.server_port}/")
        assert model.ask(ModelCall("map", "what is it"), [(b"\x00\xff",), ("text",)]) == ["00ff", "text"]
    finally:
        server.shutdown()


def test_arrow_files_and_datasets_are_read_by_executors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.dataset as pads
    import pyarrow.feather

    table = pa.table({"id": [1, 2, 3], "t": ["a", None, "c"], "n": pa.array([1, 2, None], pa.int8())})
    (tmp_path / "ipc").mkdir()
    for k in range(3):
        with pa.ipc.new_file(str(tmp_path / "ipc" / f"{k}.arrow"), table.schema) as w:
            w.write_table(table)
    (tmp_path / "feather").mkdir()
    for k in range(2):
        pyarrow.feather.write_feather(table, str(tmp_path / "feather" / f"{k}.feather"))
    with AiSession(spark) as s:
        s.register_ipc("i", str(tmp_path / "ipc"))
        s.register("f", pads.dataset(str(tmp_path / "feather"), format="feather"))
        for name, times in (("i", 3), ("f", 2)):
            got = sorted(map(str, s.sql(f"SELECT * FROM {name}").run().to_rows()))
            assert got == sorted(map(str, table.to_pylist() * times))


def test_a_cluster_without_a_shared_folder_is_refused():
    from inquest.sources import shared

    class Conf:
        get = staticmethod(lambda *a: None)

    class Empty:
        isEmpty = staticmethod(lambda: True)  # noqa: N815

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Empty)}))})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(type("Session", (), {"conf": Conf, "sparkContext": Context}))


def test_sinks_nodes_regions_and_settings(spark):
    from inquest.plans.registry import ExtensionRegistry
    from inquest.plans.session import EngineConfig

    events, stored, nodes, sizes = [], [], [], []

    class Watcher:
        after_node = staticmethod(nodes.append)
        report = staticmethod(events.append)

    registry = ExtensionRegistry()
    registry.register_progress(events.append)
    registry.register_answers(lambda call, found: stored.append((call.kind, sorted(r.answer for r in found.collect()))))
    registry.register_node("twice", lambda df: df.unionAll(df))
    registry.register_observer(Watcher())
    model = ArrowBackend(lambda call, docs: [len(docs)] and ["a" if d[0] < "d" else "b" for d in docs])
    with AiSession(spark, registry=registry, config=EngineConfig(model, batch_rows=2, parallelism=1)) as s:
        s.register("t", {"id": [1, 2, 3, 4, 5], "note": ["a", "b", "c", "d", "e"]})
        query = s.sql("SELECT id, AI.CLASSIFY(note, ['a', 'b']) AS c FROM t", nodes=["twice"])
        assert query.regions() == [{"kind": "classify", "question": "", "documents": 1, "executed": False, "asked": None}]
        assert len(query.run().to_rows()) == 10
        assert query.regions()[0] | {"executed": True, "asked": 5} == query.regions()[0]
    assert events[0]["asked"] == 5 == events[0]["total"] and events[-1]["rows"] == 10 and nodes == events[:1]
    assert stored == [("classify", ["a", "a", "a", "b", "b"])]
    with pytest.raises(Exception, match="unknown node"):
        s.sql("SELECT 1", nodes=["none"])
    with pytest.raises(Exception, match="at least 1"):
        EngineConfig(batch_rows=0)


def test_qualify_and_information_schema(spark):
    with AiSession(spark) as s:
        s.register("r", R)
        rows = s.sql("SELECT a.id FROM (SELECT id, stars FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY stars ORDER BY id) = 1) a WHERE a.stars IS NOT NULL ORDER BY a.id LIMIT 3").run().to_rows()
        assert [x["id"] for x in rows] == ["k1", "k2", "k3"]
        names = s.sql("SELECT column_name, 'information_schema.tables' AS t FROM information_schema.columns ORDER BY ordinal_position").run().to_rows()
        assert [x["column_name"] for x in names] == ["id", "note", "stars"] and names[0]["t"] == "information_schema.tables"
