import pyarrow as pa
import pyarrow.flight as fl
import pytest

from inquest.errors import CompileError
from inquest.operators import ask as ops
from inquest.operators.backends import ArrowBackend, ExprBackend
from inquest.operators.calls import ModelCall
from inquest.plans.registry import ExtensionRegistry
from inquest.plans.session import AiSession
from inquest.streaming.server import FlightServer, RemoteSession
from inquest.streaming.streams import ask_each_batch, ask_stream
from pyspark.sql import functions as F

ROWS = pa.table({"id": ["k1", "k2", "k3"], "note": ["fine thing", "bad", "so so"]})
SQL = "SELECT id, AI.SCORE(PROMPT('rate {0}', note)) AS x FROM r ORDER BY id"


def test_flight_server(spark, tmp_path):
    with AiSession(spark) as local:
        server = FlightServer(local, str(tmp_path), token="t")
        try:
            place = f"grpc://127.0.0.1:{server.port}"
            with pytest.raises(fl.FlightUnauthenticatedError):
                RemoteSession(place).list()
            remote = RemoteSession(place, "t")
            remote.register("r", ROWS, "id")
            with pytest.raises(fl.FlightServerError):
                remote.register("r", ROWS)
            rows = remote.sql(SQL).collect()
            assert rows.num_rows == 3
            run = remote.sql(SQL).submit(id="one")
            assert run.collect() == rows and run.report()["rows"] == 3
            assert remote.sql(SQL).submit(id="one").state["status"] == "succeeded"
            bad = remote.sql("SELECT nofn(id) FROM r").submit()
            assert bad.wait()["status"] == "failed" and "unknown function" in bad.state["error"]
            assert "asks AI.SCORE" in remote.sql(SQL).explain()
            waiting = remote.sql(SQL).submit(id="two")
            waiting.cancel()
            assert waiting.wait()["status"] in ("cancelled", "succeeded")
            assert {s["id"] for s in remote.list()} >= {"one", "two"}
            with pytest.raises(fl.FlightServerError):
                remote.get_run("none")
        finally:
            server.shutdown()
        again = FlightServer(local, str(tmp_path))
        try:
            assert RemoteSession(f"grpc://127.0.0.1:{again.port}").get_run("one").collect() == rows
        finally:
            again.shutdown()


def test_registry(spark, tmp_path, monkeypatch):
    registry, seen = ExtensionRegistry(), []
    registry.register_model("mine", lambda: ArrowBackend(ExprBackend().ask, "mine"))
    registry.register_observer(seen.append)
    with pytest.raises(CompileError):
        registry.register_model("mine", ExprBackend)
    with AiSession(spark, "mine", registry) as s:
        s.register("r", ROWS)
        s.sql(SQL).collect()
    assert seen[0]["model"] == "mine" and seen[0]["asked"] == 3
    (tmp_path / "broken_ext.py").write_text("def register(r):\n    r.register_observer(print)\n    raise RuntimeError('no')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(RuntimeError):
        registry.load_extension("broken_ext")
    assert registry.observers == [seen.append]
    with pytest.raises(CompileError):
        AiSession(spark, "nobody", registry)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, f"b{i % 3}") for i in range(12)], "id long, note string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, note string").parquet(str(tmp_path / "in"))
    call = ModelCall("score", "rate {0}")
    out = ask_stream(stream, call, ["note"], "x", ExprBackend())
    out.writeStream.format("parquet").option("path", str(tmp_path / "a")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    log, want = ops.AskLog(), {(r.id, r.x) for r in ops.ask(spark.read.parquet(str(tmp_path / "in")), call, ["note"], "x", ExprBackend()).select("id", "x").collect()}
    assert {(r.id, r.x) for r in spark.read.parquet(str(tmp_path / "a")).select("id", "x").collect()} == want
    writer = ask_each_batch(stream, call, ["note"], "x", ArrowBackend(ExprBackend().ask), lambda df, n: df.write.mode("append").parquet(str(tmp_path / "b")), log)
    writer.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.id, r.x) for r in spark.read.parquet(str(tmp_path / "b")).select("id", "x").collect()} == want and log.total == 3
    with pytest.raises(ValueError):
        ask_stream(spark.range(1).select(F.lit("a").alias("note")), call, ["note"], "x", ExprBackend())
