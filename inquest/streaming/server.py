"""A session over Arrow Flight: upload tables, queue queries, read rows.

One query runs at a time, others wait their turn. A submission's state and rows are files in the server's data
directory, so a client may go away and a server started again on the same directory still has them; what was
queued or running when a server stopped runs again.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.flight as fl

from inquest.errors import CompileError, RefusalError
from inquest.plans.session import AiSession

_ENDED = ("succeeded", "failed", "cancelled", "timed_out")


class _TokenFactory(fl.ServerMiddlewareFactory):
    def __init__(self, token: str) -> None:
        self.token = token

    def start_call(self, info: Any, headers: dict) -> None:
        if (headers.get("authorization") or [""])[0] != f"Bearer {self.token}":
            raise fl.FlightUnauthenticatedError("a valid token is needed")


class Queue:
    """Submissions in a directory, run one after another in a thread."""

    def __init__(self, session: AiSession, directory: str) -> None:
        self.session, self.dir = session, Path(directory)
        self.dir.mkdir(parents=True, exist_ok=True)
        self.changed = threading.Condition()
        self.stopping = False
        self.states: dict[str, dict] = {}
        for file in sorted(self.dir.glob("*.json"), key=lambda p: p.stat().st_mtime):
            state = json.loads(file.read_text())
            if state["status"] not in _ENDED:
                state |= {"status": "queued"}
            self.states[state["id"]] = state
        self.thread = threading.Thread(target=self._loop, daemon=True)
        self.thread.start()

    def submit(self, sql: str, dialect: str = "snowflake", id: str | None = None, timeout_s: float | None = None) -> dict:
        with self.changed:
            if id and id in self.states:  # sending it again changes nothing
                if self.states[id]["sql"] != sql:
                    raise CompileError(f"submission '{id}' has another query")
                return self.states[id]
            state = {"id": id or uuid.uuid4().hex, "sql": sql, "dialect": dialect.lower(), "timeout_s": timeout_s, "status": "queued", "revision": 0, "submitted": time.time(), "rows": None, "error": None, "report": None}
            self.states[state["id"]] = state
            self._save(state)
            return state

    def _save(self, state: dict, **new: Any) -> None:
        state |= new | {"revision": state["revision"] + 1}
        part = self.dir / f"{state['id']}.tmp"
        part.write_text(json.dumps(state))
        part.rename(self.dir / f"{state['id']}.json")
        self.changed.notify_all()

    def status(self, id: str, after: int | None = None, wait_s: float = 0.0) -> dict:
        end = time.time() + wait_s
        with self.changed:
            while after is not None and self.get(id)["revision"] <= after and (left := end - time.time()) > 0:
                self.changed.wait(left)
            return dict(self.get(id))

    def get(self, id: str) -> dict:
        if id not in self.states:
            raise KeyError(f"there is no submission '{id}'")
        return self.states[id]

    def cancel(self, id: str) -> dict:
        with self.changed:
            state = self.get(id)
            if state["status"] not in _ENDED:
                running = state["status"] == "running"
                self._save(state, status="cancelled")
                if running:
                    self.session.spark.interruptTag(f"inquest-{id}")
            return dict(state)

    def rows(self, id: str) -> pa.Table:
        state = self.get(id)
        if state["status"] != "succeeded":
            raise KeyError(f"submission '{id}' is {state['status']}")
        with pa.memory_map(str(self.dir / f"{id}.arrow")) as f:
            return pa.ipc.open_file(f).read_all()

    def wait(self, id: str) -> dict:
        with self.changed:
            while self.get(id)["status"] not in _ENDED:
                self.changed.wait(1.0)
            return dict(self.get(id))

    def close(self) -> None:
        with self.changed:
            self.stopping = True
            self.changed.notify_all()
        self.thread.join(30)

    def _loop(self) -> None:
        while True:
            with self.changed:
                while not self.stopping and not (waiting := [s for s in self.states.values() if s["status"] == "queued"]):
                    self.changed.wait(1.0)
                if self.stopping:
                    return
                state = min(waiting, key=lambda s: s["submitted"])
                self._save(state, status="running", started=time.time())
            self._run(state)

    def _run(self, state: dict) -> None:
        spark, tag = self.session.spark, f"inquest-{state['id']}"
        timer = threading.Timer(state["timeout_s"], self._late, [state]) if state["timeout_s"] else None
        spark.addTag(tag)
        try:
            if timer:
                timer.start()
            query = self.session.sql(state["sql"], dialect=state["dialect"])
            result = query.run()
            rows = result.collect()
            part = self.dir / f"{state['id']}.part"
            with pa.OSFile(str(part), "wb") as f, pa.ipc.new_file(f, rows.schema) as w:
                w.write_table(rows)
            part.rename(self.dir / f"{state['id']}.arrow")
            new = {"status": "succeeded", "rows": rows.num_rows, "report": result.report()}
        except Exception as e:
            new = {"status": "failed", "error": f"{type(e).__name__}: {e}"[:4000]}
        finally:
            if timer:
                timer.cancel()
            spark.removeTag(tag)
        with self.changed:
            if state["status"] == "running":
                self._save(state, **new, ended=time.time())

    def _late(self, state: dict) -> None:
        with self.changed:
            if state["status"] == "running":
                self._save(state, status="timed_out", error=f"it took more than {state['timeout_s']} seconds")
                self.session.spark.interruptTag(f"inquest-{state['id']}")


class FlightServer(fl.FlightServerBase):
    """DoPut uploads a table, DoGet reads rows, DoAction submits, waits, cancels, lists, reports and explains."""

    def __init__(self, session: AiSession, directory: str, location: str = "grpc://127.0.0.1:0", token: str | None = None) -> None:
        super().__init__(location, middleware={"token": _TokenFactory(token)} if token else None)
        self.session, self.queue = session, Queue(session, directory)

    def do_put(self, context: Any, descriptor: Any, reader: Any, writer: Any) -> None:
        path = [p.decode() for p in descriptor.path]
        try:
            self.session.register(path[0], reader.read_all(), path[1] if len(path) > 1 else "")
        except CompileError as e:
            raise fl.FlightServerError(str(e)) from e

    def do_get(self, context: Any, ticket: Any) -> fl.RecordBatchStream:
        text = ticket.ticket.decode()
        try:
            if text.lstrip().startswith("{"):
                want = json.loads(text)
                if want.get("stream"):
                    self.queue.wait(want["query_id"])
                return fl.RecordBatchStream(self.queue.rows(want["query_id"]))
            return fl.RecordBatchStream(self.session.sql(text).execute_stream())
        except (CompileError, RefusalError, KeyError) as e:
            raise fl.FlightServerError(str(e)) from e

    def do_action(self, context: Any, action: Any) -> list[bytes]:
        body = action.body.to_pybytes().decode() if action.body else ""
        try:
            return [json.dumps(self._act(action.type, body)).encode()]
        except (CompileError, RefusalError, KeyError, ValueError) as e:
            raise fl.FlightServerError(str(e)) from e

    def _act(self, kind: str, body: str) -> Any:
        given = json.loads(body) if body.lstrip().startswith("{") else {"id": body}
        if kind == "submit":
            return self.queue.submit(**{k: given[k] for k in ("sql", "dialect", "id", "timeout_s") if k in given})
        if kind == "status":
            return self.queue.status(given["id"], given.get("after"), given.get("wait_s", 0.0))
        if kind == "cancel":
            return self.queue.cancel(given["id"])
        if kind == "list":
            return list(self.queue.states.values())
        if kind == "report":
            return self.queue.get(given["id"])["report"]
        if kind == "answers":
            report = self.queue.get(given["id"])["report"] or {"calls": []}
            after, limit = given.get("after", 0), given.get("limit", 1000)
            return {"answers": report["calls"][after : after + limit], "next": min(len(report["calls"]), after + limit)}
        if kind == "explain":
            return self.session.sql(given["sql"], dialect=given.get("dialect", "snowflake").lower()).explain()
        raise ValueError(f"unknown action '{kind}'")

    def list_actions(self, context: Any) -> list[tuple[str, str]]:
        return [(k, k) for k in ("submit", "status", "cancel", "list", "report", "answers", "explain")]

    def shutdown(self) -> None:
        self.queue.close()
        super().shutdown()


class RemoteSession:
    """A client of a server."""

    def __init__(self, location: str, token: str | None = None) -> None:
        self.client = fl.connect(location)
        self.options = fl.FlightCallOptions(headers=[] if token is None else [(b"authorization", b"Bearer " + token.encode())])

    def _act(self, kind: str, body: Any) -> Any:
        action = fl.Action(kind, (body if isinstance(body, str) else json.dumps(body)).encode())
        (reply,) = self.client.do_action(action, self.options)
        return json.loads(reply.body.to_pybytes())

    def register(self, name: str, table: pa.Table, id_col: str = "") -> None:
        writer, _ = self.client.do_put(fl.FlightDescriptor.for_path(*([name, id_col] if id_col else [name])), table.schema, self.options)
        writer.write_table(table)
        writer.close()

    def sql(self, text: str, dialect: str = "snowflake") -> RemoteQuery:
        return RemoteQuery(self, text, dialect)

    def get_run(self, id: str) -> RemoteRun:
        return RemoteRun(self, self._act("status", id))

    def list(self) -> list[dict]:
        return self._act("list", "")


class RemoteQuery:
    def __init__(self, session: RemoteSession, text: str, dialect: str) -> None:
        self.session, self.text, self.dialect = session, text, dialect

    def collect(self) -> pa.Table:
        return self.session.client.do_get(fl.Ticket(self.text.encode()), self.session.options).read_all()

    def submit(self, id: str | None = None, timeout_s: float | None = None) -> RemoteRun:
        return RemoteRun(self.session, self.session._act("submit", {"sql": self.text, "dialect": self.dialect, "timeout_s": timeout_s} | ({"id": id} if id else {})))

    def explain(self) -> str:
        return self.session._act("explain", {"sql": self.text, "dialect": self.dialect})


class RemoteRun:
    def __init__(self, session: RemoteSession, state: dict) -> None:
        self.session, self.state, self.id = session, state, state["id"]

    def status(self, wait_s: float = 0.0) -> dict:
        self.state = self.session._act("status", {"id": self.id, "after": self.state["revision"], "wait_s": wait_s} if wait_s else {"id": self.id})
        return self.state

    def wait(self, timeout_s: float = 600.0) -> dict:
        end = time.time() + timeout_s
        while self.status()["status"] not in _ENDED and time.time() < end:
            self.status(min(5.0, max(0.1, end - time.time())))
        return self.state

    def collect(self) -> pa.Table:
        self.wait()
        if self.state["status"] != "succeeded":
            raise RefusalError([self.state["error"] or self.state["status"]])
        return self.session.client.do_get(fl.Ticket(json.dumps({"query_id": self.id}).encode()), self.session.options).read_all()

    def cancel(self) -> dict:
        return self.session._act("cancel", self.id)

    def report(self) -> dict:
        return self.session._act("report", self.id)
