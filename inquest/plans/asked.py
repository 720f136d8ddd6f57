"""How many questions some query shapes ask: small tables, a planted model, rewrites on and off."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

from inquest.operators.backends import ArrowBackend
from inquest.plans.eager import RULES
from inquest.plans.session import AiSession

_IF, _LONG, _TONE = "AI.IF(PROMPT('sort: {0}', n.said))", "AI.IF(PROMPT('long: {0}', n.said))", "AI.CLASSIFY(PROMPT('mood: {0}', n.said), ['a', 'b'])"


def _rows(**more) -> pa.Table:
    ids, said = zip(*((f"r{i}", f"b{i}") for i in range(6)), strict=True)
    return pa.table({"id": list(ids), "said": list(said), **more})


def planted(kind: str = "", long: str = "") -> ArrowBackend:
    """A model that accepts bodies whose digit is listed, and labels even ones 'a'."""

    def answer(call, documents):
        out = []
        for d in documents:
            digit = d[0][-1:]
            if call.kind == "if":
                out.append(digit in (long if call.question.startswith("long") else kind))
            elif call.kind == "classify":
                out.append("a" if int(digit) % 2 == 0 else "b")
            elif call.kind == "extract":
                out.append({n: d[0] for n, _ in call.fields})
            else:
                out.append(f"summary {d[0]}")
        return out

    return ArrowBackend(answer, "planted")


SHAPES: dict[str, tuple[Callable[[], pa.Table], ArrowBackend, str, int]] = {
    "limit 2": (_rows, planted("1245"), f"SELECT n.id FROM notes n WHERE {_IF} LIMIT 2", 4),
    "limit 2 offset 1": (_rows, planted("1245"), f"SELECT n.id FROM notes n WHERE {_IF} LIMIT 2 OFFSET 1", 6),
    "plain filter, limit 2": (lambda: _rows(rank=[1, 4, 5, 2, 5, 3]), planted("1245"), f"SELECT n.id FROM notes n WHERE n.rank > 3 AND {_IF} LIMIT 2", 3),
    "in subquery": (lambda: _rows(of=[1, 1, 2, 2, 3, 3]), planted("0123"), f"SELECT g.code FROM goods g WHERE g.nr IN (SELECT n.of FROM notes n WHERE {_IF})", 4),
    "exists": (lambda: _rows(of=[1, 1, 2, 2, 3, 3]), planted("0123"), f"SELECT g.code FROM goods g WHERE EXISTS (SELECT 1 FROM notes n WHERE n.of = g.nr AND {_IF})", 4),
    "in subquery of a label": (lambda: _rows(of=[1, 1, 2, 2, 3, 3]), planted(), f"SELECT g.code FROM goods g WHERE g.nr IN (SELECT n.of FROM notes n WHERE {_TONE} = 'a')", 6),
    "distinct": (lambda: _rows(rank=[5, 5, 4, 4, 3, 3]), planted("1234"), f"SELECT DISTINCT n.rank FROM notes n WHERE {_IF}", 4),
    "written twice": (_rows, planted("124"), f"SELECT n.id, {_IF} AS k FROM notes n WHERE {_IF}", 6),
    "label across a derived table": (_rows, planted(), f"SELECT t.id, t.tone FROM (SELECT n.id, {_TONE} AS tone FROM notes n) t WHERE t.tone = 'a'", 6),
    "case": (lambda: _rows(wide=[True, False, None, True, False, True]), planted(), f"SELECT n.id, CASE WHEN n.wide THEN {_TONE} END AS t FROM notes n", 3),
    "plain or if": (lambda: _rows(wide=[True, False, None, True, False, True]), planted("024"), f"SELECT n.id FROM notes n WHERE n.wide OR {_IF}", 3),
    "if or if": (_rows, planted("03", "234"), f"SELECT n.id FROM notes n WHERE {_IF} OR {_LONG}", 10),
    "if or if with a hint": (_rows, planted("03", "234"), f"SELECT n.id FROM notes n WHERE {_IF} OR AI.IF(PROMPT('long: {{0}}', n.said), {{'selectivity': 0.9}})", 9),
    "plain or if or if": (lambda: _rows(wide=[True, False, None, True, False, True]), planted("4", "1"), f"SELECT n.id FROM notes n WHERE n.wide OR {_IF} OR {_LONG}", 5),
    "copies": (lambda: pa.table({"id": list("abcdef"), "said": [f"b{i}" for i in (0, 1, 0, 2, 1, 0)]}), planted("02"), f"SELECT n.id FROM notes n WHERE {_IF}", 3),
    "derived, limit 3, then a test": (_rows, planted(), f"SELECT t.id FROM (SELECT n.id, {_TONE} AS tone FROM notes n LIMIT 3) t WHERE t.tone = 'a'", 3),
    "concat of a label, limit 2": (_rows, planted(), f"SELECT n.id, CONCAT({_TONE}, '!') AS t FROM notes n LIMIT 2", 2),
    "distinct, test above": (lambda: _rows(rank=[5, 5, 4, 4, 3, 3]), planted("1234"), f"SELECT * FROM (SELECT DISTINCT n.rank FROM notes n WHERE {_IF}) t WHERE t.rank > 3", 3),
    "case of two tests": (lambda: _rows(wide=[True, False, None, True, False, True]), planted(), "SELECT n.id, CASE WHEN n.id <> 'r0' AND n.wide THEN AI.MAP(n.said, 'shorten') END AS s FROM notes n", 2),
    "later branches and nested case": (lambda: _rows(rank=[1, 2, 3, 4, 5, 6]), planted("0"), f"SELECT n.id, CASE WHEN n.rank > 4 THEN 'x' WHEN n.rank > 2 THEN {_TONE} ELSE CASE WHEN n.rank > 1 THEN AI.MAP(n.said, 'shorten') END END AS t FROM notes n", 3),
    "limit 0": (_rows, planted("1245"), f"SELECT n.id, {_TONE} AS t FROM notes n WHERE {_IF} LIMIT 0", 0),
    "plain or exists of a pair": (lambda: _rows(wide=[True, False, None, True, False, True]), planted("12"), "SELECT n.id FROM notes n WHERE n.wide OR EXISTS (SELECT 1 FROM goods g WHERE g.nr = 1 AND AI.IF(PROMPT('sort: {0} {1}', n.said, g.code)))", 3),
    "extract like": (lambda: pa.table({"id": list("abcde"), "said": ["until 2027", "May 2026", "2027 it is", "no year", "from 2027 on"]}), planted(), "SELECT n.id FROM notes n WHERE AI.EXTRACT(n.said, {'w': 'which year'})['w'] LIKE '%2027%'", 3),
    "copies in a join": (lambda: pa.table({"id": list("abcdef"), "said": [f"b{i}" for i in (0, 1, 0, 2, 1, 0)], "hotel": [1, 1, 1, 2, 2, 2]}), planted("02"), "SELECT a.id, b.id AS other FROM notes a JOIN notes b ON a.hotel = b.hotel AND AI.IF(PROMPT('sort: {0} {1}', a.said, b.said))", 9),
    "order by id limit 5": (_rows, planted(), "SELECT n.id, AI.EXTRACT(n.said, {'w': 'which word'})['w'] AS w FROM notes n ORDER BY n.id LIMIT 5", 5),
    "shared and unread": (_rows, planted("01"), f"WITH a AS (SELECT n.id, {_IF} AS k FROM notes n), b AS (SELECT n.id, {_TONE} AS t FROM notes n) SELECT x.id FROM a x JOIN a y ON x.id = y.id WHERE x.k", 7),
}


def asked_of(spark: SparkSession, shape: str, without: tuple[str, ...] = ()) -> tuple[int, list[dict]]:
    make, model, sql, _ = SHAPES[shape]
    with AiSession(spark, model, without=without) as s:
        s.register("notes", make())
        s.register("goods", pa.table({"nr": [4, 3, 2, 1], "code": ["w", "x", "y", "z"]}))
        query = s.sql(sql)
        rows = query.run().to_rows()
        return query.asked.total, sorted(rows, key=str)


def asked(spark: SparkSession) -> dict[str, dict[str, int]]:
    return {shape: {"asked": asked_of(spark, shape)[0], "without_rules": asked_of(spark, shape, RULES)[0], "baseline": n} for shape, (*_, n) in SHAPES.items()}
