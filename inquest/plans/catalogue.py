"""The registered queries, each with a plain-SQL twin for DuckDB.

A query is written once with macros. In the engine's text a macro is an AI call; in the twin it is the arithmetic
that the deterministic model stands for, written out independently of the engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.errors import CompileError, RefusalError
from inquest.operators import ask as ops
from inquest.operators.backends import ArrowBackend, ExprBackend
from inquest.operators.calls import ModelCall
from inquest.plans.session import AiSession
from inquest.sources.shared import shared_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Asked:
    """Macros as AI calls."""

    def __getattr__(self, name: str):
        raise AttributeError(name)

    def IF(self, q, d, o=""):  # noqa: N802
        return f"AI.IF(PROMPT('{q} {{0}}', {d}){o and ', ' + o})"

    def SC(self, q, d):  # noqa: N802
        return f"AI.SCORE(PROMPT('{q} {{0}}', {d}))"

    def CL(self, q, d, labels, o=""):  # noqa: N802
        return f"AI.CLASSIFY(PROMPT('{q} {{0}}', {d}), {labels}{o and ', ' + o})"

    def MP(self, q, d):  # noqa: N802
        return f"AI.MAP({d}, '{q}')"

    def EX(self, fields, d, read):  # noqa: N802
        body = ", ".join(f"'{n}': '{q}'" for n, q in fields.items())
        return f"AI.EXTRACT({d}, {{{body}}})['{read}']"

    def SPAN(self, q, d, end):  # noqa: N802
        return f"AI.EXTRACT_SPAN({d}, {{'x': '{q}'}})['x']['{end}']"

    def JN(self, q, a, b):  # noqa: N802
        return f"AI.IF(PROMPT('{q} {{0}} {{1}}', {a}, {b}))"

    def JN3(self, q, a, b, c):  # noqa: N802
        return f"AI.IF(PROMPT('{q} {{0}} {{1}} {{2}}', {a}, {b}, {c}))"

    def JSC(self, q, a, b):  # noqa: N802
        return f"AI.SCORE(PROMPT('{q} {{0}} {{1}}', {a}, {b}))"

    def JCL(self, q, a, b, labels):  # noqa: N802
        return f"AI.CLASSIFY(PROMPT('{q} {{0}} {{1}}', {a}, {b}), {labels})"

    def pick(self, engine, twin):
        return engine


class Twin(Asked):
    """Macros as plain SQL."""

    @staticmethod
    def _k(text):
        return sum(ord(c) for c in text) % 7

    @staticmethod
    def _w(*docs):
        return " + ".join(f"ascii({d}) + length({d}) + ascii(right({d}, 1))" for d in docs)

    @staticmethod
    def _known(value, *docs):
        return f"(CASE WHEN {' AND '.join(f'({d}) IS NOT NULL' for d in docs)} THEN {value} END)"

    def IF(self, q, d, o=""):  # noqa: N802
        k = self._k(f"{q} {{0}}")
        return self._known(f"({self._w(d)} + {k}) % {k + 2} = 0", d)

    def SC(self, q, d):  # noqa: N802
        return self._known(f"(({self._w(d)} + {self._k(f'{q} {{0}}')}) % 5) / 4.0::DOUBLE", d)

    def CL(self, q, d, labels, o=""):  # noqa: N802
        n = labels.count("'") // 2
        return self._known(f"list_extract({labels}, (({self._w(d)} + {self._k(f'{q} {{0}}')}) % {n} + 1)::INT)", d)

    def MP(self, q, d):  # noqa: N802
        return self._known(f"list_extract(['amber', 'birch', 'cedar', 'dune', 'ember'], (({self._w(d)} + {self._k(q)}) % 5 + 1)::INT)", d)

    def EX(self, fields, d, read):  # noqa: N802
        return self._known(f"nullif(split_part({d}, ' ', (({self._w(d)} + {self._k(fields[read])}) % 3 + 1)::INT), '')", d)

    def SPAN(self, q, d, end):  # noqa: N802
        got = self.EX({"x": q}, d, "x")
        start = f"(strpos({d}, {got}) - 1)::INT"
        return self._known(start if end == "start" else f"({start} + length({got}))::INT", got)

    def JN(self, q, a, b):  # noqa: N802
        return self._known(f"({self._w(a, b)} + {self._k(f'{q} {{0}} {{1}}')}) % 3 = 0", a, b)

    def JN3(self, q, a, b, c):  # noqa: N802
        return self._known(f"({self._w(a, b, c)} + {self._k(f'{q} {{0}} {{1}} {{2}}')}) % 3 = 0", a, b, c)

    def JSC(self, q, a, b):  # noqa: N802
        return self._known(f"(({self._w(a, b)} + {self._k(f'{q} {{0}} {{1}}')}) % 5) / 4.0::DOUBLE", a, b)

    def JCL(self, q, a, b, labels):  # noqa: N802
        n = labels.count("'") // 2
        return self._known(f"list_extract({labels}, (({self._w(a, b)} + {self._k(f'{q} {{0}} {{1}}')}) % {n} + 1)::INT)", a, b)

    def pick(self, engine, twin):
        return twin


_TOPICS = "['travel', 'food', 'science', 'sport']"
_TONES = "['calm', 'angry', 'glad']"
_FIELDS = {"who": "who is named first", "what": "what is it about", "when": "when was it"}

#: name -> text with macros
TEXTS: dict[str, Callable[[Asked], str]] = {
    # filters and where a boolean may stand
    "ai_if_where": lambda m: f"SELECT doc_id FROM documents WHERE lang = 'en' AND {m.IF('is it about travel', 'text')}",
    "ai_if_not": lambda m: f"SELECT doc_id FROM documents WHERE NOT {m.IF('is it formal', 'text')}",
    "ai_if_false": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it formal', 'text')} = FALSE AND n_chars < 500",
    "ai_if_select": lambda m: f"SELECT doc_id, {m.IF('is it formal', 'text')} AS formal FROM documents",
    "ai_if_or_plain": lambda m: f"SELECT doc_id FROM documents WHERE n_chars > 4000 OR {m.IF('does it name a place', 'text')}",
    "ai_if_or_chain": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it about food', 'text')} OR {m.IF('does it name a person', 'text')} OR lang = 'de'",
    "ai_if_and_chain": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it about food', 'text')} AND {m.IF('does it give a number', 'text')} AND {m.IF('is the writer sure', 'text')}",
    "ai_if_case": lambda m: f"SELECT doc_id, CASE WHEN lang = 'fr' THEN {m.IF('is it polite', 'text')} ELSE NULL END AS polite, CASE WHEN {m.IF('is it formal', 'text')} THEN 'formal' ELSE 'loose' END AS style FROM documents",
    "ai_if_hint": lambda m: f"SELECT doc_id FROM documents WHERE {m.pick('HINT(', '(')}{m.IF('is it a list', 'text')}{m.pick(', {' + chr(39) + 'selectivity' + chr(39) + ': 0.3})', ')')}",
    "ai_if_is_null": lambda m: f"SELECT c.c_custkey FROM customer c LEFT JOIN labels l ON l.doc_id = c.c_custkey LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE {m.IF('is it formal', 'd.text')} IS NULL",
    "ai_prompt_multi_column": lambda m: f"SELECT doc_id FROM documents WHERE {m.pick('AI.IF(PROMPT(' + chr(39) + 'do {0} and {1} agree' + chr(39) + ', lang, text))', _twin_multi('lang', 'text', 'do DOCUMENT 0 and DOCUMENT 1 agree'))}",
    "ai_prompt_expression": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it shouted', 'LOWER(TRIM(text))')}",
    # scores
    "ai_score_select": lambda m: f"SELECT doc_id, {m.SC('how clear is', 'text')} AS score FROM documents",
    "ai_score_where": lambda m: f"SELECT doc_id FROM documents WHERE {m.SC('how clear is', 'text')} >= 0.75",
    "ai_score_topk": lambda m: f"SELECT doc_id, {m.SC('how useful is', 'text')} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20",
    "ai_score_avg_having": lambda m: f"SELECT source, ROUND(AVG({m.SC('how clear is', 'text')}), 6) AS mean, COUNT(*) AS n FROM documents GROUP BY source HAVING AVG({m.SC('how clear is', 'text')}) > 0.5",
    "ai_score_offset": lambda m: f"SELECT doc_id FROM documents WHERE {m.SC('how clear is', 'text')} > 0.2 ORDER BY doc_id LIMIT 10 OFFSET 5",
    # labels
    "ai_classify_select": lambda m: f"SELECT doc_id, {m.CL('topic of', 'text', _TOPICS)} AS topic FROM documents",
    "ai_classify_where_in": lambda m: f"SELECT doc_id FROM documents WHERE {m.CL('topic of', 'text', _TOPICS)} IN ('food', 'sport')",
    "ai_classify_group": lambda m: f"SELECT {m.CL('topic of', 'text', _TOPICS)} AS topic, COUNT(*) AS n, MIN(doc_id) AS first FROM documents GROUP BY {m.CL('topic of', 'text', _TOPICS)}",
    "ai_classify_distinct": lambda m: f"SELECT DISTINCT source, {m.CL('topic of', 'text', _TOPICS)} AS topic FROM documents",
    "ai_classify_less": lambda m: f"SELECT doc_id FROM documents WHERE {m.CL('tone of', 'text', _TONES)} < 'calm'",
    "ai_classify_described": lambda m: f"SELECT doc_id, {m.pick('AI.CLASSIFY(text, [{' + chr(39) + 'label' + chr(39) + ': ' + chr(39) + 'yes' + chr(39) + ', ' + chr(39) + 'description' + chr(39) + ': ' + chr(39) + 'it is' + chr(39) + '}, {' + chr(39) + 'label' + chr(39) + ': ' + chr(39) + 'no' + chr(39) + ', ' + chr(39) + 'description' + chr(39) + ': ' + chr(39) + 'it is not' + chr(39) + '}])', _twin_labels('text', ('yes', 'no')))} AS answer FROM documents",
    "ai_classify_probabilities": lambda m: m.pick(
        f"SELECT doc_id, p_probabilities['calm'] AS calm, p_probabilities['angry'] AS angry FROM (SELECT doc_id, AI.CLASSIFY(PROMPT('tone of {{0}}', text), {_TONES}, {{'probabilities': true}}) AS p FROM documents)",
        f"SELECT doc_id, CASE WHEN p = 'calm' THEN 1.0 ELSE 0.0 END::DOUBLE AS calm, CASE WHEN p = 'angry' THEN 1.0 ELSE 0.0 END::DOUBLE AS angry FROM (SELECT doc_id, {Twin().CL('tone of', 'text', _TONES)} AS p FROM documents)",
    ),
    "ai_classify_cross": lambda m: f"SELECT topic, tone, COUNT(*) AS n FROM (SELECT {m.CL('topic of', 'text', _TOPICS)} AS topic, {m.CL('tone of', 'text', _TONES)} AS tone FROM documents) t GROUP BY topic, tone",
    # extraction
    "ai_extract_field": lambda m: f"SELECT doc_id, {m.EX(_FIELDS, 'text', 'who')} AS who, {m.EX(_FIELDS, 'text', 'when')} AS happened FROM documents",
    "ai_extract_span": lambda m: f"SELECT doc_id, {m.SPAN('what is it about', 'text', 'start')} AS s, {m.SPAN('what is it about', 'text', 'end')} AS e FROM documents",
    "ai_extract_like": lambda m: f"SELECT doc_id FROM documents WHERE {m.EX(_FIELDS, 'text', 'what')} LIKE '%on%'",
    "ai_extract_null": lambda m: f"SELECT doc_id FROM documents WHERE {m.EX(_FIELDS, 'text', 'what')} IS NULL",
    "ai_extract_topk": lambda m: f"SELECT doc_id, {m.EX(_FIELDS, 'text', 'who')} AS who FROM documents ORDER BY doc_id DESC LIMIT 15",
    # mapping and features
    "ai_map_select": lambda m: f"SELECT doc_id, {m.MP('name its colour', 'text')} AS colour FROM documents",
    "ai_map_group": lambda m: f"SELECT {m.MP('name its colour', 'text')} AS colour, lang, COUNT(*) AS n FROM documents GROUP BY {m.MP('name its colour', 'text')}, lang",
    "ai_map_then_classify": lambda m: f"SELECT doc_id, {m.CL('mood of', 'c', _TONES)} AS mood FROM (SELECT doc_id, {m.MP('name its colour', 'text')} AS c FROM documents) t",
    "ai_features_unnest": lambda m: m.pick(
        "SELECT doc_id, UNNEST(AI.SAE_FEATURES(PROMPT('{0}', text), {'pooling': 'max'}))['feature'] AS feature FROM documents",
        f"SELECT doc_id, ((w * u.f + {Twin._k('{0}')}) % 89 + 100 * u.i)::INT AS feature FROM (SELECT doc_id, {Twin._w('text')} AS w FROM documents) t, (VALUES (1, 0), (3, 1), (7, 2)) u(f, i)",
    ),
    "ai_features_length": lambda m: m.pick("SELECT doc_id, ARRAY_LENGTH(AI.SAE_FEATURES(PROMPT('{0}', text))) AS n FROM documents", "SELECT doc_id, 3::INT AS n FROM documents"),
    # joins
    "ai_join_inner_key": lambda m: f"SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey AND {m.JN('fits', 's.s_name', 'n.n_name')}",
    "ai_join_cross": lambda m: f"SELECT r.r_regionkey, n.n_nationkey FROM region r, nation n WHERE {m.JN('is near', 'r.r_name', 'n.n_name')}",
    "ai_join_theta": lambda m: f"SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey AND {m.JN('is near', 'r.r_name', 'n.n_name')}",
    "ai_join_two_predicates": lambda m: f"SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON {m.JN('fits', 's.s_name', 'n.n_name')} AND {m.JN('trades with', 's.s_name', 'n.n_name')}",
    "ai_join_documents": lambda m: f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON {m.JN('quotes', 'd.text', 'b.text')} WHERE d.lang = 'es' AND {m.IF('is it formal', 'd.text')}",
    "ai_join_left": lambda m: f"SELECT s.s_suppkey, n.n_nationkey FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND {m.JN('fits', 's.s_name', 'n.n_name')}",
    "ai_join_right": lambda m: f"SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND {m.JN('fits', 's.s_name', 'n.n_name')}",
    "ai_join_full": lambda m: f"SELECT s.s_suppkey, n.n_nationkey FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND {m.JN('fits', 's.s_name', 'n.n_name')}",
    "ai_join_exists": lambda m: f"SELECT n.n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND {m.JN('fits', 's.s_name', 'n.n_name')})",
    "ai_join_not_exists": lambda m: f"SELECT n.n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND {m.JN('fits', 's.s_name', 'n.n_name')})",
    "ai_join_classify": lambda m: f"SELECT r.r_regionkey, n.n_nationkey, {m.JCL('relation of', 'r.r_name', 'n.n_name', _TONES)} AS relation FROM region r JOIN nation n ON {m.JN('is near', 'r.r_name', 'n.n_name')}",
    "ai_join_score": lambda m: f"SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON {m.JSC('closeness of', 'r.r_name', 'n.n_name')} >= 0.75",
    "ai_join_three_way": lambda m: f"SELECT r.r_regionkey, n.n_nationkey, s.s_suppkey FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey WHERE {m.JN3('go together', 'r.r_name', 'n.n_name', 's.s_name')}",
    "ai_key_join": lambda m: f"SELECT d.doc_id, p.colour, p.parts, p.first_part, p.last_part FROM documents d JOIN (SELECT colour, COUNT(*) AS parts, MIN(p_partkey) AS first_part, MAX(p_partkey) AS last_part FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'amber' WHEN 1 THEN 'dune' END AS colour FROM part) c GROUP BY colour) p ON p.colour = {m.MP('name its colour', 'd.text')}",
    "ai_on_one_table": lambda m: f"SELECT l.doc_id, d.lang FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND {m.IF('is it formal', 'd.text')}",
    "ai_self_join": lambda m: f"SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND {m.JN('resembles', 'a.n_name', 'b.n_name')}",
    # subqueries
    "ai_in_subquery": lambda m: f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE {m.IF('is it a good name', 'c_name')}) AND o_totalprice > 200000",
    "ai_exists_correlated": lambda m: f"SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND {m.IF('is it a rare name', 'c.c_name')} AND c.c_acctbal < 0)",
    "ai_not_exists_correlated": lambda m: f"SELECT n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND {m.IF('is it a rare name', 's.s_name')})",
    "ai_scalar_subquery": lambda m: f"SELECT n_nationkey, (SELECT COUNT(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND {m.IF('is it a rare name', 's.s_name')}) AS n FROM nation n",
    "ai_exists_or": lambda m: f"SELECT n.n_nationkey FROM nation n WHERE n.n_regionkey = 1 OR EXISTS (SELECT 1 FROM region r WHERE {m.JN('is near', 'r.r_name', 'n.n_name')})",
    "ai_count_threshold": lambda m: f"SELECT conv_id FROM conversations WHERE {m.IF('is it a question', 'text')} GROUP BY conv_id HAVING COUNT(*) >= 2",
    # set operations, shared tables, aggregated text
    "ai_cte_shared": lambda m: f"WITH q AS (SELECT conv_id, turn, {m.SC('how clear is', 'text')} AS s FROM conversations) SELECT a.conv_id, a.turn, b.turn AS next FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE b.s > a.s",
    "ai_union": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it formal', 'text')} UNION SELECT doc_id FROM labels WHERE toxic = 1",
    "ai_union_all": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it formal', 'text')} UNION ALL SELECT doc_id FROM labels WHERE quality = 0",
    "ai_intersect": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it formal', 'text')} INTERSECT SELECT doc_id FROM labels WHERE quality = 1",
    "ai_except": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it formal', 'text')} EXCEPT SELECT doc_id FROM labels",
    "ai_over_string_agg": lambda m: f"SELECT conv_id, {m.IF('is it settled', 'said')} AS settled FROM (SELECT conv_id, {m.pick('STRING_AGG(role, ' + chr(39) + ' ' + chr(39) + ')', 'string_agg(role, ' + chr(39) + ' ' + chr(39) + ')')} AS said FROM conversations WHERE role = 'user' GROUP BY conv_id) t",
    # windows
    "ai_window_rank": lambda m: f"SELECT doc_id, RANK() OVER (PARTITION BY source ORDER BY {m.SC('how clear is', 'text')} DESC) AS place FROM documents",
    "ai_window_lag": lambda m: f"SELECT conv_id, turn, LAG({m.CL('tone of', 'text', _TONES)}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations",
    "ai_window_between": lambda m: f"SELECT conv_id, turn, {m.IF('is it a greeting', 't.text')} AS hello FROM (SELECT conv_id, turn, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY {m.SC('how clear is', 'text')} DESC, turn) AS rn FROM conversations) t WHERE rn = 1",
    "ai_window_sum": lambda m: f"SELECT conv_id, turn, SUM({m.SC('how clear is', 'text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations",
    # aggregation
    "ai_filter_agg": lambda m: f"SELECT lang, COUNT(*) FILTER (WHERE {m.IF('is it formal', 'text')}) AS formal, COUNT(*) AS n FROM documents GROUP BY lang",
    "ai_sum_case": lambda m: f"SELECT source, CAST(SUM(CASE WHEN {m.IF('is it formal', 'text')} THEN n_chars ELSE 0 END) AS BIGINT) AS chars FROM documents GROUP BY source",
    "ai_bool_or": lambda m: f"SELECT conv_id, BOOL_OR({m.IF('is it a question', 'text')}) AS asked, MIN(turn) AS first FROM conversations GROUP BY conv_id",
    "ai_distinct_on": lambda m: f"SELECT DISTINCT ON (source) source, doc_id, {m.SC('how clear is', 'text')} AS s FROM documents ORDER BY source, s DESC, doc_id",
    "ai_limit_offset": lambda m: f"SELECT doc_id FROM documents WHERE {m.IF('is it formal', 'text')} ORDER BY doc_id DESC LIMIT 7 OFFSET 3",
    "ai_case_branches": lambda m: f"SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'long' WHEN {m.IF('is it formal', 'text')} THEN {m.CL('tone of', 'text', _TONES)} ELSE CASE WHEN lang = 'en' THEN {m.MP('name its colour', 'text')} ELSE 'other' END END AS c FROM documents",
    "ai_distinct_above": lambda m: f"SELECT * FROM (SELECT DISTINCT source AS origin FROM documents WHERE {m.IF('is it about travel', 'text')}) t WHERE t.origin > 'b'",
    "ai_group_topk": lambda m: f"SELECT source, COUNT(*) AS n FROM documents WHERE {m.IF('is it about travel', 'text')} GROUP BY source ORDER BY n DESC, source LIMIT 5",
    "ai_literal": lambda m: f"SELECT {m.IF('is it short', chr(39) + 'a word' + chr(39))} AS short, {m.MP('name its colour', chr(39) + 'sea' + chr(39))} AS colour",
    # functions whose spelling or meaning differs
    "regexp_whole": lambda m: f"SELECT n_nationkey FROM nation WHERE {m.pick('n_name RLIKE ' + chr(39) + 'NATION_1.' + chr(39), 'regexp_full_match(n_name, ' + chr(39) + 'NATION_1.' + chr(39) + ')')}",
    "regexp_any": lambda m: f"SELECT n_nationkey, {m.pick('regexp_count(n_name, ' + chr(39) + 'N' + chr(39) + ')', 'len(regexp_extract_all(n_name, ' + chr(39) + 'N' + chr(39) + '))::INT')} AS n FROM nation",
    "json_fields": lambda m: f"SELECT event_id, {m.pick('json_get_int(props, ' + chr(39) + 'k' + chr(39) + ')', '(props::JSON ->> ' + chr(39) + 'k' + chr(39) + ')::BIGINT')} AS k, props ->> 'k' AS t, props ->> 'none' AS missing FROM events",
    "int_division": lambda m: f"SELECT p_partkey, CAST({m.pick('p_size / 4', 'p_size // 4')} AS BIGINT) AS quarter, p_size % 4 AS rest, p_retailprice / 4 AS price FROM part",
    "concat_skip_null": lambda m: "SELECT s_suppkey, CONCAT(s_name, NULL, '/', CAST(s_nationkey AS STRING)) AS label, STRPOS(s_name, '#') AS at, SPLIT_PART(s_name, '#', 2) AS number FROM supplier",
    "null_order": lambda m: "SELECT doc_id, place FROM (SELECT d.doc_id, ROW_NUMBER() OVER (ORDER BY l.toxic DESC, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t" if not isinstance(m, Twin) else "SELECT doc_id, place FROM (SELECT d.doc_id, ROW_NUMBER() OVER (ORDER BY l.toxic DESC NULLS FIRST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t",
    "numeric_functions": lambda m: "SELECT o_orderkey, ABS(o_totalprice - 150000) AS away, ROUND(LOG10(o_totalprice), 6) AS size, GREATEST(o_custkey, NULL, 100) AS g, COALESCE(NULLIF(o_custkey % 7, 0), -1) AS rest FROM orders",
    "sum_of_nulls": lambda m: "SELECT lang, SUM(CASE WHEN n_chars < 0 THEN n_chars END) AS s, COUNT(*) AS n FROM documents GROUP BY lang",
    "window_frames": lambda m: "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first, NTILE(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS third FROM orders",
    "qualify": lambda m: "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000 QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "ai_qualify": lambda m: f"SELECT doc_id, source FROM documents QUALIFY RANK() OVER (PARTITION BY source ORDER BY {m.SC('how clear is', 'text')} DESC, doc_id) <= 3",
    "string_functions": lambda m: "SELECT c_custkey, UPPER(c_mktsegment) AS u, REVERSE(c_name) AS r, LENGTH(c_name) AS n, LEFT(c_name, 3) AS l, RIGHT(c_name, 2) AS e, SUBSTRING(c_name, 2, 4) AS s, NULLIF(c_mktsegment, 'BUILDING') AS x, GREATEST(c_nationkey, 10) AS g, ABS(c_acctbal) AS a FROM customer",
    # relational parity
    "plain_join_agg": lambda m: "SELECT c.c_mktsegment, COUNT(*) AS n, ROUND(SUM(l.l_quantity), 2) AS qty FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_returnflag = 'R' GROUP BY c.c_mktsegment",
    "plain_semi_anti": lambda m: f"SELECT c_custkey FROM customer {m.pick('LEFT', '')} SEMI JOIN orders ON c_custkey = o_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "plain_setops": lambda m: "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "plain_having": lambda m: "SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS parts, AVG(l_quantity) AS mean FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 20",
    "plain_distinct": lambda m: "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name ILIKE '%RING%'",
}


def _twin_multi(a: str, b: str, template: str) -> str:
    doc = f"(chr(10) || chr(10) || 'DOCUMENT 0:' || chr(10) || {a} || chr(10) || chr(10) || 'DOCUMENT 1:' || chr(10) || {b})"
    k = Twin._k(template)
    return Twin._known(f"({Twin._w(doc)} + {k}) % {k + 2} = 0", doc)


def _twin_labels(doc: str, labels: tuple[str, ...]) -> str:
    return Twin._known(f"list_extract({list(labels)}, (({Twin._w(doc)} + 0) % {len(labels)} + 1)::INT)", doc)


def session(spark: SparkSession, sf_dir: str, text: str, model: ArrowBackend | None = None) -> AiSession:
    """A session with the tables that a text names."""
    out = AiSession(spark, model)
    for name in TABLES:
        if name in text:
            out.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return out


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TEXTS[name](Asked())
    return session(spark, sf_dir, text).sql(text).dataframe()


# ---- DataFrame operators that ask in Python workers


def _arrow() -> ArrowBackend:
    return ArrowBackend(ExprBackend().ask)


def _ask_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ops.ask(docs, ModelCall("classify", "topic of {0}", labels=("travel", "food", "science", "sport")), ["text"], "topic", _arrow()).select("doc_id", "topic")


def _ask_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tests = [(ModelCall("if", q), ["text"]) for q in ("is it about food {0}", "does it name a person {0}")]
    return ops.ai_any(docs, F.col("n_chars") > 2000, tests, _arrow()).select("doc_id")


def _ask_join(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    call = ModelCall("if", "fits {0} {1}", 2)
    out = ops.ai_join(left, right, call, "s_name", "n_name", _arrow(), lambda a, b: a["s_nationkey"] == b["n_nationkey"], how)
    return out.select("s_suppkey") if how.startswith("left_") else out.select("s_suppkey", "n_nationkey")


def _ask_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ops.ai_fetch(docs, ModelCall("if", "is it formal {0}"), ["text"], 25, [F.col("doc_id")], _arrow()).select("doc_id")


def _ask_fetch_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ops.ai_fetch(docs, ModelCall("if", "is it formal {0}"), ["text"], 2, [F.col("doc_id")], _arrow(), key=["source"]).select("source", "doc_id")


#: Queries that are also asked of a model in Python workers, which the planner for such models takes apart.
MODELLED = (
    "ai_if_or_chain", "ai_if_and_chain", "ai_if_case", "ai_if_hint", "ai_prompt_multi_column", "ai_score_avg_having", "ai_score_topk", "ai_classify_group", "ai_classify_distinct", "ai_extract_like",
    "ai_extract_topk", "ai_extract_span", "ai_map_then_classify", "ai_features_unnest", "ai_join_inner_key", "ai_join_full", "ai_join_exists", "ai_join_not_exists", "ai_join_three_way", "ai_in_subquery",
    "ai_exists_or", "ai_count_threshold", "ai_cte_shared", "ai_except", "ai_window_between", "ai_sum_case", "ai_distinct_on", "ai_limit_offset", "ai_case_branches", "ai_distinct_above", "ai_qualify",
)


def _modelled(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TEXTS[name](Asked())
    return session(spark, sf_dir, text, _arrow()).sql(text).dataframe()


# ---- sources and statements


def _through(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, written in another format and registered from there."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    folder = f"{shared_dir(spark)}/{fmt}-{uuid.uuid4().hex}"
    with_ = AiSession(spark)
    if fmt == "json":
        part.write.json(folder)
        with_.register_json("part", folder, "p_partkey")
    elif fmt == "csv":
        part.write.csv(folder, header=True)
        with_.register_csv("part", folder, "p_partkey")
    elif fmt == "orc":
        part.write.orc(folder)
        with_.read_format("part", "orc", folder, "p_partkey")
    else:
        small = spark.read.parquet(f"{sf_dir}/nation.parquet").toArrow()  # 25 rows
        given = {"arrow": small, "reader": small.to_reader(), "pandas": small.to_pandas(), "batch": small.combine_chunks().to_batches()[0]}[fmt]
        with_.register("nation", given, "n_nationkey")
        return with_.sql("SELECT n_nationkey, n_name, AI.SCORE(PROMPT('how long is {0}', n_name)) AS s FROM nation").dataframe()
    return with_.sql("SELECT p_partkey, p_size, AI.IF(PROMPT('is it a good name {0}', p_name)) AS good FROM part").dataframe()


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS and VIEW, PREPARE and EXECUTE, DROP."""
    s = session(spark, sf_dir, "documents")
    for text in (
        "CREATE TABLE formal AS SELECT doc_id, lang, n_chars FROM documents WHERE AI.IF(PROMPT('is it formal {0}', text))",
        "CREATE VIEW short AS SELECT doc_id FROM formal WHERE n_chars < 2000",
        "CREATE TABLE gone AS SELECT 1 AS x",
        "DROP TABLE gone",
        "PREPARE p AS SELECT f.doc_id, f.lang FROM formal f JOIN short s ON f.doc_id = s.doc_id WHERE f.lang = $1 AND f.n_chars > $2",
    ):
        s.sql(text).dataframe()
    return s.sql("EXECUTE p('en', 100)").dataframe()


_REFUSED = {
    "no such model function": ("SELECT AI.GUESS(c_name) FROM customer", "unknown function AI.GUESS"),
    "unknown option": ("SELECT AI.IF(PROMPT('x {0}', c_name), {'speed': 1}) FROM customer", "unknown option 'speed'"),
    "selectivity of a wrong type": ("SELECT AI.IF(PROMPT('x {0}', c_name), {'selectivity': 'much'}) FROM customer", "selectivity must be a number"),
    "selectivity above one": ("SELECT AI.IF(PROMPT('x {0}', c_name), {'selectivity': 2}) FROM customer", "between 0 and 1"),
    "anchor of one table": ("SELECT AI.IF(PROMPT('x {0}', c_name), {'anchor': 'n'}) FROM customer", "this prompt reads one table"),
    "one label": ("SELECT AI.CLASSIFY(c_name, ['a']) FROM customer", "at least two labels"),
    "labels alike": ("SELECT AI.CLASSIFY(c_name, ['a', 'A']) FROM customer", "differ by more than letter case"),
    "compared with no label": ("SELECT 1 FROM customer WHERE AI.CLASSIFY(c_name, ['a', 'b']) = 'c'", "'c' is not a label"),
    "field twice": ("SELECT AI.EXTRACT(c_name, {'a': 'x', 'a': 'y'}) FROM customer", "written twice"),
    "question empty": ("SELECT AI.EXTRACT(c_name, {'a': ' '}) FROM customer", "is empty"),
    "hole in an instruction": ("SELECT AI.MAP(c_name, 'shorten {0}') FROM customer", "has no {N}"),
    "text as a test": ("SELECT 1 FROM customer WHERE AI.MAP(c_name, 'shorten')", "true or false"),
    "number as a test": ("SELECT 1 FROM customer WHERE c_nationkey", "true or false"),
    "prompt without its value": ("SELECT AI.IF(PROMPT('x {1}', c_name)) FROM customer", "PROMPT uses {1}"),
    "column not grouped": ("SELECT c_name, COUNT(*) FROM customer GROUP BY c_nationkey", "neither grouped nor aggregated"),
    "calls nearly alike": ("SELECT AI.IF(PROMPT('is it fine {0}', c_name)), AI.IF(PROMPT('Is it fine? {0}', c_name)) FROM customer", "ask the same"),
}


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What information_schema says of two registered tables."""
    s = session(spark, sf_dir, "region nation")
    return s.sql("SELECT t.table_name, c.column_name, CAST(c.ordinal_position AS BIGINT) AS place FROM information_schema.tables t JOIN information_schema.columns c ON t.table_name = c.table_name").dataframe()


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused before anything runs, and whether the message says why."""
    s, rows = session(spark, sf_dir, "customer"), []
    for name, (text, says) in _REFUSED.items():
        try:
            s.sql(text)
            rows.append((name, False))
        except (CompileError, RefusalError) as e:
            rows.append((name, says in str(e)))
    return spark.createDataFrame(rows, "mistake string, refused boolean")


_T = Twin()
_JOIN = "FROM supplier s {} JOIN nation n ON s.s_nationkey = n.n_nationkey AND " + _T.JN("fits", "s.s_name", "n.n_name")
OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ask_once": (_ask_once, f"SELECT doc_id, {_T.CL('topic of', 'text', _TOPICS)} AS topic FROM documents"),
    "ask_any": (_ask_any, f"SELECT doc_id FROM documents WHERE n_chars > 2000 OR {_T.IF('is it about food', 'text')} OR {_T.IF('does it name a person', 'text')}"),
    **{f"ask_join_{how}": (partial(_ask_join, how), f"SELECT s_suppkey, n_nationkey {_JOIN.format(word)}") for how, word in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"))},
    "ask_join_semi": (partial(_ask_join, "left_semi"), f"SELECT s_suppkey {_JOIN.format('SEMI')}"),
    "ask_join_anti": (partial(_ask_join, "left_anti"), f"SELECT s_suppkey {_JOIN.format('ANTI')}"),
    "ask_fetch": (_ask_fetch, f"SELECT doc_id FROM documents WHERE {_T.IF('is it formal', 'text')} ORDER BY doc_id LIMIT 25"),
    "ask_fetch_key": (_ask_fetch_key, f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE {_T.IF('is it formal', 'text')}) WHERE n <= 2"),
}

_GOOD = f"SELECT p_partkey, p_size, {_T.IF('is it a good name', 'p_name')} AS good FROM part"
_LONG = f"SELECT n_nationkey, n_name, {_T.SC('how long is', 'n_name')} AS s FROM nation"
OPERATORS |= {f"source_{fmt}": (partial(_through, fmt), _GOOD if fmt in ("json", "csv", "orc") else _LONG) for fmt in ("json", "csv", "orc", "arrow", "reader", "pandas", "batch")}
OPERATORS |= {f"model{name[2:]}": (partial(_modelled, name), TEXTS[name](_T)) for name in MODELLED}
OPERATORS["statements"] = (_statements, f"SELECT doc_id, lang FROM documents WHERE {_T.IF('is it formal', 'text')} AND lang = 'en' AND n_chars > 100 AND n_chars < 2000")
OPERATORS["described"] = (_described, "SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS place FROM information_schema.columns WHERE table_name IN ('region', 'nation')")
OPERATORS["refused"] = (_refused, "SELECT * FROM (VALUES " + ", ".join(f"('{name}', TRUE)" for name in _REFUSED) + ") t(mistake, refused)")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{name: partial(_run, name) for name in TEXTS}, **{name: run for name, (run, _) in OPERATORS.items()}}
ORACLES: dict[str, str] = {**{name: text(Twin()) for name, text in TEXTS.items()}, **{name: sql for name, (_, sql) in OPERATORS.items()}}
