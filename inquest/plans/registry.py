"""Extensions: models, observers, sinks of progress and answers, plan nodes and rules by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from inquest.errors import CompileError
from inquest.operators.backends import ExprBackend, ModelBackend
from inquest.operators.calls import ModelCall


class ExtensionRegistry:
    def __init__(self) -> None:
        self.models: dict[str, Callable[[], ModelBackend]] = {"expression": ExprBackend}
        self.observers: list[Callable[[dict], Any]] = []
        self.rules: list[Callable[[str], str]] = []
        self.progress: list[Callable[[dict], Any]] = []
        self.answers: list[Callable[[ModelCall, DataFrame], Any]] = []
        self.nodes: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register_model(self, name: str, make: Callable[[], ModelBackend]) -> None:
        if name in self.models:
            raise CompileError(f"a model named '{name}' is registered already")
        self.models[name] = make

    def register_observer(self, observer: Callable[[dict], Any]) -> None:
        self.observers.append(observer)

    def register_progress(self, sink: Callable[[dict], Any]) -> None:
        """Told after each call's answers are written: what was asked, how often, how many so far in the query."""
        self.progress.append(sink)

    def register_answers(self, sink: Callable[[ModelCall, DataFrame], Any]) -> None:
        """Given each call with a DataFrame of its answers (h1, h2, answer), which the sink may write where it likes."""
        self.answers.append(sink)

    def register_node(self, name: str, node: Callable[[DataFrame], DataFrame]) -> None:
        """A step of one's own between a query's rows and its result, by name: ``session.sql(text, nodes=[name])``."""
        if name in self.nodes:
            raise CompileError(f"a node named '{name}' is registered already")
        self.nodes[name] = node

    def node(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self.nodes:
            raise CompileError(f"unknown node '{name}'; there are {', '.join(self.nodes) or 'none'}")
        return self.nodes[name]

    def told(self, call: ModelCall, found: DataFrame, n: int, total: int) -> None:
        """Pass on what was asked; observers with ``after_node`` hear of it too."""
        event = {"node": f"ai_{call.kind}", "question": call.question, "asked": n, "total": total}
        for sink in self.progress:
            sink(event)
        for sink in self.answers:
            sink(call, found)
        for observer in self.observers:
            if hasattr(observer, "after_node"):
                observer.after_node(event)

    def report(self, report: dict) -> None:
        for observer in self.observers:
            (observer.report if hasattr(observer, "report") else observer)(report)

    def register_rule(self, rule: Callable[[str], str]) -> None:
        """A rewrite of the Spark SQL text before it is analysed."""
        self.rules.append(rule)

    def model(self, name: str) -> ModelBackend:
        if name not in self.models:
            raise CompileError(f"unknown model '{name}'; there are {', '.join(self.models)}")
        return self.models[name]()

    def load_extension(self, module: str) -> None:
        """Call ``register(registry)`` of a module; undo what it did if it fails."""
        names = ("models", "observers", "rules", "progress", "answers", "nodes")
        before = {n: getattr(self, n).copy() for n in names}
        try:
            importlib.import_module(module).register(self)
        except BaseException:
            self.__dict__.update(before)
            raise
