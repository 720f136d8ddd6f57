"""What a caller can be told."""

from __future__ import annotations

from dataclasses import dataclass, field


class CompileError(ValueError):
    """The query is wrong; nothing has run."""


class SimilarCallWarning(UserWarning):
    """Two questions differ so little that one of them is probably a slip."""


@dataclass
class RefusalError(Exception):
    """The query is right and cannot be run here."""

    reasons: list[str]
    constraint: str = ""
    needed: float | None = None
    available: float | None = None
    unit: str = ""
    details: dict = field(default_factory=dict)

    def __str__(self) -> str:
        return "; ".join(self.reasons)
