"""Property predicates, compiled to column expressions.

Comparison is bytewise on strings, as property values are strings.  A missing key
satisfies no predicate.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, functions as F


class Relation(Enum):
    """The relations a value may be required to have to a constant."""

    EQUALS = "equals"
    LESS = "less"
    GREATER = "greater"
    LESS_EQUAL = "less_equal"
    GREATER_EQUAL = "greater_equal"
    STARTS_WITH = "starts_with"
    ENDS_WITH = "ends_with"
    CONTAINS = "contains"


_TESTS = {
    Relation.EQUALS: lambda c, v: c == v,
    Relation.LESS: lambda c, v: c < v,
    Relation.GREATER: lambda c, v: c > v,
    Relation.LESS_EQUAL: lambda c, v: c <= v,
    Relation.GREATER_EQUAL: lambda c, v: c >= v,
    Relation.STARTS_WITH: lambda c, v: c.startswith(v),
    Relation.ENDS_WITH: lambda c, v: c.endswith(v),
    Relation.CONTAINS: lambda c, v: c.contains(v),
}


@dataclass(frozen=True)
class Pred:
    """``key`` has some value that stands in ``relation`` to ``value``."""

    key: str
    relation: Relation
    value: str

    def __post_init__(self) -> None:
        if not isinstance(self.relation, Relation):
            raise ValueError(f"unknown relation {self.relation!r}")

    def test(self, column: Column) -> Column:
        """The predicate on a column of values."""
        return _TESTS[self.relation](column, F.lit(self.value))

    def in_array(self, props: Column) -> Column:
        """The predicate on array<struct<key, value>>: some entry satisfies it."""
        return F.exists(props, lambda p: (p["key"] == self.key) & self.test(p["value"]))


Requirements = Mapping[str, str | Iterable[str]] | Iterable[Pred | tuple[str, str]] | None


def predicates(req: Requirements) -> list[Pred]:
    """Predicates from any accepted form: a dict (a list as value: several required values), pairs, or predicates."""
    if req is None:
        return []
    if isinstance(req, Mapping):
        pairs = [(k, v) for k, vs in req.items() for v in ([vs] if isinstance(vs, str) else vs)]
        return [Pred(k, Relation.EQUALS, str(v)) for k, v in pairs]
    return [p if isinstance(p, Pred) else Pred(p[0], Relation.EQUALS, str(p[1])) for p in req]
