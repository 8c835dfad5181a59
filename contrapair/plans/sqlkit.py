"""Assembly of the check SQL: named views are pulled in as common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"\b\w+\b", sql))
    return [v for v in VIEWS if v in words]


def oracle(sql: str, **local: str) -> str:
    """Prefix a SELECT with the views it uses; `local` adds views of this query only, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _needs(VIEWS[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for text in [*local.values(), sql]:
        for name in _needs(text):
            visit(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({t})" for n, t in local.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def _nudge(digits: int) -> float:
    """A thousandth of the last digit: exact halves, whose sums differ in the last bit, all go up."""
    return float(f"1e-{digits + 3}")


def r(expr: str, digits: int = 8) -> str:
    """Rounded double, never negative zero."""
    return f"(round(({expr})::DOUBLE + {_nudge(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def rounded(c: Column | str, digits: int = 8) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)


def i64(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def rs(digits: int, **named: str) -> str:
    """Select-list of rounded expressions."""
    return ", ".join(f"{r(e, digits)} AS {n}" for n, e in named.items())


def fix(df, digits: int, *columns: str):
    return df.withColumns({c: rounded(c, digits) for c in columns})
