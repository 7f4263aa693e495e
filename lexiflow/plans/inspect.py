"""Physical-plan facts of a DataFrame, read from ``explain('formatted')``.

Used by tests (scale regressions: which exchanges carry which columns, no
row-at-a-time Python) and by ``scripts/plan_report.py``.
"""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class PlanFacts:
    nodes: list[tuple[str, list[str]]] = field(default_factory=list)  # (operator, input column names)

    def count(self, op: str) -> int:
        return sum(1 for name, _ in self.nodes if name == op)

    def exchanges_carrying(self, column: str) -> int:
        """Shuffle exchanges (not broadcasts) whose input includes ``column``."""
        return sum(1 for name, cols in self.nodes if name == "Exchange" and column in cols)


_HEADER = re.compile(r"^\((\d+)\) ([A-Za-z][A-Za-z ]*?)(?: \[codegen id : \d+\])?\s*$")
_INPUT = re.compile(r"^Input \[\d+\]: \[(.*)\]\s*$")


def formatted_plan(df: DataFrame) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def plan_facts(df: DataFrame) -> PlanFacts:
    """Operators of the (pre-AQE) physical plan with the column names they read."""
    facts = PlanFacts()
    current = None
    for line in formatted_plan(df).splitlines():
        m = _HEADER.match(line)
        if m:
            current = [m.group(2).strip(), []]
            facts.nodes.append((current[0], current[1]))
            continue
        m = _INPUT.match(line)
        if m and current is not None:
            current[1].extend(re.sub(r"#\d+L?", "", c).strip() for c in m.group(1).split(","))
    return facts
