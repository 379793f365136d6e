"""Additive risk scores from rule tables.

A condition is a SQL predicate over the row. Early outs come first and end the score; then each group of rules
adds the points of its first rule that holds. Score and indicators come from the same conditions, so that they can't
disagree. Null conditions count as false.

Spark works in steps of one projection each: the lower-case texts that conditions look into, what several conditions share
(`common`), all conditions as the bits of a number, and from it score and indicators. No step needs a shuffle, and no text is
lowered or searched twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    when: str
    points: float
    says: str  # SQL for the indicator

    @property
    def holds(self) -> str:
        return f"coalesce({self.when}, false)"


def rule(when: str, points: float, text: str, detail: str | None = None) -> Rule:
    """A rule whose indicator is a text, with a detail after a colon if there is one."""
    return Rule(when, points, f"'{text}'" if detail is None else f"'{text}:' || CAST({detail} AS STRING)")


#: SQL that many conditions hold, by step: texts, and what is made of them.
COMMON: tuple[list[str], list[str]] = ([], [])


def common(sql: str, step: int = 0) -> str:
    """`sql`, which is worked out once per row where rules hold it."""
    if sql not in COMMON[step]:
        COMMON[step].append(sql)
    return sql


def quoted(words: Iterable) -> str:
    return ", ".join(f"'{w}'" if isinstance(w, str) else str(w) for w in words)


def holds_any(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def first_word(column: str, words: Iterable[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{w}') THEN '{w}'" for w in words) + " END"


def how_many(column: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({column}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


@dataclass(frozen=True)
class Scorer:
    early: Sequence[Rule]
    groups: Sequence[Sequence[Rule]]
    cap: float | None = 10.0

    def rules(self) -> list[Rule]:
        return [*self.early, *[r for g in self.groups for r in g]]

    def risk(self, holds: Callable[[Rule], str] = lambda r: r.holds) -> str:
        total = " + ".join("CASE " + " ".join(f"WHEN {holds(r)} THEN {r.points}D" for r in g) + " ELSE 0.0D END" for g in self.groups) or "0.0D"
        total = f"least({self.cap}D, {total})" if self.cap is not None else total
        return ("CASE " + " ".join(f"WHEN {holds(r)} THEN {r.points}D" for r in self.early) + f" ELSE {total} END") if self.early else total

    def indicators(self, holds: Callable[[Rule], str] = lambda r: r.holds) -> list[str]:
        """One SQL expression per possible indicator, null where it doesn't hold."""
        none = " OR ".join(holds(r) for r in self.early) or "false"
        early = ["CASE " + " ".join(f"WHEN {holds(r)} THEN {r.says}" for r in self.early) + " END"] if self.early else []
        return early + [f"CASE WHEN {none} THEN NULL " + " ".join(f"WHEN {holds(r)} THEN {r.says}" for r in g) + " END" for g in self.groups]

    def apply(self, df: DataFrame, risk: str = "risk", indicators: str = "indicators") -> DataFrame:
        bits = {w: k for k, w in enumerate(dict.fromkeys(r.holds for r in self.rules()))}  # at most 63 in any scorer
        says = [r.says for r in self.rules()]
        known: list[tuple[str, str]] = []  # SQL and the column that holds it, from the longest on

        def short(sql: str) -> str:
            for text, column in known:
                sql = sql.replace(text, column)
            return sql

        out = df
        for step, texts in enumerate(COMMON):
            made = {f"_rule_{step}_{k}": t for k, t in enumerate(texts) if any(t in x for x in (*bits, *says))}
            out = out.withColumns({name: F.expr(short(t)) for name, t in made.items()})
            known = sorted([*known, *[(t, name) for name, t in made.items()]], key=lambda x: -len(x[0]))
        mask = " + ".join(f"CASE WHEN {short(w)} THEN {1 << k}L ELSE 0L END" for w, k in bits.items()) or "0L"
        out = out.withColumn("_rule_hits", F.expr(mask))
        holds = lambda r: f"(_rule_hits & {1 << bits[r.holds]}L) <> 0L"
        found = F.filter(F.array(*[F.expr(short(x)) for x in self.indicators(holds)]), lambda x: x.isNotNull())
        return out.select(*[F.col(f"`{c}`") for c in df.columns], F.expr(self.risk(holds)).alias(risk), found.alias(indicators))

    def duckdb(self) -> tuple[str, str]:
        """Score and joined indicators for DuckDB."""
        plain = lambda x: x.replace("D THEN", " THEN")
        import re

        number = lambda x: re.sub(r"(\d\.\d+)D\b", r"\1::DOUBLE", x)
        return number(plain(self.risk())), number("concat_ws(',', " + ", ".join(self.indicators()) + ")")
