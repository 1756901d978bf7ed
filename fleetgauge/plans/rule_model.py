"""How a rule is written down and how many rules are evaluated in one pass.

A rule is an ordered list of cases; the first case whose condition holds gives the finding. Conditions
and slots are SQL expressions over the rows being judged; texts are templates over the slots and are
filled only for rows that fired. The wide stage table is therefore scanned once for all rules, carries no
text, and shuffles nothing.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fleetgauge.functions.text import array_of, fixed, format_bytes, literal, shortest
from fleetgauge.plans.texts import Texts
from fleetgauge.thresholds import Thresholds

# Severities in order of urgency.
SEVERITIES = ("CRITICAL", "WARNING", "INFO")
CRITICAL, WARNING, INFO = range(len(SEVERITIES))

TEXTS = Texts._fields
NUMBERS = ("value", "x", "y")
COUNTS = ("n", "k")
LABELS = ("s", "s2")
FINDING_COLUMNS = (
    "rule_id",
    "severity",
    "sev_order",
    "rule_ord",
    "stage_id",
    "stage_pos",
    "value",
    *TEXTS,
)


@dataclass(frozen=True)
class Case:
    """One outcome of a rule. Its texts may use ``{slot}``, ``{slot:.1f}``, ``{slot:float}``, ``{slot:bytes}``."""

    when: str
    severity: str | int
    texts: Texts
    # replaces recommended_value when the job runs with adaptive execution
    recommended_if_aqe: str | None = None
    value: str = "NULL"
    x: str = "NULL"
    y: str = "NULL"
    n: str = "NULL"
    k: str = "NULL"
    s: str = "NULL"
    s2: str = "NULL"


@dataclass(frozen=True)
class Rule:
    """``cases`` builds the cases for given limits; ``rule_ord`` is the position in the report."""

    rule_id: str
    rule_ord: int
    per_stage: bool
    cases: Callable[[Thresholds], Sequence[Case]] = field(repr=False)


def _hit(case: Case, case_id: int) -> str:
    slots = [("case_id", "int", case_id), ("sev_order", "int", case.severity)]
    slots += [(name, "double", getattr(case, name)) for name in NUMBERS]
    slots += [(name, "bigint", getattr(case, name)) for name in COUNTS]
    slots += [(name, "string", getattr(case, name)) for name in LABELS]
    return f"named_struct({', '.join(f'{literal(name)}, cast({sql} AS {kind})' for name, kind, sql in slots)})"


# How a placeholder prints its slot.
FORMATS: dict[str, Callable[[str], str]] = {
    "": lambda slot: f"string({slot})",
    ".0f": lambda slot: fixed(slot, 0),
    ".1f": lambda slot: fixed(slot, 1),
    "float": shortest,
    "bytes": format_bytes,
}


def _placeholders(templates: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Placeholders used by the templates, texts last: a text might look like a placeholder itself."""
    found = {}
    for template in templates:
        for _, slot, spec, _ in string.Formatter().parse(template):
            if slot is not None:
                found["{" + slot + (f":{spec}" if spec else "") + "}"] = (slot, spec)
    return dict(sorted(found.items(), key=lambda item: (item[1][0] in LABELS, item[0] == "{s}", item[0])))


def evaluate(
    rows: DataFrame, rules: Sequence[Rule], thresholds: Thresholds, by: str, aqe_flags: DataFrame | None = None
) -> DataFrame:
    """Findings of all ``rules`` over ``rows``, in one scan.

    ``aqe_flags`` (``by``, ``aqe_enabled``) is joined to the findings, not to the rows, and only when a
    rule's advice depends on it.
    """
    outcomes: list[tuple[Rule, Case]] = []
    hits = []
    for rule in rules:
        branches = []
        for case in rule.cases(thresholds):
            branches.append(f"WHEN {case.when} THEN {_hit(case, len(outcomes))}")
            outcomes.append((rule, case))
        hits.append(f"CASE {' '.join(branches)} END")

    per_stage = rules[0].per_stage
    stage_id = "bigint(stage_id)" if per_stage else "bigint(NULL)"
    position = "bigint(stage_pos)" if per_stage and "stage_pos" in rows.columns else stage_id
    fired = rows.selectExpr(
        by, f"{stage_id} AS stage_id", f"{position} AS stage_pos", f"explode({array_of(hits)}) AS hit"
    ).filter("hit IS NOT NULL")

    cases = [case for _, case in outcomes]
    templates = {name: [getattr(case.texts, name) for case in cases] for name in TEXTS}
    when_adaptive = [case.recommended_if_aqe or case.texts.recommended_value for case in cases]
    used = _placeholders([t for texts in (*templates.values(), when_adaptive) for t in texts])
    # every placeholder is printed once per finding and shared by its texts
    slot_sql = lambda slot: slot if slot == "stage_id" else f"hit.{slot}"
    printed = [
        f"coalesce({FORMATS[spec](slot_sql(slot))}, '') AS text_{i}" for i, (slot, spec) in enumerate(used.values())
    ]
    fired = fired.selectExpr(by, "stage_id", "stage_pos", "hit.case_id", "hit.sev_order", "hit.value", *printed)
    adaptive = any(case.recommended_if_aqe is not None for case in cases)
    if adaptive:
        fired = fired.join(aqe_flags, by, "left")

    def of_case(values: Sequence[str]) -> str:
        return f"get({array_of(values)}, case_id)"

    def text(name: str) -> str:
        filled = of_case([literal(t) for t in templates[name]])
        if name == "recommended_value" and adaptive:
            filled = f"if(aqe_enabled, {of_case([literal(t) for t in when_adaptive])}, {filled})"
        for i, placeholder in enumerate(used):
            if placeholder in "".join((*templates[name], *when_adaptive)):
                filled = f"replace({filled}, {literal(placeholder)}, text_{i})"
        return filled

    severities = array_of(literal(name) for name in SEVERITIES)
    return fired.selectExpr(
        by,
        f"{of_case([literal(rule.rule_id) for rule, _ in outcomes])} AS rule_id",
        f"get({severities}, sev_order) AS severity",
        "sev_order",
        f"{of_case([str(rule.rule_ord) for rule, _ in outcomes])} AS rule_ord",
        "stage_id",
        "stage_pos",
        "value",
        *[f"{text(name)} AS {name}" for name in TEXTS],
    )
