"""Labels of cases from observed statuses: a table of rules, compiled to one expression a condition."""

from __future__ import annotations

import functools
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a test of a status accepts; a null status is `missing`. `clear` accepts all but these.
STATUSES = {"low": ("low", "critical_low"), "high": ("high", "critical_high"), "abnormal": ("low", "critical_low", "high", "critical_high"), "normal": ("normal",), "observed": ("low", "critical_low", "high", "critical_high", "normal"), "missing": ("missing",)}


class Rule(NamedTuple):
    """A label if all clauses hold; a clause holds if at least `need` of its (field, test) do."""

    state: str
    source: str
    confidence: float
    clauses: tuple[tuple[int, tuple[tuple[str, str], ...]], ...]


class Condition(NamedTuple):
    """Rules in order: the first that holds gives the label, else it is unknown from `otherwise`, with `fields`."""

    name: str
    rules: tuple[Rule, ...]
    otherwise: str
    fields: tuple[str, ...]


def every(*tests: tuple[str, str]):
    return tuple((1, (t,)) for t in tests)


def some(*tests: tuple[str, str], need: int = 1):
    return ((need, tests),)


def one_field(name: str, field: str, source: str, bad: str = "low", sure: tuple[float, float] = (0.95, 0.9), otherwise: str = "missing_lab") -> Condition:
    """Positive if the field is bad, negative if it is normal."""
    return Condition(name, (Rule("positive", source, sure[0], every((field, bad))), Rule("negative", source, sure[1], every((field, "normal")))), otherwise, (field,))


def diet(name: str, field: str, source: str) -> Condition:
    return one_field(name, field, source, sure=(0.78, 0.75), otherwise="missing_dietary_evidence")


def lab_or_diet(name: str, lab: str, lab_source: str, field: str, diet_source: str) -> Condition:
    """By the laboratory where it observed anything, else by the diet."""
    first, second = one_field(name, lab, lab_source), diet(name, field, diet_source)
    return Condition(name, (*first.rules, Rule("unknown", first.otherwise, 0.0, every((lab, "observed"))), *second.rules), second.otherwise, second.fields)


def two_fields(name: str, source: str, bad: tuple[tuple[str, str], ...], otherwise: str, sure: tuple[float, float]) -> Condition:
    """Positive if one of the fields is bad, negative if all are normal."""
    fields = tuple(f for f, _ in bad)
    return Condition(name, (Rule("positive", source, sure[0], some(*bad)), Rule("negative", source, sure[1], every(*[(f, "normal") for f in fields]))), otherwise, fields)


_LIPIDS = ("lab_total_cholesterol_status", "lab_ldl_status", "lab_hdl_status", "lab_triglycerides_status")
_C, _C_DIET = "benchmark_lab_vitamin_c_status", "benchmark_diet_vitamin_c_status"
#: Conditions, sources, fields and confidences.
CONDITIONS = (
    one_field("DEFICIT_VIT_D", "lab_vitamin_d_status", "direct_25ohd_rule"),
    lab_or_diet("DEFICIT_B12", "lab_b12_status", "direct_b12_rule", "benchmark_diet_b12_status", "dietary_b12_intake_rule"),
    Condition(
        "DEFICIT_HIERRO",
        (
            Rule("positive", "direct_ferritin_rule", 0.95, every(("lab_ferritin_status", "low"))),
            Rule("negative", "direct_ferritin_rule", 0.9, every(("lab_ferritin_status", "normal"), ("lab_hemoglobin_status", "normal"))),
            Rule("positive", "hemoglobin_surrogate_rule", 0.65, every(("lab_ferritin_status", "missing"), ("lab_hemoglobin_status", "low"))),
        ),
        "insufficient_iron_evidence",
        ("lab_ferritin_status", "lab_hemoglobin_status"),
    ),
    lab_or_diet("DEFICIT_MAGNESIO", "lab_magnesium_status", "direct_magnesium_rule", "benchmark_diet_magnesium_status", "dietary_magnesium_intake_rule"),
    Condition("BAJA_INMUNIDAD", (), "missing_zinc_or_clinical_infection_label", ("lab_zinc_status",)),
    two_fields("RIESGO_SALUD_OSEA", "direct_bone_lab_rule", (("lab_vitamin_d_status", "low"), ("lab_calcium_status", "low")), "insufficient_bone_evidence", (0.85, 0.8)),
    lab_or_diet("DEFICIT_FOLATO", "lab_folate_status", "direct_folate_rule", "benchmark_diet_folate_status", "dietary_folate_intake_rule"),
    lab_or_diet("DEFICIT_ZINC", "lab_zinc_status", "direct_zinc_rule", "benchmark_diet_zinc_status", "dietary_zinc_intake_rule"),
    lab_or_diet("DEFICIT_CALCIO", "lab_calcium_status", "direct_calcium_rule", "benchmark_diet_calcium_status", "dietary_calcium_intake_rule"),
    Condition("RIESGO_VITAMINA_C_BAJA", one_field("", _C, "plasma_vitamin_c_rule", sure=(0.8, 0.75)).rules + diet("", _C_DIET, "dietary_vitamin_c_intake_rule").rules, "missing_lab", (_C,)),
    diet("RIESGO_OMEGA3_BAJO", "benchmark_diet_omega3_status", "dietary_omega3_intake_rule"),
    diet("RIESGO_PROTEINA_INSUFICIENTE", "benchmark_diet_protein_status", "dietary_protein_intake_rule"),
    one_field("RIESGO_METABOLICO_GLUCOSA", "lab_glucose_status", "direct_glucose_rule", "high", (0.9, 0.85)),
    Condition(
        "RIESGO_DISLIPIDEMIA",
        (
            Rule("positive", "direct_lipid_panel_rule", 0.9, some(*[(f, "abnormal" if f == "lab_hdl_status" else "high") for f in _LIPIDS])),
            Rule("negative", "direct_lipid_panel_rule", 0.8, some(*[(f, "observed") for f in _LIPIDS], need=3) + every(*[(f, "clear") for f in _LIPIDS])),
        ),
        "insufficient_lipid_panel",
        _LIPIDS,
    ),
    two_fields("SAFETY_RENAL", "direct_renal_safety_rule", (("lab_creatinine_status", "high"), ("lab_egfr_status", "low")), "insufficient_renal_evidence", (0.95, 0.9)),
    two_fields("SAFETY_HEPATICA", "direct_liver_safety_rule", (("lab_alt_status", "high"), ("lab_ast_status", "high")), "insufficient_liver_evidence", (0.95, 0.9)),
    one_field("SAFETY_TIROIDEA", "lab_tsh_status", "direct_tsh_rule", "abnormal", (0.9, 0.85)),
)


def test_of(field: str, kind: str) -> Column:
    status = F.coalesce(F.col(field).cast("string"), F.lit("missing"))
    return ~status.isin(*STATUSES["abnormal"]) if kind == "clear" else status.isin(*STATUSES[kind])


def holds(rule: Rule) -> Column:
    def clause(need, tests):
        return functools.reduce(operator.add, [test_of(*t).cast("int") for t in tests]) >= need if len(tests) > 1 else test_of(*tests[0])

    return functools.reduce(operator.and_, [clause(*c) for c in rule.clauses])


def evidence_group(condition: str, source: str) -> str:
    if source.startswith(("direct_", "plasma_")):
        return "safety_only" if condition.startswith("SAFETY_") else "lab_only"
    if source.startswith("dietary_"):
        return "diet_only"
    return "surrogate" if "surrogate" in source else "unknown" if "missing" in source or "insufficient" in source else "lab_or_diet"


def _label(condition: Condition, state: str, source: str, confidence: float, fields: Column) -> Column:
    named = {"condition": condition.name, "state": state, "label_source": source, "evidence_group": evidence_group(condition.name, source), "confidence": confidence}
    return F.struct(*[F.lit(v).alias(k) for k, v in named.items()], fields.alias("evidence_fields"))


def label(condition: Condition) -> Column:
    """The label of a row of statuses; evidence_fields are those whose tests hold in the rule that does, but for tests of absence."""
    out = _label(condition, "unknown", condition.otherwise, 0.0, F.array(*map(F.lit, condition.fields)))
    for rule in reversed(condition.rules):
        tests = dict.fromkeys(t for _, clause in rule.clauses for t in clause if t[1] not in ("missing", "clear"))
        fields = F.array_distinct(F.array_compact(F.array(*[F.when(test_of(*t), F.lit(t[0])) for t in tests])))
        out = F.when(holds(rule), _label(condition, rule.state, rule.source, rule.confidence, fields)).otherwise(out)
    return out


def labels(cases: DataFrame, key: str, conditions: tuple[Condition, ...] = CONDITIONS) -> DataFrame:
    """(key, condition, state, label_source, evidence_group, confidence, evidence_fields): a row for each case and condition, in one scan. A status that cases have no column for is missing."""
    fields = {t[0] for c in conditions for r in c.rules for _, clause in r.clauses for t in clause}
    own = cases.withColumns({f: F.lit(None).cast("string") for f in sorted(fields - set(cases.columns))})
    return own.select(key, F.explode(F.array(*[label(c) for c in conditions])).alias("_l")).select(key, "_l.*")


def rule_rows(conditions: tuple[Condition, ...] = CONDITIONS) -> list[tuple]:
    """(condition, place, state, source, confidence, clause, need, field, test) of all rules."""
    return [(c.name, p, r.state, r.source, r.confidence, k, need, field, test) for c in conditions for p, r in enumerate(c.rules) for k, (need, tests) in enumerate(r.clauses) for field, test in tests]
