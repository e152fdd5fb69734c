"""Templates become Column expressions once, while the plan is built."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlane import constants as C


def value_or_missing(df: DataFrame, field: str) -> Column:
    """A field as text; null, nan, '' and an absent column read as 'no information'."""
    if field not in df.columns:
        return F.lit(C.MISSING)
    column = F.col(field)
    if dict(df.dtypes)[field] in ("double", "float"):
        column = F.nanvl(column, F.lit(None).cast("double"))
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(C.MISSING))


def fields_of(template: str) -> list[str]:
    return [field for _, field, _, _ in Formatter().parse(template) if field]


def fill(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each {field} replaced by its column."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)


def by_intent(
    intent: Column,
    values: dict[str, Column],
    templates: dict[str, str],
    default_template: str,
    slots: dict[str, list[str]] = C.INTENT_SLOTS,
) -> Column:
    """One CASE over the intents.

    A template that asks for a field its intent has no slot for turns into the
    apology text; that is known when the plan is built, not per row.
    """

    def rendered(template: str, available: list[str]) -> Column:
        if set(fields_of(template)) <= set(available):
            return fill(template, values)
        return fill(C.FIELD_APOLOGY, {"name": values["name"] if "name" in available else F.lit("该景点")})

    chosen = None
    for name, template in templates.items():
        text = rendered(template, slots.get(name, C.DEFAULT_SLOTS))
        chosen = F.when(intent == name, text) if chosen is None else chosen.when(intent == name, text)
    return chosen.otherwise(rendered(default_template, C.DEFAULT_SLOTS))
