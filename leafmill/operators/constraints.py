"""Typed constraints of funds and share classes, parsed from their texts.

A constraint is a row (id, pos, rule, type, value, unit, comparator).  Missing values (null or NOT_FOUND) give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.functions.dictionaries import CONSTRAINT_FAMILIES, PREDEFINED
from leafmill.functions.values import NOT_FOUND


def _has(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != NOT_FOUND)


def _percent(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, "percent")


def restrictions(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and pos, text, type, value, unit, comparator of every clause.

    Clauses are exploded before they are parsed, so that parsing is plain columns of generated code.
    """
    each = rows.select(*keep, F.posexplode(t.clauses(F.col(text))).alias("pos", "text"))
    each = each.withColumns({"type": t.restriction(F.col("text")), "value": t.percentage(F.col("text"))})
    sense = F.coalesce(t.comparator(F.col("text")), F.when(F.col("type") == "concentration_limit", "max"))
    return each.select(*keep, "pos", "text", "type", "value", _percent(F.col("value")).alias("unit"), sense.alias("comparator"))


def _rule(text: Column, kind: Column, value: Column, unit: Column, comparator: Column) -> Column:
    return F.struct(
        text.alias("rule"), kind.alias("type"), value.cast("double").alias("value"), unit.cast("string").alias("unit"),
        comparator.cast("string").alias("comparator"),
    )


def leverage(text: Column) -> Column:
    """A limit of leverage, or of value at risk where the text names it."""
    low, value = F.lower(text), t.percentage(text)
    kind = F.when(t.any_of(low, ["var", "value at risk"]), "var_limit").otherwise("leverage_limit")
    return _rule(text, kind, value, _percent(value), F.when(_percent(value).isNotNull(), "max"))


def derivatives(text: Column) -> Column:
    """A limit of derivatives where the text gives one, else a policy."""
    limit = F.contains(F.lower(text), F.lit("limit")) | F.contains(text, F.lit("%"))
    value = F.when(limit, t.percentage(text))
    kind = F.when(limit, "derivative_limit").otherwise("derivative_policy")
    return _rule(text, kind, value, _percent(value), F.when(_percent(value).isNotNull(), "max"))


def of_funds(funds: DataFrame) -> DataFrame:
    """Constraints of funds (id, restrictions, leverage, derivatives), those of restrictions first."""
    limits = restrictions(funds.where(_has("restrictions")), "restrictions", ["id"]).withColumnRenamed("text", "rule")
    others = F.array_compact(F.array(
        F.when(_has("leverage"), leverage(F.col("leverage"))), F.when(_has("derivatives"), derivatives(F.col("derivatives"))),
    ))
    rest = funds.select("id", F.explode(others).alias("x")).select("id", F.lit(None).cast("int").alias("pos"), "x.*")
    return limits.select("id", "pos", "rule", "type", "value", "unit", "comparator").unionByName(rest)


def of_classes(classes: DataFrame) -> DataFrame:
    """Constraints of share classes (id, hedged, hedging, investors, minimum, holding; ``hedged`` is a boolean).

    A class that says that it isn't hedged has no hedging rule; one that is, without details, has a rule without numbers.
    """
    none = F.lit(None)
    target, (money, currency), period = t.hedge_ratio(F.col("hedging")), t.amount(F.col("minimum")), t.days(F.col("holding"))
    may_hedge = F.coalesce(F.col("hedged"), F.lit(True))
    known = lambda x: F.coalesce(x, F.lit(0)) != 0
    rules = F.array_compact(F.array(
        F.when(may_hedge & _has("hedging"), _rule(F.col("hedging"), F.lit("hedging_policy"), target, _percent(target), F.when(known(target), "exact")))
        .when(F.col("hedged") & ~F.coalesce(_has("hedging"), F.lit(False)), _rule(F.lit("Currency hedged (details not specified)"), F.lit("hedging_policy"), none, none, none)),
        F.when(_has("investors"), _rule(F.col("investors"), F.lit("investor_eligibility"), none, none, none)),
        F.when(_has("minimum"), _rule(F.col("minimum"), F.lit("minimum_investment"), money, F.coalesce(currency, F.lit("currency")), F.when(known(money), "min"))),
        F.when(_has("holding"), _rule(F.col("holding"), F.lit("holding_period"), F.when(known(period), period), F.when(known(period), "days"), F.when(known(period), "min"))),
    ))
    return classes.select("id", F.explode(rules).alias("x")).select("id", "x.*")


def is_predefined(kind: Column) -> Column:
    """Whether a constraint's type is of the schema rather than found by a model."""
    return kind.isin(PREDEFINED)


def family(kind: Column) -> Column:
    """The family of limits that a type belongs to, or null."""
    out = F
    for name, kinds in CONSTRAINT_FAMILIES.items():
        out = out.when(kind.isin(kinds), name)
    return out


def by_family(constraints: DataFrame) -> DataFrame:
    """(family, predefined, n, ids): how many constraints there are of each family, and of how many holders."""
    told = constraints.select("id", family(F.col("type")).alias("family"), is_predefined(F.col("type")).alias("predefined"))
    return told.groupBy("family", "predefined").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
