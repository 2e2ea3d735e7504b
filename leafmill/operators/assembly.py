"""Assembly: counts, checks, nested documents and report fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.dictionaries import BENIGN_REASONS, REASONS
from leafmill.functions.values import NOT_FOUND


def provenance(values: DataFrame, *keys: str) -> DataFrame:
    """Counts of extracted values (value, confidence, not_found_reason): total, sure, unsure, missing, by reason."""
    missing = F.col("value").isNull() | (F.col("value") == NOT_FOUND)
    reason = F.col("not_found_reason")
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~missing & (F.col("confidence") >= 0.8)).alias("n_high"),
        F.count_if(~missing & (F.col("confidence") < 0.5)).alias("n_low"), F.count_if(missing).alias("n_not_found"),
        *(F.count_if(missing & (reason == r)).alias(f"n_{r}") for r in REASONS),
        F.count_if(missing & (reason.isNull() | ~reason.isin(BENIGN_REASONS))).alias("n_actionable"),
    )


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(agent, n_calls, prompt_tokens, completion_tokens, cost) a known or unknown agent, and a row for all (null agent)."""
    priced = calls.withColumn("model", F.regexp_replace("model", "^openrouter/", "")).join(prices, "model", "left")
    cost = (F.col("prompt_tokens") * F.col("rate_in") + F.col("completion_tokens") * F.col("rate_out")) / 1e6
    agent = F.coalesce(F.nullif(F.col("agent"), F.lit("")), F.lit("unknown"))
    out = priced.withColumn("agent", agent).withColumn("cost", F.coalesce(cost, F.lit(0.0)))
    return out.rollup("agent").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 6).alias("cost"),
    )


def conflicts(facts: DataFrame) -> DataFrame:
    """(key, field, n_values) where facts name more than one value."""
    found = facts.groupBy("key", "field").agg(F.count_distinct(F.col("value").cast("string")).alias("n_values"))
    return found.where("n_values > 1")


def nested(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with their children as an array of structs in order of ``ord``; without children it is empty."""
    columns = [c for c in children.columns if c not in (key, "ord")]
    told = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias(name))
    out = parents.join(told, key, "left")
    bare = F.transform(F.coalesce(F.col(name), F.array()), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    return out.withColumn(name, F.when(F.col(name).isNull(), None).otherwise(bare))


def escaped(text: Column) -> Column:
    """Text safe inside HTML."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fragment(value: Column, confidence: Column, quote: Column) -> Column:
    """One extracted value as HTML: cut at 100 characters, classed by confidence, its quote cut at 300."""
    cls = F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
    shown = F.when(F.length(value) > 100, F.concat(F.left(value, F.lit(100)), F.lit("..."))).otherwise(value)
    told = F.left(F.coalesce(quote, F.lit("")), F.lit(300))
    return F.concat(
        F.lit('<span class="'), cls, F.lit('" title="'), escaped(told), F.lit('">'), escaped(shown), F.lit("</span>")
    )
