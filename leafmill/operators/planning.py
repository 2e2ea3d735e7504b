"""Plans: where each name and field of a document is to be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that name no section, and the fewest words that two names share.
STOPS = ["the", "and", "of", "in", "to", "for", "section", "see", "a", "an"]
# Scores of a critic's words.
SCORES = {"high": 1.0, "medium": 0.7, "low": 0.3, "not_found": 0.0}


def mention_ranges(mentions: DataFrame, last_page: Column, most: int = 5) -> DataFrame:
    """(doc, name, page_start, page_end): from a dedicated mention to the page before the next, at most ``most`` pages on.

    Of a name's mentions the last counts.
    """
    order = Window.partitionBy("doc").orderBy("page", "ord")
    told = mentions.where("dedicated").withColumn("next", F.lead("page").over(order))
    end = F.when(F.col("next").isNull(), F.least(F.col("page") + most - 1, last_page)).otherwise(
        F.least(F.greatest(F.col("page"), F.col("next") - 1), F.col("page") + most)
    )
    last = Window.partitionBy("doc", "name").orderBy(F.desc("page"), F.desc("ord"))
    told = told.select("doc", "name", F.col("page").alias("page_start"), end.alias("page_end"), F.row_number().over(last).alias("n"))
    return told.where("n = 1").drop("n")


def children_of_first(toc: DataFrame, words: list[str]) -> DataFrame:
    """Entries one level below the first entry whose title holds a word, up to the next entry at its level or above."""
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("title"), w))
    parent = toc.where(hit).groupBy("doc").agg(F.min_by(F.struct("ord", "level"), "ord").alias("parent"))
    below = toc.join(parent, "doc").where(F.col("ord") > F.col("parent.ord"))
    order = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.when(F.col("level") <= F.col("parent.level"), 1).otherwise(0)).over(order)
    found = below.withColumn("ended", ended).where((F.col("ended") == 0) & (F.col("level") == F.col("parent.level") + 1))
    return found.select("doc", "ord", "title")


def first_source(*ranges: DataFrame) -> DataFrame:
    """Ranges (doc, name, page_start, page_end) of the first source that has any for the document, with its place."""
    both = ranges[0].withColumn("source", F.lit(0))
    for i, r in enumerate(ranges[1:], 1):
        both = both.unionByName(r.withColumn("source", F.lit(i)))
    first = F.min("source").over(Window.partitionBy("doc"))
    return both.withColumn("least", first).where("source = least").drop("least")


def location(external: Column, table_pages: Column) -> Column:
    """Where identifiers or fees are: in another document, in one table, or with each fund."""
    return F.when(external, "external").when(F.size(table_pages) > 0, "consolidated_table").otherwise("per_fund_inline")


def recipes(funds: DataFrame, fields: list[str], table_fields: list[str]) -> DataFrame:
    """(fund, field, source): one row for each fund and field, from a table where the fund has one for that field."""
    each = funds.select("fund", "tables", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    by_table = F.array_contains("tables", F.col("field")) & F.col("field").isin(table_fields)
    return each.select("fund", "field", F.when(by_table, "table_lookup").otherwise("text_extraction").alias("source"))


# How references write pages (one sign between two numbers: "10 to 20" is page 10), appendices and sections.
PAGES = r"pages?\s*(\d+)(?:\s*[-–to]\s*(\d+))?"
APPENDIX, SECTION = r"(?:appendix|annex|schedule|exhibit)\s+([a-z0-9]+)", r"(?:section|part|chapter)\s+(\d+(?:\.\d+)*)"


def resolve_references(references: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, ref, page_start, page_end, how) of references (doc, ref, text).

    In this order: pages written out, an appendix by its letter or number, a section by number, a section by name or by
    two common words.  Sections (doc, ord, name, page_start, page_end) meet the references of their own document.
    """
    low = F.lower("text")
    pages = PAGES
    start = F.nullif(F.regexp_extract(low, pages, 1), F.lit("")).cast("long")
    end = F.coalesce(F.nullif(F.regexp_extract(low, pages, 2), F.lit("")).cast("long"), start)
    refs = references.select(
        "doc", "ref", low.alias("low"), start.alias("p1"), F.greatest(start, end).alias("p2"),
        F.nullif(F.regexp_extract(low, APPENDIX, 1), F.lit("")).alias("appendix"),
        F.nullif(F.regexp_extract(low, SECTION, 1), F.lit("")).alias("number"),
    )
    words = lambda c: F.array_except(F.array_distinct(F.split(c, r"[^a-z0-9]+")), F.array(*map(F.lit, [*STOPS, ""])))
    name = F.lower("name")
    is_appendix = name.rlike("appendix|annex|schedule|exhibit")
    met = refs.join(sections, "doc", "left")
    rank = (
        F.when(F.col("p1").isNotNull(), 1)
        .when(is_appendix & F.endswith(name, F.concat(F.lit(" "), F.col("appendix"))), 2)
        .when(F.contains(name, F.col("number")), 3)
        .when(F.contains(F.col("low"), name) | (F.size(F.array_intersect(words(F.col("low")), words(name))) >= 2), 4)
    )
    best = met.withColumn("rank", rank).groupBy("doc", "ref", "p1", "p2").agg(
        F.min_by(F.struct("page_start", "page_end", "rank"), F.when(F.col("rank").isNotNull(), F.struct("rank", "ord"))).alias("x")
    )
    how = F.element_at(F.array(*map(F.lit, ("pages", "appendix", "number", "name"))), F.col("x.rank"))
    return best.where("x is not null").select(
        "doc", "ref", F.coalesce("p1", "x.page_start").alias("page_start"), F.coalesce("p2", "x.page_end").alias("page_end"), how.alias("how")
    )


def merge_classes(base: DataFrame, updates: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Base rows with missing fields filled from the last update of the same keys; found values stay."""
    last = updates.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f"new_{f}") for f in fields))
    out = base.join(last, keys, "left")
    missing = lambda f: F.col(f).isNull() | (F.col(f) == "NOT_FOUND")
    filled = [F.when(missing(f), F.coalesce(f"new_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields]
    return out.select(*(c for c in base.columns if c not in fields), *filled)


def merge_codes(classes: DataFrame, found: DataFrame, length: int = 12) -> DataFrame:
    """Classes (fund, ord, name, code) after found codes (fund, ord, name, code) were merged in, one by one.

    A code of ``length`` characters overwrites that of the first class of its very name.  Where no class has that name, it
    goes to the first class without a code whose name holds the other or is held by it, in any case.  Both lists of a fund
    are few rows, folded as one array.
    """
    missing = lambda c: c.isNull() | (c == "NOT_FOUND")
    listed = lambda df, name: df.groupBy("fund").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "code"))).alias(name))
    both = listed(classes, "c").join(listed(found, "f"), "fund", "left")

    def step(acc: Column, x: Column) -> Column:
        name = F.lower(F.coalesce(x["name"], F.lit("")))
        low = lambda c: F.lower(F.coalesce(c["name"], F.lit("")))
        near = F.transform(acc, lambda c: (F.contains(low(c), name) | F.contains(name, low(c))) & missing(c["code"]))
        exact = F.array_position(F.transform(acc, lambda c: F.coalesce(c["name"], F.lit(""))), F.coalesce(x["name"], F.lit("")))
        place = F.when(exact > 0, exact).otherwise(F.array_position(near, F.lit(True)))
        fits = F.coalesce(F.length(x["code"]) == length, F.lit(False)) & (x["code"] != "NOT_FOUND")
        return F.transform(acc, lambda c, i: F.when(fits & (i == place - 1), F.struct(c["ord"], c["name"], x["code"].alias("code"))).otherwise(c))

    none = F.filter("c", lambda c: F.lit(False))
    done = F.aggregate(F.coalesce("f", none), F.col("c"), step)
    return both.select("fund", F.explode(done).alias("x")).select("fund", "x.*")


def merge_fees(classes: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """Classes (fund, ord, name, fields) with missing fields filled from found rows (fund, ord, name, fields).

    A found row is for the first class whose name is its own or holds it in any case; of a class's rows the first with a
    value counts.
    """
    missing = lambda c: c.isNull() | (c == "NOT_FOUND")
    told = found.select("fund", F.col("ord").alias("told"), F.col("name").alias("told_name"), *(F.when(~missing(F.col(f)), F.col(f)).alias(f"new_{f}") for f in fields))
    holds = F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("told_name", F.lit(""))))
    first = told.join(classes.select("fund", "ord", "name"), "fund").where(F.col("name").eqNullSafe(F.col("told_name")) | holds)
    first = first.groupBy("fund", "told", *(f"new_{f}" for f in fields)).agg(F.min("ord").alias("ord"))
    new = first.groupBy("fund", "ord").agg(*(F.min_by(f"new_{f}", F.when(F.col(f"new_{f}").isNotNull(), F.col("told"))).alias(f"new_{f}") for f in fields))
    out = classes.join(new, ["fund", "ord"], "left")
    return out.select("fund", "ord", "name", *(F.when(missing(F.col(f)), F.coalesce(f"new_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields))


def class_constraints(classes: DataFrame) -> DataFrame:
    """(id, type, value, unit, comparator) of hedging, minimum and holding rules of share classes, one row each."""
    from leafmill.functions.text import amount, days, hedge_ratio

    hedge, money, period = hedge_ratio(F.col("hedging")), amount(F.col("minimum")), days(F.col("holding"))
    rule = lambda kind, value, unit, sense: F.struct(
        F.lit(kind).alias("type"), value.cast("double").alias("value"), unit.alias("unit"), F.when(value.isNotNull(), sense).alias("comparator")
    )
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "NOT_FOUND")
    rules = F.array_compact(F.array(
        F.when(has("hedging"), rule("hedging_policy", hedge, F.when(hedge.isNotNull(), "percent"), "exact")),
        F.when(has("minimum"), rule("minimum_investment", money[0], F.coalesce(money[1], F.lit("currency")), "min")),
        F.when(has("holding"), rule("holding_period", period, F.when(period.isNotNull(), "days"), "min")),
    ))
    return classes.select("id", F.explode(rules).alias("x")).select("id", "x.*")


def not_found_reason(
    not_applicable: Column, in_external: Column, said_absent: Column, referred: Column
) -> Column:
    return (
        F.when(not_applicable, "not_applicable").when(in_external, "in_external_doc").when(said_absent, "not_in_document")
        .when(referred, "in_external_doc").otherwise("extraction_failed")
    )


def errors_by_category(errors: DataFrame) -> DataFrame:
    """(category, n_errors, n_warnings, entities): failed entities by name, from errors only."""
    is_error = F.col("severity") != "warning"
    return errors.groupBy("category").agg(
        F.count_if(is_error).alias("n_errors"), F.count_if(~is_error).alias("n_warnings"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_error, F.col("entity")))), ",").alias("entities"),
    )


def counts_with_zeros(rows: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """(kind, n) of all kinds, zeros included, in one pass."""
    counts = rows.agg(*(F.count_if(F.col(column) == k).alias(k) for k in kinds))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n")) for k in kinds))).alias("x")).select("x.*")


def critic_score(words: DataFrame, *keys: str) -> DataFrame:
    """Mean score of a critic's words; 0.5 where it said none."""
    score = F
    for word, value in SCORES.items():
        score = score.when(F.col("word") == word, F.lit(value))
    return words.groupBy(*keys).agg(F.coalesce(F.avg(score), F.lit(0.5)).alias("score"))


def link_all(funds: DataFrame, tables: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc, fund, table) of each fund with each consolidated table of its document, but for the links that are there."""
    return funds.join(tables, "doc").select("doc", "fund", "table").join(relations, ["doc", "fund", "table"], "left_anti")


def unsearched(known: DataFrame, asked: DataFrame, most: int = 15) -> DataFrame:
    """(field, pages): the first known pages of each field that no question has searched yet."""
    left = known.join(asked, ["field", "page"], "left_anti")
    return left.groupBy("field").agg(F.slice(F.array_sort(F.collect_set("page")), 1, most).alias("pages"))


def umbrella_pages(planned: Column, noted: Column, n_pages: Column, most: int = 30, intro: int = 5, end: int = 15) -> Column:
    """The pages of a document that speak of the whole: planned ones if they are credible, else noted ones, else front and back.

    A plan is credible with 1 to ``most`` pages, fewer than nine tenths of the document, whose first and last as listed span no
    more than eight tenths of it.  More than ``most`` noted pages are cut to the first ``intro`` and the last others.
    Null lists count as empty.
    """
    none = F.expr("cast(array() as array<bigint>)")
    plan, notes = F.coalesce(planned.cast("array<bigint>"), none), F.array_sort(F.array_distinct(F.coalesce(noted.cast("array<bigint>"), none)))
    n = F.size(plan)
    span = F.element_at(plan, -1) - F.element_at(plan, 1) + 1
    credible = (n > 0) & (n <= most) & (n < n_pages * 0.9)
    cut = F.concat(F.slice(notes, 1, intro), F.slice(notes, -(most - intro), most - intro))
    front = F.when(n_pages > 0, F.sequence(F.lit(1).cast("long"), F.least(F.lit(intro), n_pages).cast("long"))).otherwise(none)
    start = F.greatest(n_pages - end + 1, F.lit(intro + 1))
    back = F.when(start <= n_pages, F.sequence(start.cast("long"), n_pages.cast("long"))).otherwise(none)
    found = F.when(F.size(notes) > most, cut).when(F.size(notes) > 0, notes).otherwise(F.array_sort(F.concat(front, back)))
    return F.when(credible, F.when(span <= n_pages * 0.8, F.array_sort(plan)).otherwise(found)).otherwise(found)


def normal_plan(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """Tasks (doc, ord, fund, ...) under canonical fund names (doc, name, canonical), of equal ones the first; names that
    have none stay."""
    told = tasks.join(names.groupBy("doc", F.col("name").alias("fund")).agg(F.min("canonical").alias("canonical")), ["doc", "fund"], "left")
    told = told.withColumn("fund", F.coalesce("canonical", "fund")).drop("canonical")
    rest = F.struct(*(c for c in tasks.columns if c not in ("doc", "fund")))
    first = told.groupBy("doc", "fund").agg(F.min_by(rest, "ord").alias("x"))
    return first.select("doc", "fund", "x.*").select(*tasks.columns)
