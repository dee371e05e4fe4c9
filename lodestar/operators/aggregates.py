"""Counts, distributions, trends and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import window_counts
from ..sources.shared import few, staged
from .joins import direction_cross, people_left_university, people_with_university


def overview(people: DataFrame, universities: DataFrame, log: DataFrame, areas: str = "department") -> DataFrame:
    """One row of six figures; "total985" counts universities whose tier doesn't hold 211."""
    p = people.agg(F.count("*").alias("total_people"), F.count_distinct("university").alias("total_universities"), F.count_distinct(areas).alias("total_areas"))
    u = universities.agg(F.count_if(~F.contains(F.coalesce("tier", F.lit("")), F.lit("211"))).alias("total985"))
    m = people_with_university(people, universities).agg(F.count_distinct("university").alias("matched_universities"))
    return p.crossJoin(u).crossJoin(m).crossJoin(log.agg(F.count("*").alias("total_logs")))  # four rows of one


def distribution(people: DataFrame, universities: DataFrame, n: int) -> DataFrame:
    """People per university with its tier, the n largest, ties by name."""
    counts = people.groupBy("university").agg(F.count("*").alias("n"))
    return people_left_university(counts, universities).orderBy(F.desc("n"), "university").limit(n)


def tier_counts(people: DataFrame, universities: DataFrame) -> DataFrame:
    """People of known universities per tier."""
    counts = people.groupBy("university").agg(F.count("*").alias("n"))
    return people_with_university(counts, universities).groupBy("tier").agg(F.sum("n").alias("n"))


def area_heat(people: DataFrame, terms: DataFrame, n: int, id_col: str = "id", text_col: str = "areas") -> DataFrame:
    """People per direction, each once, the n largest; directions nobody has don't appear."""
    return direction_cross(people, terms, id_col, text_col).groupBy("direction").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "direction").limit(n)


def area_trend(people: DataFrame, years: DataFrame, terms: DataFrame, low: int, high: int, n: int = 10, text_col: str = "areas") -> DataFrame:
    """Active people (w > 0) per direction and year as a zero-filled array; directions that never reach 2 go; the n largest totals stay."""
    active = years.where((F.col("w") > 0) & F.col("y").between(low, high)).select("id", "y").distinct()
    counts = direction_cross(people, terms, "id", text_col).join(active, "id").groupBy("direction", "y").agg(F.count_distinct("id").alias("n"))
    by_year = counts.groupBy("direction").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("m"), F.sum("n").alias("total"), F.max("n").alias("most"))
    series = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda y: F.coalesce(F.try_element_at("m", y), F.lit(0)))
    return by_year.where("most >= 2").select("direction", series.alias("series"), "total").orderBy(F.desc("total"), "direction").limit(n)


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def count_matching(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows meet a condition, regardless of any limit."""
    return df.where(condition).agg(F.count("*").alias("n"))


def crawl_jobs(people: DataFrame, active: DataFrame, n: int) -> DataFrame:
    """Per university count and last time; those still running come first (with 0 if they have no rows), then the newest, n in all."""
    done = people.groupBy("university").agg(F.count("*").alias("n"), F.max("scraped_at").alias("last"))
    met = done.join(active.select("university", F.lit(True).alias("running")).distinct(), "university", "full")
    status = F.when(F.col("running"), "RUNNING").otherwise("DONE")
    rows = met.select("university", F.coalesce("n", F.lit(0)).alias("n"), "last", status.alias("status"))
    return rows.orderBy(F.when((F.col("status") == "RUNNING") & (F.col("n") == 0), 0).otherwise(1), F.desc_nulls_last("last"), "university").limit(n)


def url_check_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def doc_freq(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, df) over the distinct terms of each document."""
    return docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(docs: DataFrame, terms: str = "terms", top: int = 5000) -> DataFrame:
    """idf = ln((N + 1) / (df + 1)) + 1 of the ``top`` most frequent terms, ties by term; N counts all rows, empty ones too."""
    total = docs.agg(F.count("*").alias("total"))
    chosen = doc_freq(docs, terms).orderBy(F.desc("df"), "term").limit(top)
    return chosen.crossJoin(F.broadcast(total)).select("term", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def window_idf(docs: DataFrame, text_col: str, id_col: str = "id", top: int = 5000) -> DataFrame:
    """:func:`idf` of the terms that ``tokenize_windows`` gives for a text; ids are unique.

    Terms are counted in tasks, many texts at once, and only counts are shuffled. Long whole texts, which are terms too, are counted by digest; those
    frequent enough to be among the chosen are read again.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    lowered = rows.select("id", F.lower("text").alias("text"), F.lower(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("whole"))
    found = lowered.mapInArrow(window_counts, f"term string, digest binary, id {lowered.schema['id'].dataType.simpleString()}, df long")
    counts = staged(found.groupBy("term", "digest").agg(F.sum("df").alias("df"), F.min("id").alias("id")), "windows")
    best = staged(counts.where("term is not null").select("term", "df").orderBy(F.desc("df"), "term").limit(top), "best")
    n, least = best.agg(F.count("*"), F.min("df")).first()
    long = counts.where("term is null").where(F.col("df") >= (least if n == top else 1)).select("id", "df")
    wholes = lowered.select("id", "whole").join(few(staged(long, "long")), "id").select(F.col("whole").alias("term"), "df")
    chosen = best.union(wholes).orderBy(F.desc("df"), "term").limit(top)
    total = docs.agg(F.count("*").alias("total"))
    return chosen.crossJoin(F.broadcast(total)).select("term", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def selection_signal(selections: DataFrame, bucket: str) -> DataFrame:
    return selections.where(F.col("gpa_bucket") == bucket).groupBy("advisor_id").agg(F.count("*").alias("cnt"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def com_flags(departments: DataFrame, strong=("strong", "mix_ds", "cas_mix")) -> DataFrame:
    """has_strong: any department is; all_weak: there are departments and none is."""
    flag = F.coalesce(F.col("com_status").isin(*strong), F.lit(False))
    return departments.groupBy("univ_name").agg(F.bool_or(flag).alias("has_strong"), F.bool_and(~flag).alias("all_weak"))


def notice_digest(notices: DataFrame, per: int = 8, order=("seq",)) -> DataFrame:
    """Per university and category the total and the first ``per`` notices as an array."""
    w = Window.partitionBy("university", "category")
    first = notices.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("__in", F.col("__n") <= per)
    return first.groupBy("university", "category").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("__in"), F.struct("__n", "title")))).alias("__items")).select("university", "category", "total", F.transform("__items", lambda s: s["title"]).alias("items"))


def message_counts(turns: DataFrame, conv: str = "conv_id", time: str = "turn") -> DataFrame:
    return turns.groupBy(conv).agg(F.count("*").alias("message_count"), F.max(time).alias("updated_at"))


def import_summary(actions: DataFrame) -> DataFrame:
    """Counts of the actions of an import."""
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("imported", "updated", "skipped")])


def conversation_detail(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations with their messages as one ordered array."""
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return conversations.join(nested, "conv_id", "left")


def conversation_list(turns: DataFrame) -> DataFrame:
    return message_counts(turns).orderBy(F.desc("updated_at"), "conv_id")
