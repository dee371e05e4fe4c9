"""Ranked rows, decayed interests, retention, cascades, paging and set operations."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.text import pack_terms, session_terms, unpack_terms
from ..sources.shared import staged


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return top_k_per_group(df, keys, order, 1)


def top_k_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the order should end with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def top_k_per_query(df: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    return top_k_per_group(df, ["query_id"], [F.desc(score), id_col], k)


def score_floor_topk(df: DataFrame, floor: float, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """Rows over the floor, the k best of each query."""
    return top_k_per_query(df.where(F.col(score) > floor), k, score, id_col)


def session_term_counts(docs: DataFrame, text_col: str = "areas", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, n): how often each document has each session term, of two characters or more. Dealt by document, so its terms stay in one task."""
    return docs.select(F.col(id_col).alias("doc_id"), text_col).repartition("doc_id").select("doc_id", F.explode(session_terms(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def session_lines(docs: DataFrame, text_col: str = "areas", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lines): the session terms of each document that has any, one to a line, as they come; none holds a line feed."""
    return docs.select(F.col(id_col).alias("doc_id"), F.array_join(session_terms(F.col(text_col)), "\n").alias("lines")).where("lines <> ''")


def decayed_terms(events: DataFrame, decay: float = 0.8, key: str = "session_id", order=("ts", "event_id"), counts: DataFrame | None = None, lines: DataFrame | None = None, packed: DataFrame | None = None) -> DataFrame:
    """(session, term, weight): the i-th newest event weighs decay**i, summed per term; blank areas count as events.

    Events bring their text as ``areas``; or, with ``counts`` (:func:`session_term_counts`), ``lines`` (:func:`session_lines`) or ``packed``
    (:func:`packed_terms`), the doc_id of a text that is cut only once. Lines and packed terms travel to their sessions whole, so no row of a
    single term is shuffled; packed ones are summed session by session in tasks, so a task holds the terms of one session.
    """
    if packed is not None:
        rows = session_rows(event_shares(events, decay, key, order).join(packed.hint("merge"), "doc_id").select(key, "share", "packed"), key)
        schema = StructType([events.schema[key], StructField("term", StringType()), StructField("weight", DoubleType())])
        return rows.mapInArrow(handed(schema, _weight_rows), schema)
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    aged = events.withColumn("age", F.row_number().over(w) - 1)
    if lines is not None:
        shares = aged.groupBy(key, "doc_id").agg(F.sum(F.pow(F.lit(decay), "age")).alias("share"))
        dealt = shares.join(lines, "doc_id").repartition(key)
        return dealt.select(key, "share", F.explode(F.split("lines", "\n")).alias("term")).groupBy(key, "term").agg(F.sum("share").alias("weight"))
    if counts is not None:
        shares = aged.groupBy(key, "doc_id").agg(F.sum(F.pow(F.lit(decay), "age")).alias("share"))
        return shares.join(counts, "doc_id").groupBy(key, "term").agg(F.sum(F.col("share") * F.col("n")).alias("weight"))
    spread = aged.select(key, "age", F.explode(session_terms(F.col("areas"))).alias("term"))
    return spread.groupBy(key, "term").agg(F.sum(F.pow(F.lit(decay), "age")).alias("weight"))


def packed_terms(docs: DataFrame, text_col: str = "areas", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, packed, blank): the session terms of each document, packed, null without any, and whether the text is null or all spaces.

    Size estimates don't fit packed terms, so joins with them are hinted not to broadcast; no filter is put on them, as it would pack twice.
    """
    blank = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    return docs.select(F.col(id_col).alias("doc_id"), pack_terms(F.col(text_col)).alias("packed"), blank.alias("blank"))


def event_shares(events: DataFrame, decay: float = 0.8, key: str = "session_id", order=("ts", "event_id")) -> DataFrame:
    """(session, doc_id, share): what a session's events on a document weigh together, decay**i for the i-th newest."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("age", F.row_number().over(w) - 1).groupBy(key, "doc_id").agg(F.sum(F.pow(F.lit(decay), "age")).alias("share"))


def session_rows(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows dealt by session, those of a session in a row."""
    return rows.repartition(key).sortWithinPartitions(key)


def sessions(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one session after another; the first column names the session."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def term_weights(shares: Iterable[tuple[float, bytes | None]]) -> dict[str, float]:
    """Shares times counts, summed by term."""
    weights: dict[str, float] = defaultdict(float)
    for share, packed in shares:
        for n, terms in unpack_terms(packed):
            for term in terms:
                weights[term] += share * n
    return weights


def liked_terms(shares: DataFrame, packed: DataFrame, n: int, key: str = "session_id") -> DataFrame:
    """(session, terms): the n terms that weigh most in each session, by weight rounded to 6 places, ties by term; sessions without terms have none.

    ``shares`` is as :func:`event_shares` makes it. Sessions are summed in tasks, so the weights of all terms are never rows.
    """
    schema = StructType([shares.schema[key], StructField("terms", ArrayType(StringType()))])
    rows = session_rows(shares.join(packed.hint("merge"), "doc_id").select(key, "share", "packed"), key)
    return rows.mapInArrow(handed(schema, lambda x: _best_terms(x, n)), schema)


#: Rows that a task hands on at once.
HANDED = 50_000


def handed(schema: StructType, rows_of: Callable[[list[tuple]], Iterable[tuple]]):
    """For mapInArrow: what ``rows_of`` makes of the rows of each session, some sessions at once."""
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], [name for name, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for rows in sessions(batches):
            made += rows_of(rows)
            if len(made) >= HANDED:
                yield table(made)
                made = []
        if made:
            yield table(made)

    return run


def _weight_rows(rows: list[tuple]) -> Iterable[tuple]:
    key = rows[0][0]
    return [(key, term, weight) for term, weight in term_weights(r[1:] for r in rows).items()]


def _best_terms(rows: list[tuple], n: int) -> Iterable[tuple]:
    weights = term_weights(r[1:] for r in rows)
    if not weights:
        return []
    least = min(nlargest(n, weights.values())) - 1e-6
    best = sorted((-round(weight, 6), term) for term, weight in weights.items() if weight >= least)
    return [(rows[0][0], [term for _, term in best[:n]])]


def last_n(events: DataFrame, n: int = 20, key: str = "session_id", order=("ts", "event_id")) -> DataFrame:
    return top_k_per_group(events, [key], [F.desc(c) for c in order], n)


def retain_newest(conversations: DataFrame, turns: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The n conversations updated last, and their turns."""
    kept = conversations.orderBy(F.desc("updated_at"), "conv_id").limit(n)
    return kept, turns.join(kept.select("conv_id"), "conv_id", "left_semi")


def context_window(turns: DataFrame, n: int = 16) -> DataFrame:
    """The last n turns of each conversation."""
    return top_k_per_group(turns, ["conv_id"], [F.desc("turn"), F.desc("role"), F.desc("text")], n)


def last_versions(df: DataFrame, n: int = 5, by: str = "type", order: str = "seq") -> DataFrame:
    """The newest n versions of each type, numbered from 1, the newest first."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("version", F.row_number().over(w)).where(F.col("version") <= n)


def event_history(events: DataFrame, n: int = 100, order=("ts", "event_id")) -> DataFrame:
    """The last n events with a sequence number from 1, the newest highest."""
    newest = events.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.withColumn("seq", F.row_number().over(Window.orderBy(*order)))  # a window over n rows


def max_normalize(df: DataFrame, column: str, out: str) -> DataFrame:
    """Divides by the largest value, if that is over 0."""
    most = df.agg(F.max(column).alias("__most"))
    return df.crossJoin(F.broadcast(most)).withColumn(out, F.when(F.col("__most") > 0, F.col(column) / F.col("__most")).otherwise(F.lit(0.0))).drop("__most")


@dataclass(frozen=True)
class Source:
    """A source of a cascade: it is used for a group only if the rows that ``counts`` gained there so far (all before it, if
    None) are fewer than ``below`` (None: always); ``cap`` bounds what it gives to a group."""

    name: str
    below: int | None = None
    counts: tuple[str, ...] | None = None
    cap: int | None = None


def coverage_cascade(rows: DataFrame, policy: list[Source], group: str = "university", source: str = "source", keys: tuple[str, ...] = ("name",), order: str = "seq") -> DataFrame:
    """Rows of sources in the order of the policy, each used only while a group isn't covered yet.

    Rows are unique by group and keys: a source gains what the ones before it in the policy don't have. One pass
    narrows rows to candidates: within a source the first of each key, then only keys of no source that was used. As what is
    used depends on counts so far, the policy's few steps run one after another over ever fewer rows.
    """
    rank = F.create_map(*[x for i, s in enumerate(policy) for x in (F.lit(s.name), F.lit(i))])
    ranked = rows.withColumn("__rank", rank[F.col(source)]).where("__rank is not null")
    taken = None
    for i, step in enumerate(policy):
        mine = keep_first(ranked.where(F.col("__rank") == i), [group, *keys], [order])
        if taken is not None:
            if step.below is not None:
                counted = taken if step.counts is None else taken.where(F.col(source).isin(*step.counts))
                gained = counted.groupBy(group).agg(F.count("*").alias("__gained"))
                mine = mine.join(gained, group, "left").where(F.coalesce("__gained", F.lit(0)) < step.below).drop("__gained")
            mine = mine.join(taken.select(group, *keys), [group, *keys], "left_anti")
        if step.cap is not None:
            mine = top_k_per_group(mine, [group], [order], step.cap)
        mine = staged(mine.select(*rows.columns), "cascade")  # else each step would compute all steps before it again, three times
        taken = mine if taken is None else taken.unionByName(mine)
    return taken


def search_universities(universities: DataFrame, departments: DataFrame, q: str) -> DataFrame:
    """Universities whose name or note, or the name of one of whose departments, holds q; the other half of a global search."""
    holds = lambda c: F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(q))
    by_department = departments.where(holds("dept_name")).select(F.col("univ_name").alias("name"), F.lit(True).alias("__hit")).distinct()
    return universities.join(by_department, "name", "left").where(holds("name") | holds("note") | F.col("__hit").isNotNull()).select(*universities.columns)


def page(df: DataFrame, order: list, offset: int, limit: int, most: int = 200, total_cap: int = 500) -> DataFrame:
    """One page, with the count of all rows up to a cap."""
    total = df.limit(total_cap).agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).limit(total_cap).offset(offset).limit(min(limit, most))
    return rows.crossJoin(F.broadcast(total))


def case_rank(column: str, values: list[str]) -> Column:
    """The position of a value in a list; others come last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def url_score(url: Column, faculty: str = "szdw|jsdw|faculty|teacher|people|staff", whole: str = "qbjs|all|list", sibling: str = "js|fjs|jiaoshou", api: str = "api|ajax|json") -> Column:
    """0 to 100: 30 for a faculty path, 20 for a page of all staff, 15 for a sibling category, 25 for an interface, 10 for a depth of 2 to 4, 5 for .htm or .html."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    points = [(path.rlike(faculty), 30), (path.rlike(rf"(?:^|/)(?:{whole})(?:[/._]|$)"), 20), (path.rlike(rf"(?:^|/)(?:{sibling})(?:[/._]|$)"), 15), (path.rlike(api), 25), (depth.between(2, 4), 10), (path.rlike(r"\.html?$"), 5)]
    return F.least(F.lit(100), sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0)))


def rank_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.withColumn("score", url_score(F.col(url_col))).orderBy(F.desc("score"), url_col)


def union_sources(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds with their name; columns that one lacks are null."""
    out = None
    for name, df in feeds.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def global_search(people: DataFrame, q: str, areas: str = "department", n: int = 30) -> DataFrame:
    """People whose name, else areas, else university hold q: one row per profile_url by the first kind of hit, n at most, with the total."""
    from ..functions.predicates import has

    kind = F.when(has("name", q), 1).when(has(areas, q), 2).when(has("university", q), 3)
    hits = people.withColumn("kind", kind).where("kind is not null")
    one = keep_first(hits, ["profile_url"], ["kind", "id"])
    total = one.agg(F.count("*").alias("total"))
    return one.orderBy("kind", "id").limit(n).crossJoin(F.broadcast(total))
