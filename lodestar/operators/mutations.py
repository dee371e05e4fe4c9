"""Table changes as batch transforms: (existing, incoming) -> new table. ``seq`` is a total order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from .windows import keep_first


def _stamped(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    old = existing if "seq" in existing.columns else existing.withColumn("seq", F.lit(-1).cast("long"))
    return old.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)


def upsert_people(existing: DataFrame, incoming: DataFrame, last=("title", "areas", "email"), coalesced=("lab_name",), exact: bool = False) -> DataFrame:
    """Rows of a (name, university) that is there already are skipped; rows that share a profile_url become one.

    Of these the first keeps name and university, the columns of ``last`` come from the last, those of ``coalesced`` from the
    last that isn't null. Set-based: the first row of each person, then one row per url. That differs from taking row after row
    only if a person whose first row went to another's url appears again; with ``exact`` it doesn't (:func:`stored_first`),
    and rows without a name, a university or a url are never the same as others.
    """
    rows = _stamped(existing, incoming)
    order = F.struct("__new", "seq")
    url = ["profile_url"]
    if exact:
        nameless, unlinked = F.col("name").isNull() | F.col("university").isNull(), F.col("profile_url").isNull()
        rows = rows.withColumn("__alone", F.concat(F.lit("row "), F.monotonically_increasing_id())).withColumn("__order", F.struct("__new", "seq", "__alone"))
        rows = rows.withColumn("__person", F.when(nameless, F.struct(F.col("__alone").alias("a"), F.lit("").alias("b"))).otherwise(F.struct(F.col("name").alias("a"), F.col("university").alias("b"))))
        rows = staged(rows.withColumn("__url", F.when(unlinked, F.col("__alone")).otherwise(F.concat(F.lit("u"), "profile_url"))), "people")
        known = stored_first(rows.select("__order", F.col("__person").alias("a"), F.col("__url").alias("b")))
        rows = rows.join(known.select(F.col("a").alias("__person"), F.col("__order").alias("__stored")), "__person", "left").where("__stored is null or __order <= __stored")
        order, url = F.col("__order"), ["__url", "profile_url"]
    else:
        rows = keep_first(rows, ["name", "university"], ["__new", "seq"])
    have = set(rows.columns)
    agg = [F.min_by("name", order).alias("name"), F.min_by("university", order).alias("university")]
    agg += [F.max_by(c, order).alias(c) for c in last if c in have]
    agg += [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in coalesced if c in have]
    return rows.groupBy(*url).agg(*agg).drop("__url")


#: Rows that are left over are decided in one task when they are no more than this.
LEFT_OVER = 50_000


def stored_first(rows: DataFrame) -> DataFrame:
    """Of rows (__order, a, b), taken one after another, those that bring both a new a and a new b.

    Each round finds the rows that come first of their a and first of their b: nothing before them can take either, so they
    are stored, and all others of the same a or b never are. Few rows are left after a round, as a row stays only if what
    kept it waiting fell out itself; when as many as fit a task are left, that takes them in order. No group of rows is gathered.
    """
    spark, left, out = rows.sparkSession, rows, None
    while True:
        first_a = left.groupBy("a").agg(F.min(F.struct("__order", "b")).alias("x")).select("a", "x.b", "x.__order")
        first_b = left.groupBy("b").agg(F.min(F.struct("__order", "a")).alias("x")).select("x.a", "b", "x.__order")
        found = staged(first_a.join(first_b, ["a", "b", "__order"]), "stored")
        out = found if out is None else out.union(found)
        left = staged(left.join(found.select("a"), "a", "left_anti").join(found.select("b"), "b", "left_anti"), "left")
        n = left.limit(LEFT_OVER + 1).count()
        if n == 0:
            return out
        if n <= LEFT_OVER:
            schema = left.schema
            names = [f.name for f in schema]
            taken, a_seen, b_seen = [], set(), set()
            for r in sorted(left.collect(), key=lambda r: r["__order"]):
                if r["a"] not in a_seen and r["b"] not in b_seen:
                    taken.append(tuple(r[c] for c in names))
                    a_seen.add(r["a"])
                    b_seen.add(r["b"])
            return out.unionByName(spark.createDataFrame(taken, schema))


def upsert_notices(existing: DataFrame, incoming: DataFrame, coalesced=("extra_json",)) -> DataFrame:
    """By url the last row; extra_json is the last that isn't null; rows with a blank url are rejected."""
    rows = _stamped(existing, incoming).where(F.trim(F.coalesce("url", F.lit(""))) != "")
    order = F.struct("__new", "seq")
    others = [c for c in rows.columns if c not in ("url", "__new", *coalesced)]
    return rows.groupBy("url").agg(*[F.max_by(c, order).alias(c) for c in others], *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in coalesced])


def upsert_profile(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One document per user, the last."""
    rows = _stamped(existing, incoming)
    return rows.groupBy("user_id").agg(F.max_by("profile_json", F.struct("__new", "seq")).alias("profile_json"))


def mark_done(progress: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds (user_id, question_id) once; the earlier done_at stays."""
    return progress.unionByName(marks).groupBy("user_id", "question_id").agg(F.min("done_at").alias("done_at"))


def unmark_done(progress: DataFrame, marks: DataFrame) -> DataFrame:
    return progress.join(marks.select("user_id", "question_id"), ["user_id", "question_id"], "left_anti")


def clear_progress(progress: DataFrame, users: DataFrame) -> DataFrame:
    return progress.join(users.select("user_id"), "user_id", "left_anti")


def import_questions(existing: DataFrame, incoming: DataFrame, mode: str = "skip", dedupe: bool = False) -> DataFrame:
    """``skip`` appends all rows; ``overwrite`` updates category and hint of an equal question, else appends; ``replace_all``
    drops all but built-in questions first. ``dedupe`` makes ``skip`` leave out questions that are there."""
    columns = existing.columns
    if mode == "replace_all":
        return existing.where("source = 'builtin'").unionByName(incoming.select(*columns))
    if mode == "overwrite":
        new = incoming.groupBy("question").agg(*[F.max_by(c, "seq").alias(f"__{c}") for c in columns if c not in ("question", "seq")]) if "seq" in incoming.columns else incoming.select("question", *[F.col(c).alias(f"__{c}") for c in columns if c != "question"]).dropDuplicates(["question"])
        updated = existing.join(new, "question", "left")
        pick = lambda c: F.coalesce(f"__{c}", c).alias(c) if c in ("category", "hint") else F.col(c)
        kept = updated.select(*[pick(c) for c in columns])
        fresh = incoming.join(existing.select("question"), "question", "left_anti")
        return kept.unionByName(fresh.select(*columns))
    rows = incoming.join(existing.select("question"), "question", "left_anti").dropDuplicates(["question"]) if dedupe else incoming
    return existing.unionByName(rows.select(*columns))


def partial_update(df: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """coalesce(new, old) for each column of the patch, by id."""
    changed = [c for c in patch.columns if c != key]
    new = patch.select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    return df.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in df.columns])


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def delete_conversations(conversations: DataFrame, turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the conversations named."""
    return delete_ids(conversations, ids, "conv_id"), delete_ids(turns, ids, "conv_id")


#: The most steps of a history that come together in one array.
STEPS = 1024

_COMPOSED = """aggregate(runs, named_struct('d', 0D, 'lo', double('-Infinity'), 'hi', double('Infinity')), (a, r) -> named_struct(
    'd', a.d + r.d, 'lo', least(r.hi, greatest(r.lo, a.lo + r.d)), 'hi', least(r.hi, greatest(r.lo, a.hi + r.d))))"""


def apply_feedback(feedback: DataFrame, up: float = 0.02, down: float = 0.01, start: float = 0.5) -> DataFrame:
    """(id, score): from ``start`` up or down with each step in order of seq, kept between 0 and 1 after each.

    A run of steps is x -> min(hi, max(lo, x + d)), and such runs compose. Rows are sorted by id and seq over all tasks and
    numbered; each STEPS neighbours of an id become one run, and so on with the runs until every id has few. So no id's
    history comes together, whether its steps are close in seq or far apart.
    """
    d = F.when(F.col("positive"), F.lit(up)).otherwise(F.lit(-down))
    runs = feedback.select("id", F.col("seq").alias("at"), d.alias("d"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    whole = F.expr(_COMPOSED)
    while True:
        numbered = runs.repartitionByRange("id", "at").sortWithinPartitions("id", "at").withColumn("part", F.floor(F.monotonically_increasing_id() / STEPS))
        parts = numbered.groupBy("id", "part").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "d", "lo", "hi"))).alias("runs"))
        runs = staged(parts.select("id", "at", whole.alias("run")).select("id", "at", "run.*"), "runs")
        if (runs.groupBy("id").count().agg(F.max("count")).first()[0] or 0) <= STEPS:
            break
    last = runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "d", "lo", "hi"))).alias("runs")).select("id", whole.alias("run"))
    return last.select("id", F.least("run.hi", F.greatest("run.lo", F.lit(start) + F.col("run.d"))).alias("score"))


def rebuild_scores(people: DataFrame) -> DataFrame:
    """reputation_score = min(1, 0.5 * pr + 0.3 * activity / 100 + 0.2 * venue_a / 20)."""
    return people.withColumn("reputation_score", F.least(F.lit(1.0), 0.5 * F.col("pr") + 0.3 * F.col("activity") / 100 + 0.2 * F.col("venue_a") / 20))


def toggle_set(events: DataFrame, keys: tuple[str, ...] = ("name", "university")) -> DataFrame:
    """Members after (keys, seq, action): ``toggle`` flips, ``remove`` clears. Newest first."""
    cleared = events.where("action = 'remove'").groupBy(*keys).agg(F.max("seq").alias("__cleared"))
    later = events.where("action = 'toggle'").join(cleared, list(keys), "left").where("__cleared is null or seq > __cleared")
    return later.groupBy(*keys).agg(F.count("*").alias("__n"), F.max("seq").alias("seq")).where("__n % 2 = 1").drop("__n").orderBy(F.desc("seq"), *keys)


def append_validated(existing: DataFrame, rows: DataFrame, required: list[str], any_of: list[str] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """Appends rows whose required columns, and one of ``any_of``, aren't blank; blank text becomes null or the default."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    good = rows
    for c in required:
        good = good.where(~blank(c))
    if any_of:
        some = F.lit(False)
        for c in any_of:
            some |= ~blank(c)
        good = good.where(some)
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    good = good.select(*[F.coalesce(F.when(~blank(c), F.col(c)), F.lit((defaults or {}).get(c))).alias(c) if c in texts else F.col(c) for c in rows.columns])
    return existing.unionByName(good.select(*existing.columns))
