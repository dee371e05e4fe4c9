"""Filtered lists: optional predicates folded into one condition, an order and a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import all_of, any_of, has
from .joins import nest_departments
from .windows import case_rank


def search_people(people: DataFrame, limit: int = 500, **wanted: str | None) -> DataFrame:
    """Substring filters on the columns named, those that are given; by university, name and id."""
    return people.where(all_of(*[has(c, v) for c, v in wanted.items() if v])).orderBy("university", "name", "id").limit(limit)


def search_notices(notices: DataFrame, university: str | None = None, category: str | None = None, q: str | None = None, limit: int = 1000) -> DataFrame:
    """Substring on the university, equality on the category, q in title, snippet or source; admission before experience before teacher before others, then the newest."""
    conditions = [has("university", university) if university else None, F.col("category") == category if category else None]
    if q:
        conditions.append(any_of(*[F.coalesce(has(c, q), F.lit(False)) for c in ("title", "snippet", "source")]))
    rank = case_rank("category", ["admission", "experience", "teacher"])
    return notices.where(all_of(*conditions)).orderBy(rank, F.desc("published_at"), "url").limit(limit)


def filter_universities(universities: DataFrame, departments: DataFrame, tier: str | None = None, province: str | None = None, com: str | None = None, q: str | None = None) -> DataFrame:
    """Universities with nested departments; ``com`` is hasStrong or allWeak, q may be in name, province, a department's name or the note; by rank and name."""
    nested = nest_departments(universities, departments)
    strong = lambda d: F.coalesce(d["c"].isin("strong", "mix_ds", "cas_mix"), F.lit(False))
    conditions = [F.col("tier") == tier if tier else None, F.col("province") == province if province else None]
    if com == "hasStrong":
        conditions.append(F.exists("departments", strong))
    if com == "allWeak":
        conditions.append((F.size("departments") > 0) & ~F.exists("departments", strong))
    if q:
        names = F.array_join(F.transform("departments", lambda d: d["n"]), "\n")
        conditions.append(any_of(*[F.coalesce(has(c, q), F.lit(False)) for c in (F.col("name"), F.col("province"), names, F.col("note"))]))
    return order_universities(nested.where(all_of(*conditions)))


def order_universities(universities: DataFrame) -> DataFrame:
    return universities.orderBy("rank", "name")


def directory_panels(universities: DataFrame, departments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Universities with departments, and those without."""
    nested = nest_departments(universities, departments)
    return order_universities(nested.where(F.size("departments") > 0)), order_universities(nested.where(F.size("departments") == 0).drop("departments"))


def url_check_filter(checks: DataFrame, ok: bool | None = None) -> DataFrame:
    rows = checks if ok is None else checks.where(F.col("ok") == ok)
    return rows.orderBy("university", "department", "id")


def list_questions(questions: DataFrame, category: str | None = None, limit: int = 100) -> DataFrame:
    rows = questions.where(F.col("category") == category) if category else questions
    return rows.orderBy("id").limit(limit)


def practice_history(records: DataFrame, user: int, limit: int = 50) -> DataFrame:
    """A user's newest records."""
    return records.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
