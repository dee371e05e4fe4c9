"""Joins of people, institutions, terms and links. Sides are left to the optimizer; a dictionary argument is small by contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams
from ..sources.shared import few, fits, staged


def people_with_university(people: DataFrame, universities: DataFrame) -> DataFrame:
    """People of known universities, with rank and tier."""
    dim = universities.select(F.col("name").alias("university"), "rank", "tier")
    return people.join(dim, "university")


def people_left_university(people: DataFrame, universities: DataFrame) -> DataFrame:
    """All people; tier is null for an unknown university."""
    return people.join(universities.select(F.col("name").alias("university"), "tier"), "university", "left")


def restrict_to_tiers(df: DataFrame, universities: DataFrame, tiers: list[str], key: str = "university") -> DataFrame:
    """Rows whose university has one of the tiers; no tiers, no rows."""
    chosen = universities.where(F.col("tier").isin(*tiers)) if tiers else universities.limit(0)
    return df.join(chosen.select(F.col("name").alias(key)), key, "left_semi")


def uncrawled_universities(universities: DataFrame, people: DataFrame, tiers: list[str], n: int, first: int = 50) -> DataFrame:
    """Of the ``first`` best-ranked universities of the tiers, those without people, n at most, in order of rank."""
    chosen = universities.where(F.col("tier").isin(*tiers)) if tiers else universities.limit(0)
    top = chosen.orderBy("rank", "name").limit(first)
    return top.join(people.select(F.col("university").alias("name")), "name", "left_anti").orderBy("rank", "name").limit(n)


def nest_departments(universities: DataFrame, departments: DataFrame) -> DataFrame:
    """Universities with their departments as an ordered array of (n, c); an empty one if there are none."""
    nested = departments.groupBy(F.col("univ_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col("dept_name").alias("n"), F.col("com_status").alias("c")))).alias("departments"))
    empty = F.array().cast("array<struct<n:string,c:string>>")
    return universities.join(nested, "name", "left").withColumn("departments", F.coalesce("departments", empty))


def recall_join(query_terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, term) with postings (doc_id, term, tf), on the term."""
    return query_terms.join(postings, "term")


#: A block of more terms than this is cut into parts, each met by a copy of the terms that look there.
HOT = 10_000
#: So many query terms are searched for in every term; more meet them under rare 3-grams.
SCANNED = 32


def contained_terms(queries: DataFrame, vocabulary: DataFrame, both_ways: bool = True) -> DataFrame:
    """Pairs (q, term) of distinct query terms and vocabulary terms where one holds the other.

    A term meets longer ones under its rarest 3-gram (a term of two characters: under itself), which they all hold, so blocks
    are those of rare grams; no pair of all terms is formed. Terms of one character only meet terms that are the same, but
    query terms that hold them. ``both_ways=False`` finds only terms that hold q.

    Up to SCANNED query terms are looked for in each term where it lies, so terms, which may be whole texts, travel for no pair.
    """
    q = staged(queries.select("q").where("q is not null").distinct(), "asked")
    few_q = q.limit(SCANNED + 1).collect()
    if len(few_q) <= SCANNED:
        return _scanned(sorted(r["q"] for r in few_q), vocabulary.select("term").where("term <> ''").distinct(), both_ways)
    v = staged(vocabulary.select("term").where("term is not null").distinct(), "terms")
    held = q.where("char_length(q) = 1").join(v.withColumn("q", F.col("term")), "q").select("q", "term")
    held = held.union(_inside(q.toDF("inner"), v.toDF("outer")).select(F.col("inner").alias("q"), F.col("outer").alias("term")))
    if both_ways:
        holds = _inside(v.toDF("inner"), q.toDF("outer")).select(F.col("outer").alias("q"), F.col("inner").alias("term"))
        # What is found both ways is found above, so no pair comes twice.
        holds = holds.where("q <> term")
        single = v.where("char_length(term) = 1").select("term", F.col("term").alias("char")).join(q.where("char_length(q) > 1").select("q", F.explode(F.array_distinct(F.split("q", ""))).alias("char")), "char").select("q", "term")
        held = held.union(holds).union(single)
    return held


def _scanned(queries: list[str], terms: DataFrame, both_ways: bool) -> DataFrame:
    """The pairs of some query terms and distinct terms, each of which is searched for all of them."""
    asked = F.array(*[F.lit(q) for q in queries if q]).cast("array<string>")
    term = F.col("term")

    def met(q: Column) -> Column:
        held = ((F.char_length(q) > 1) & F.contains(term, q)) | (q == term)
        return held | F.contains(q, term) if both_ways else held

    return terms.select(F.explode(F.filter(asked, met)).alias("q"), "term")


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): pairs of distinct terms, the inner one of two characters or more, that the outer one holds."""
    inner = inner.where("char_length(inner) >= 2")
    least, most = inner.agg(F.min(F.char_length("inner")), F.count("*")).first()
    longest = outer.agg(F.max(F.char_length("outer"))).first()[0]
    if not most or not longest or longest < least:
        return inner.crossJoin(outer.limit(0))
    inner, outer = inner.where(F.char_length("inner") <= longest), outer.where(F.char_length("outer") >= least)
    own = F.array_distinct(F.when(F.char_length("inner") == 2, F.array("inner")).otherwise(ngrams(F.col("inner"), 3)))
    theirs = ngrams(F.col("outer"), 3) if least > 2 else F.concat(ngrams(F.col("outer"), 2), ngrams(F.col("outer"), 3))
    spread = outer.select("outer", F.explode(F.array_distinct(theirs)).alias("gram"))
    asked = inner.select("inner", F.size(own).alias("n"), F.explode(own).alias("gram"))
    sought = few(asked.select("gram").distinct())
    counts = spread.select("gram").join(sought, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("met"))
    best = asked.join(few(staged(counts, "grams")), "gram").groupBy("inner", "n").agg(F.count("*").alias("found"), F.min(F.struct("met", "gram")).alias("best"))
    # A term with a gram that no longer one has is in none.
    picks = staged(best.where("found = n").select("inner", "best.gram", F.ceil(F.col("best.met") / HOT).cast("int").alias("parts")), "picks")
    if fits(picks, "inner"):
        return spread.join(F.broadcast(picks), "gram").where("contains(outer, inner)").select("inner", "outer")
    hot = F.broadcast(picks.where("parts > 1").select("gram", "parts").distinct())  # at most 1 / HOT of all grams spread
    dealt = spread.join(hot, "gram", "left").withColumn("part", F.expr("pmod(hash(outer), coalesce(parts, 1))")).drop("parts")
    copied = picks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(copied, ["gram", "part"]).where("contains(outer, inner)").select("inner", "outer")


def longest_terms(terms: DataFrame, least: int = 3) -> DataFrame:
    """(id, term): the distinct terms of each id, of at least so many characters, that no longer term of the id holds.

    As :func:`~lodestar.functions.text.drop_substrings`, for ids of very many terms: a term meets those that have its first
    ``least`` characters somewhere, not all.
    """
    own = terms.select("id", "term").where(f"char_length(term) >= {least}").distinct()
    grams = F.explode(F.array_distinct(F.expr(f"transform(sequence(1, char_length(term) - {least - 1}), i -> substr(term, i, {least}))")))
    longer = own.select("id", F.col("term").alias("longer"), grams.alias("block"))
    inside = own.withColumn("block", F.left("term", F.lit(least))).join(longer, ["id", "block"]).where("char_length(longer) > char_length(term) and contains(longer, term)")
    return own.join(inside.select("id", "term").distinct(), ["id", "term"], "left_anti")


def like_recall(query_terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, hits): documents one of whose terms holds a query term, by way of the vocabulary."""
    found = contained_terms(query_terms.select(F.col("term").alias("q")), postings.select("term"), both_ways=False)
    per_term = query_terms.withColumnRenamed("term", "q").join(found, "q").join(postings, "term")
    return per_term.groupBy("query_id", "doc_id").agg(F.count_distinct("q").alias("hits"))


def link_name(df: DataFrame, dim: DataFrame, column: str = "name", default_tier: str = "双非", guess: Column | None = None) -> DataFrame:
    """Links a name to the first dimension row (position, name, tier) that equals it, else that holds it or is held by it.

    Distinct names meet the dimension by 2-gram blocks, so names of one character link only if equal. Unlinked rows get the
    default tier and, if ``guess`` is given, a guessed province.
    """
    d = dim.select("position", F.col("name").alias("linked"), F.col("tier").alias("linked_tier"))
    pairs = contained_terms(df.select(F.col(column).alias("q")), dim.select(F.col("name").alias("term")))
    met = pairs.join(d, F.col("term") == F.col("linked"))
    best = met.groupBy(F.col("q").alias(column)).agg(F.min(F.struct((F.col("linked") != F.col("q")).alias("inexact"), "position", "linked", "linked_tier")).alias("best"))
    out = df.join(best, column, "left").withColumn("linked", F.col("best.linked")).withColumn("tier", F.coalesce("best.linked_tier", F.lit(default_tier))).drop("best")
    return out.withColumn("province", F.when(F.col("linked").isNull(), guess)) if guess is not None else out


def affiliation_join(df: DataFrame, universities: DataFrame, org: str = "org") -> DataFrame:
    """Rows with universities (name, en_name) whose first two characters, or whose first English word of two letters or more, the organisation holds."""
    first_word = F.lower(F.element_at(F.split(F.coalesce("en_name", F.lit("")), " "), 1))
    keys = universities.select(F.col("name").alias("university"), F.left("name", F.lit(2)).alias("q")).union(universities.select("name", first_word.alias("q"))).where("char_length(q) >= 2")
    orgs = df.select(F.col(org).alias("__org"), F.lower(org).alias("term")).distinct()
    met = contained_terms(keys, orgs, both_ways=False).join(keys, "q").join(orgs, "term").select(F.col("__org").alias(org), "university").distinct()
    return df.join(met, org)


def lookup(df: DataFrame, dictionary: DataFrame, key: str, out: str, fallback: bool = True) -> DataFrame:
    """Adds the value of ``key`` in a dictionary (key, value); without one the key itself, or null."""
    d = dictionary.select(F.col("key").alias(key), F.col("value").alias("__value"))
    found = df.join(d, key, "left")
    return found.withColumn(out, F.coalesce("__value", F.col(key)) if fallback else F.col("__value")).drop("__value")


def backfill_lab(people: DataFrame, labs: DataFrame) -> DataFrame:
    """Fills an empty lab_name from labs (lab_id, lab_name, university, members); of several labs the first by id."""
    members = labs.select("lab_id", F.col("lab_name").alias("__lab"), "university", F.explode("members").alias("name"))
    first = members.groupBy("name", "university").agg(F.min_by("__lab", "lab_id").alias("__lab"))
    out = people.join(first, ["name", "university"], "left")
    return out.withColumn("lab_name", F.coalesce(F.nullif("lab_name", F.lit("")), "__lab")).select(*people.columns)


def not_yet_stored(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a stored one of the same keys."""
    return df.join(existing.select(*keys), keys, "left_anti")


#: Dictionaries of at most so many rows are folded into expressions, so that a text is read once; larger ones are joined.
FOLDED = 2000


def folded(df: DataFrame) -> list | None:
    """The rows of a small dictionary, in order; None if it has more than FOLDED."""
    rows = df.limit(FOLDED + 1).collect()
    return sorted(rows) if len(rows) <= FOLDED else None


def mentions(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, word): which of the distinct words each text of (id, text) holds, as they are written."""
    words = words.select("word").where("word is not null and word <> ''").distinct()
    small = folded(words)
    if small is not None:
        held = F.filter(F.array(*[F.lit(r["word"]) for r in small]).cast("array<string>"), lambda w: F.contains(F.coalesce("text", F.lit("")), w))
        return texts.select("id", F.explode(held).alias("word"))
    one = texts.select("id", F.explode(F.array_distinct(F.split("text", ""))).alias("word")).join(words.where("char_length(word) = 1"), "word").select("id", "word")
    longer = _inside(words.select(F.col("word").alias("inner")), texts.select(F.col("text").alias("outer")).where("text is not null").distinct())
    return one.union(texts.join(longer.toDF("word", "text"), "text").select("id", "word")).distinct()


def direction_cross(people: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "areas") -> DataFrame:
    """Distinct (id, direction) where a term of the direction occurs in the text by the keyword rule.

    ``terms`` is a dictionary of (direction, term). A small one becomes one folded predicate for each direction, so a text is
    read once and nothing is crossed; of a large one the terms that a text holds are found first and the rule is tried on these.
    """
    from ..functions.predicates import any_of, keyword_match, keyword_match_term

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = folded(terms.select("direction", "term"))
    if rows is None:
        low = people.select(F.col(id_col).alias("id"), F.lower(text).alias("text"))
        held = mentions(low, terms.select(F.lower("term").alias("word"))).join(terms.select(F.lower("term").alias("word"), "term", "direction"), "word")
        met = people.select(F.col(id_col).alias("id"), text.alias("text")).join(held, "id").where(keyword_match_term("text", "term"))
        return met.select(F.col("id").alias(id_col), "direction").distinct()
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["direction"], []).append(r["term"])
    hits = F.array_compact(F.array(*[F.when(any_of(*[keyword_match(text, t) for t in ts]), F.lit(d)) for d, ts in by.items()])) if by else F.array().cast("array<string>")
    return people.select(id_col, F.explode(hits).alias("direction")).distinct()


def query_grid(universities: DataFrame, templates: DataFrame, year: int) -> DataFrame:
    """Crawl queries: each template (template_id, template) with {name}, {en} and {year} filled in for each university, and its URL form."""
    grid = universities.crossJoin(F.broadcast(templates))  # a row for each pair is the result itself
    text = F.replace(F.replace(F.replace("template", F.lit("{name}"), F.col("name")), F.lit("{en}"), F.coalesce("en_name", "name")), F.lit("{year}"), F.lit(str(year)))
    return grid.select("name", "template_id", text.alias("query"), F.url_encode(text).alias("encoded"))


def trend_grid(counts: DataFrame, low: int, high: int) -> DataFrame:
    """(concept, year, n) for every year of the range, 0 where there is no count."""
    years = counts.select("concept").distinct().select("concept", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("year"))
    return years.join(counts, ["concept", "year"], "left").select("concept", "year", F.coalesce("n", F.lit(0)).alias("n"))
