"""Sources and sinks: page tables, bibliographic and search dumps as JSON, question files, logs, cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A stored crawl: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def load_dimension(existing: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """The existing rows and the seed rows whose keys aren't there, each once; loading again adds nothing."""
    fresh = seed.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


_AUTHORS = "display_name string, works_count int, cited_by_count int, orcid string, topics array<struct<display_name:string,subfield:struct<display_name:string>,field:struct<display_name:string>>>, counts_by_year array<struct<year:int,works_count:int,cited_by_count:int>>"


def read_author_dump(dump: DataFrame, least_works: int = 2, column: str = "json") -> DataFrame:
    """Author JSON, one object a row: name, counts, title from citations, interests, fields, counts by year (2015 to 2030), last active
    year, orcid. Authors of under two works, and rows that aren't such JSON, go."""
    a = F.from_json(column, _AUTHORS)
    rows = dump.select(a.alias("a")).where(F.col("a.display_name").isNotNull() & (F.coalesce("a.works_count", F.lit(0)) >= least_works)).select("a.*")
    topics = F.coalesce("topics", F.from_json(F.lit("[]"), "array<struct<display_name:string,subfield:struct<display_name:string>,field:struct<display_name:string>>>"))
    counts = X.years_kept(F.transform(F.coalesce("counts_by_year", F.from_json(F.lit("[]"), "array<struct<year:int,works_count:int,cited_by_count:int>>")), lambda x: F.struct(x["year"].alias("y"), x["works_count"].alias("w"), x["cited_by_count"].alias("c"))))
    part = lambda get: F.array_compact(F.transform(topics, get))
    return rows.select(F.col("display_name").alias("name"), F.col("cited_by_count").alias("cited_count"), "works_count", X.title_from_citations(F.coalesce("cited_by_count", F.lit(0))).alias("title"), X.interests(part(lambda t: t["subfield"]["display_name"]), part(lambda t: t["display_name"])).alias("research_areas"), F.array_distinct(part(lambda t: t["field"]["display_name"])).alias("fields"), counts.alias("counts_by_year"), X.active_year(counts).alias("active_year"), "orcid")


def read_person_search(dump: DataFrame, university: str, column: str = "json") -> DataFrame:
    """Person-search JSON {data: [...]}: name_zh before name, position (else 教授), tags joined by ； up to 300 characters, email."""
    schema = "data array<struct<id:string,name:string,name_zh:string,org:string,position:string,tags:array<string>,email:string>>"
    rows = dump.select(F.explode(F.from_json(column, schema)["data"]).alias("p")).select("p.*")
    name = F.coalesce(F.nullif(F.trim("name_zh"), F.lit("")), F.nullif(F.trim("name"), F.lit("")))
    return rows.select("id", name.alias("name"), "org", F.lit(university).alias("university"), F.coalesce(F.nullif(F.trim("position"), F.lit("")), F.lit("教授")).alias("title"), F.left(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "；"), F.lit(300)).alias("research_areas"), "email").where("name is not null")


def read_dblp_authors(dump: DataFrame, university: str, column: str = "json") -> DataFrame:
    """Bibliography hits: the number after a homonym goes, an affiliation note must name the institution, the department is the last such note."""
    note = "struct<type:string,text:string>"
    schema = f"result struct<hits:struct<hit:array<struct<pid:string,info:struct<author:string,url:string,notes:struct<note:array<{note}>>>>>>>"
    clean = F.replace(F.replace(column, F.lit('"@type"'), F.lit('"type"')), F.lit('"@pid"'), F.lit('"pid"'))
    hits = dump.select(F.explode(F.from_json(clean, schema)["result"]["hits"]["hit"]).alias("h")).select("h.pid", "h.info.*")
    mine = F.filter(F.coalesce(F.col("notes.note"), F.from_json(F.lit("[]"), f"array<{note}>")), lambda n: (n["type"] == "affiliation") & F.contains(F.lower(n["text"]), F.lit(university.lower())))
    rows = hits.withColumn("m", mine).where("size(m) > 0")
    return rows.select("pid", F.regexp_replace("author", r" [0-9]{4}$", "").alias("name"), F.lit(university).alias("university"), F.left(F.element_at("m", -1)["text"], F.lit(40)).alias("department"), F.col("url").alias("profile_url"))


def read_s2_authors(dump: DataFrame, university: str, column: str = "json") -> DataFrame:
    """Author-search JSON {data: [...]}: an affiliation must name the institution; title from the h-index; each author once."""
    schema = "data array<struct<authorId:string,name:string,affiliations:array<string>,hIndex:int,citationCount:int>>"
    rows = dump.select(F.explode(F.from_json(column, schema)["data"]).alias("p")).select("p.*")
    here = rows.where(F.exists(F.coalesce("affiliations", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit(university.lower()))))
    one = here.groupBy("authorId").agg(F.min(F.struct("name", "hIndex", "citationCount")).alias("p")).select("authorId", "p.*")
    return one.select(F.col("authorId").alias("author_id"), "name", F.lit(university).alias("university"), X.title_from_h_index(F.coalesce("hIndex", F.lit(0))).alias("title"), F.col("citationCount").alias("cited_count"))


def read_person_list_json(df: DataFrame, column: str = "json", longest: int | None = 5) -> DataFrame:
    """People in list payloads: each object of 20 to 600 characters with a person's name of at most ``longest`` characters (None: any number), an address and a title."""
    from ..operators.pages import _field, person_objects

    o = df.select(F.explode(person_objects(F.col(column), 20, 600, longest)).alias("o"))
    return o.select(_field(F.col("o"), "name|xm|jzmc|jsxm|teacherName").alias("name"), _field(F.col("o"), "url|link|href").alias("url"), _field(F.col("o"), "title|zc|zwmc").alias("title"))


def is_csv_like(content: Column) -> Column:
    """Of the first five lines that aren't blank at least half have two comma-parted fields or more."""
    lines = F.slice(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""), 1, 5)
    return (F.size(lines) > 0) & (F.size(F.filter(lines, lambda x: F.size(F.split(x, ",")) >= 2)) * 2 >= F.size(lines))


def read_question_bank(files: DataFrame, default_category: str = "综合") -> DataFrame:
    """(file, pos, category, question, hint) of (file, content): JSON arrays, CSV lines (category, question, hint) or text lines.

    In text "[cat] q" names a category and "# cat" carries it forward. Headers, comments in CSV and blank lines go.
    """
    rows = files.withColumn("kind", F.when(F.trim("content").rlike(r"^\["), "json").when(is_csv_like(F.col("content")), "csv").otherwise("txt"))
    objects = rows.where("kind = 'json'").select("file", F.posexplode(F.from_json("content", "array<struct<category:string,question:string,hint:string>>")).alias("pos", "o")).select("file", "pos", "o.*")
    lines = rows.where("kind <> 'json'").select("file", "kind", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    csv = lines.where("kind = 'csv' and not line rlike '^(?i:category|类别|分类)\\\\s*,|^#'").select("file", "pos", F.split("line", ",", 3).alias("c"))
    csv = csv.select("file", "pos", F.trim(F.col("c")[0]).alias("category"), F.trim(F.get("c", F.lit(1))).alias("question"), F.trim(F.get("c", F.lit(2))).alias("hint"))
    from pyspark.sql import Window

    txt = lines.where("kind = 'txt'").withColumn("heading", F.nullif(F.trim(F.regexp_extract("line", r"^#+\s*(.+)$", 1)), F.lit(""))).withColumn("own", F.nullif(F.regexp_extract("line", r"^\[([^\]]+)\]", 1), F.lit("")))
    carried = F.last(F.coalesce("own", "heading"), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    txt = txt.withColumn("category", carried).where("heading is null").select("file", "pos", "category", F.trim(F.regexp_replace("line", r"^\[[^\]]+\]\s*", "")).alias("question"), F.lit(None).cast("string").alias("hint"))
    out = objects.unionByName(csv).unionByName(txt).where("trim(coalesce(question, '')) <> ''")
    return out.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(default_category))).withColumn("hint", F.nullif("hint", F.lit("")))


def append_log(df: DataFrame, path: str) -> None:
    """Appends crawl-log rows (url, status, message, created_at)."""
    df.select("url", "status", "message", "created_at").write.mode("append").parquet(path)


def write_url_checks(df: DataFrame, path: str) -> None:
    """Appends verification rows; nothing is replaced."""
    df.write.mode("append").parquet(path)


def materialize(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Computes once: a result that is stored under the path is read, else written there first."""
    fs = _fs(spark, path)
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def invalidate(spark: SparkSession, path: str) -> None:
    """Forgets a stored result."""
    _fs(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def _fs(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_KINDS = {
    "robots": r"(?mi)^\s*(?:Allow|Disallow)\s*:\s*(/\S*)",
    "sitemap": r"(?i)<loc>\s*([^<\s]+)\s*</loc>",
    "js": r"""(?:fetch|axios(?:\.\w+)?|\$\.(?:get|post|ajax|getJSON)|url\s*:|href=)\s*\(?\s*["']([^"']+)["']""",
}


def mine_paths(texts: DataFrame, kind: str, keep: str = "(?i)szdw|jsdw|faculty|teacher|people|staff|rencai|shizi") -> DataFrame:
    """Distinct candidate paths of robots, sitemap or script texts that hold a faculty word."""
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(_KINDS[kind]))).alias("path")).where(F.col("path").rlike(keep)).distinct()
