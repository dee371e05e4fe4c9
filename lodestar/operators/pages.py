"""Extraction from crawled pages: one parsing pass over html, then Column expressions, joins and aggregates.

``parse`` turns each page into a row of facts with its links, nodes, label pairs and scripts as arrays; html is read once and
a task holds the facts of few pages at a time. Rules of language (words, classes) are arguments with the usual defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import predicates as P
from ..functions import text as X

FACTS = (
    "page_id long, url string, title string, text string, meta_description string, meta_keywords string, heads array<string>, alts array<string>, "
    "links array<struct<href:string,url:string,text:string,parent:string,box:string>>, nodes array<struct<fp:string,text:string,href:string>>, "
    "labels array<struct<label:string,value:string,kind:int>>, cells array<struct<row_no:int,cells:array<string>>>, scripts array<string>"
)
_VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "source", "wbr"}
_BOXES = {"tr", "li", "div", "article", "section", "dl", "td"}
_BLOCKS = _BOXES | {"p", "h1", "h2", "h3", "dt", "dd", "th", "ul", "table"}
_RECORDS = {"li", "div", "tr", "article", "dl", "p"}


class _Page(HTMLParser):
    """A tolerant reader: unclosed tags end where their parent ends."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.base = url, url
        self.stack: list[list] = []
        self.text: list[str] = []
        self.meta: dict[str, str] = {}
        self.title, self.heads, self.alts, self.links, self.nodes, self.labels, self.rows, self.scripts = "", [], [], [], [], [], [], []
        self.term = None
        self.strong = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name"):
            self.meta[a["name"].lower()] = a.get("content", "")
        elif tag == "base" and a.get("href"):
            self.base = _join(self.url, a["href"])
        elif tag == "img" and a.get("alt"):
            self.alts.append(a["alt"])
        elif tag == "br":
            self._add("\n")
        if tag in _VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
            self._close(1)
        self.stack.append([tag, a, [], [], None])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self._add(data)

    def _add(self, data):
        if self.stack:
            self.stack[-1][2].append(data)

    def handle_endtag(self, tag):
        for depth in range(1, len(self.stack) + 1):
            if self.stack[-depth][0] == tag:
                self._close(depth)
                return

    def _close(self, count):
        for _ in range(count):
            tag, attrs, pieces, cells, href = self.stack.pop()
            raw = "".join(pieces)
            text = " ".join(raw.split())
            parent = self.stack[-1] if self.stack else None
            if tag == "script":
                self.scripts.append(raw)
                continue
            if tag == "style":
                continue
            if tag == "title":
                self.title = self.title or text
                continue
            if tag in ("h1", "h2", "h3") and text:
                self.heads.append(text)
            if tag == "a" and "href" in attrs:
                box = next((f"{t}.{(a.get('class') or '').split(' ')[0]}" for t, a, *_ in reversed(self.stack) if t in _BOXES), "")
                self.links.append([attrs["href"], text, parent, box])
                href = attrs["href"]
            if tag in _RECORDS:
                self.nodes.append((f"{tag}.{(attrs.get('class') or '').split(' ')[0]}", text, href))
            if tag in ("td", "th") and parent is not None:
                for row in reversed(self.stack):
                    if row[0] == "tr":
                        row[3].append((tag, text))
                        break
            if tag == "tr" and cells:
                self.rows.append([t for _, t in cells])
                if len(cells) == 2:
                    self.labels.append((cells[0][1], cells[1][1], 2 if cells[0][0] == "th" else 3))
            if tag == "dt":
                self.term = text
            if tag == "dd" and self.term:
                self.labels.append((self.term, text, 1))
                self.term = None
            if tag in ("li", "p", "div"):
                if self.strong and text.startswith(self.strong) and len(text) > len(self.strong):
                    self.labels.append((self.strong, text[len(self.strong) :].strip(" :："), 4))
                self.strong = None
            if tag in ("strong", "b") and text.endswith((":", "：")) or tag == "span" and "label" in (attrs.get("class") or ""):
                self.strong = text
            shown = f"\n{raw}\n" if tag in _BLOCKS else raw
            if parent is not None:
                parent[2].append(shown)
                parent[4] = parent[4] or href
            else:
                self.text.append(shown)

    def facts(self, page_id) -> tuple:
        self._close(len(self.stack))
        around = lambda parent: " ".join("".join(parent[2]).split())[:300] if parent else ""
        links = [(h, _join(self.base, h), t, around(p), b) for h, t, p, b in self.links]
        lines = [" ".join(x.split()) for x in "".join(self.text).split("\n")]
        return (page_id, self.url, self.title, "\n".join(x for x in lines if x), self.meta.get("description"), self.meta.get("keywords"), self.heads, self.alts, links, self.nodes, self.labels, list(enumerate(self.rows)), self.scripts)


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


#: How much html is parsed before its facts are handed on; a page is never cut.
SLICE_CHARS = 1_000_000


def _parser(fields: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that parses page by page and holds the facts of about SLICE_CHARS of html at a time, however large a batch is."""
    names = [x.split(" ")[0] for x in "page_id url title text meta_description meta_keywords heads alts links nodes labels cells scripts".split()]
    as_dicts = {"links": ("href", "url", "text", "parent", "box"), "nodes": ("fp", "text", "href"), "labels": ("label", "value", "kind"), "cells": ("row_no", "cells")}
    places = [(names.index(n), n, kind) for n, kind in fields]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = []
        for at, n, kind in places:
            keys = as_dicts.get(n)
            values = [[dict(zip(keys, x, strict=True)) for x in r[at]] for r in rows] if keys else [r[at] for r in rows]
            columns.append(pa.array(values, kind))
        return pa.RecordBatch.from_arrays(columns, [n for _, n, _ in places])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                page, text = _Page(url.as_py() or ""), html.as_py() or ""
                page.feed(text)
                page.close()
                rows.append(page.facts(page_id.as_py()))
                size += len(text) + 100
                if size >= SLICE_CHARS:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return parsed


def parse(pages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row of facts per page, or only some of their columns; null html counts as an empty page."""
    kinds = StructType.fromDDL(FACTS)
    schema = StructType([kinds[c] for c in only]) if only else kinds
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_parser(fields), schema)


def extract_links(facts: DataFrame) -> DataFrame:
    """Every a[href]: absolute address, anchor text, text and kind of what encloses it."""
    return facts.select("page_id", F.col("url").alias("page_url"), F.posexplode("links").alias("at", "l")).select("page_id", "page_url", "at", "l.*")


def followable(links: DataFrame) -> DataFrame:
    """Links that are pages of the same site."""
    return links.where(~P.skip_href(F.col("href")) & P.same_site(F.col("url"), F.col("page_url")))


TITLES = "教授|副教授|讲师|研究员|导师|Professor|Lecturer"
PROFILE_URL = r"(?i)/(?:teacher|faculty|people|profile|staff|info|jsxx|szdw)[/_-]?[a-z0-9_-]*(?:/|\.s?html?|\?|$)"


#: Anchor texts that look like names of Han characters.
NAVIGATION = "首页 上一页 下一页 上页 下页 前页 后页 尾页 末页 更多 返回 详情".split()


def person_links(links: DataFrame) -> DataFrame:
    """Candidate people with the first strategy that found each url: 1 a title in the context, 2 a profile address, 3 a table row
    with a title, 4 a bare name of short or numeric address, 5 a known card class."""
    name = X.clean_name(F.col("text"))
    named = ((name != "") & ~name.isin(*NAVIGATION)) | P.is_latin_name(F.col("text"))
    bare = F.col("url").rlike(r"/\d+(?:/|\.s?html?|$)") | (F.char_length("url") <= 60)
    rules = [(1, named & F.col("parent").rlike(TITLES)), (2, named & F.col("url").rlike(PROFILE_URL)), (3, named & F.startswith("box", F.lit("tr")) & F.col("parent").rlike(TITLES)), (4, named & bare), (5, F.col("box").rlike(r"(?i)\.(?:teacher|card|person|member|people)"))]
    tagged = links.withColumn("strategy", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in rules]))))
    w = Window.partitionBy("page_id", "url").orderBy("strategy", "at")
    shown = F.when(name != "", name).otherwise(F.trim("text"))
    return tagged.withColumn("n", F.row_number().over(w)).where("n = 1").select("page_id", "page_url", "url", shown.alias("name"), "strategy")


#: A name at the start of a record, before a space, bracket, title or the end.
_LEADING_NAME = rf"^([一-鿿]{{2,4}}?|[A-Z][a-z]+(?:\s[A-Z][a-z]+){{1,3}})(?=$|[\s（(,，:：]|{TITLES})"


def repeated_records(facts: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """Of each page the most frequent kind of node (tag and first class) of 3 to 200 that hold links, at least half of them and
    three naming a person; one row per node."""
    nodes = facts.select("page_id", F.col("url").alias("page_url"), F.posexplode("nodes").alias("at", "n")).select("page_id", "page_url", "at", "n.*").where("href is not null")
    name = F.regexp_extract("text", _LEADING_NAME, 1)
    named = name != ""
    groups = nodes.groupBy("page_id", "fp").agg(F.count("*").alias("n"), F.count_if(named).alias("names"))
    best = groups.where(F.col("n").between(least, most) & (F.col("names") >= 3) & (F.col("names") * 2 >= F.col("n")))
    best = best.groupBy("page_id").agg(F.max_by("fp", F.struct("n", "fp")).alias("fp"))
    return nodes.join(best, ["page_id", "fp"]).withColumn("name", name).withColumn("title", X.extract_title(F.col("text")))


def person_objects(text: Column, least: int = 20, most: int = 800, longest: int | None = 5) -> Column:
    """JSON objects of a text that name a person: Han characters, two or more and at most ``longest`` (None: any number)."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(\{{[^{{}}]{{{least},{most}}}\}})")), lambda o: o.rlike(rf'"(?:name|xm|jzmc|jsxm|teacherName)"\s*:\s*"[一-鿿]{{2,{longest or ""}}}"'))


def _field(o: Column, names: str) -> Column:
    return F.nullif(F.regexp_extract(o, rf'"(?:{names})"\s*:\s*"([^"]*)"', 1), F.lit(""))


def script_records(facts: DataFrame) -> DataFrame:
    """People in inline scripts of up to 500,000 characters: the objects of the first script that has any."""
    scripts = facts.select("page_id", "url", F.posexplode("scripts").alias("script", "body")).where("char_length(body) <= 500000")
    found = scripts.select("page_id", F.col("url").alias("page_url"), "script", F.posexplode(person_objects(F.col("body"))).alias("at", "o"))
    first = found.withColumn("n", F.dense_rank().over(Window.partitionBy("page_id").orderBy("script"))).where("n = 1")
    return first.select("page_id", "page_url", "at", _field(F.col("o"), "name|xm|jzmc|jsxm|teacherName").alias("name"), _field(F.col("o"), "url|link|href").alias("href"), _field(F.col("o"), "title|zc|position").alias("title"), _field(F.col("o"), "areas|yjfx|research").alias("areas"))


_LABELS = {"title": "职称|职务|Title|Position", "email": "邮箱|E-?mail|电子邮件", "areas": "研究方向|研究领域|研究兴趣|Research", "lab": "实验室|课题组|Lab"}


def _labelled(words: str) -> Column:
    """The value of the first kind of label pair whose label is one of the words."""
    hits = F.filter("labels", lambda p: p["label"].rlike(f"(?i)^(?:{words})") & (F.trim(p["value"]) != ""))
    return F.array_min(F.transform(hits, lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"))))["value"]


def _first_like(values: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.rlike(pattern)), F.lit(1))


def extract_profile(facts: DataFrame) -> DataFrame:
    """Per page title, email, areas, scholar links, lab and recruiting: of each field the first source that has it, in the
    order body text, labelled pairs (dl, th/td, td/td, strong), meta description, first long paragraph."""
    body = F.col("text")
    direct = {"title": X.extract_title(body), "email": X.extract_email(body), "areas": X.extract_areas(body), "lab": F.nullif(F.regexp_extract(body, r"([一-鿿A-Za-z]{2,20}(?:实验室|课题组))", 1), F.lit(""))}
    labelled = {field: _labelled(words) for field, words in _LABELS.items()}
    meta = {"title": X.extract_title(F.col("meta_description")), "email": X.extract_email(F.col("meta_description")), "areas": X.extract_areas(F.col("meta_description")), "lab": F.lit(None).cast("string")}
    long = F.try_element_at(F.filter(F.split(body, "\n"), lambda p: F.char_length(p) >= 60), F.lit(1))
    rest = {"areas": F.left(long, F.lit(100))}
    cap = {"areas": 400}
    fields = [F.left(F.coalesce(direct[f], labelled[f], meta[f], rest.get(f, F.lit(None).cast("string"))), F.lit(cap.get(f, 100))).alias(f) for f in direct]
    urls = F.transform("links", lambda x: x["url"])
    scholar = {"google_scholar": "scholar[.]google", "orcid": "orcid[.]org", "semantic_scholar": "semanticscholar[.]org", "dblp": "dblp[.](?:org|uni-trier)"}
    found = [_first_like(urls, p).alias(k) for k, p in scholar.items()]
    return facts.select("page_id", "url", *fields, *found, X.is_recruiting(body).alias("recruiting"))


def resolve_person_name(facts: DataFrame, hint: str | None = None) -> DataFrame:
    """(page_id, name): the first valid name of hint, title parts, headings, keywords and image texts; "" if none is."""
    hinted = F.array(F.col(hint)) if hint else F.array().cast("array<string>")
    parts = F.flatten(F.array(hinted, F.split(F.coalesce("title", F.lit("")), r"[-_|—–\s]+"), F.coalesce("heads", F.array().cast("array<string>")), F.split(F.coalesce("meta_keywords", F.lit("")), r"[,，\s]+"), F.coalesce("alts", F.array().cast("array<string>"))))
    names = F.filter(F.transform(parts, X.clean_name), lambda n: (n != "") & ~P.is_institution(n))
    return facts.select("page_id", F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("")).alias("name"))


def extract_people(list_pages: DataFrame, profile_pages: DataFrame, university: str) -> DataFrame:
    """People of list pages, filled in from their profile pages: inline values come first, only valid names and pages of the same
    site count, and rows without an address get the key nourl:university:name."""
    found = person_links(followable(extract_links(list_pages))).select("page_id", "page_url", "url", "name", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("areas"))
    few = list_pages.join(found.groupBy("page_id").agg(F.count("*").alias("n")).where("n >= 3"), "page_id", "left_anti")
    records = repeated_records(few).select("page_id", "page_url", F.col("href").alias("url"), "name", "title", F.lit(None).cast("string").alias("areas"))
    scripts = script_records(few).select("page_id", "page_url", F.col("href").alias("url"), "name", "title", "areas")
    candidates = found.union(records).union(scripts).withColumn("university", F.lit(university))
    candidates = candidates.where(P.valid_person(F.col("name"), F.col("university")))
    profiles = extract_profile(profile_pages).join(resolve_person_name(profile_pages).withColumnRenamed("name", "own_name"), "page_id").select(F.col("url"), "own_name", F.col("title").alias("p_title"), "email", F.col("areas").alias("p_areas"), "lab", "recruiting")
    met = candidates.join(profiles, "url", "left")
    key = F.coalesce(F.nullif("url", F.lit("")), F.concat_ws(":", F.lit("nourl"), "university", "name"))
    out = met.select(key.alias("profile_url"), F.coalesce(F.nullif("name", F.lit("")), "own_name").alias("name"), "university", F.coalesce("title", "p_title").alias("title"), "email", F.coalesce("areas", "p_areas").alias("areas"), "lab", F.coalesce("recruiting", F.lit(False)).alias("recruiting"))
    return out.groupBy("profile_url").agg(*[F.min(c).alias(c) for c in out.columns if c != "profile_url"])


def extract_lab(facts: DataFrame) -> DataFrame:
    """Labs: name, head, areas, members (name anchors and the list after 成员), recruiting, a snippet of 200 characters."""
    text = F.col("text")
    name = F.coalesce(F.nullif(F.regexp_extract("title", r"([^-_|—]*(?:实验室|课题组|研究组|中心|Lab(?:oratory)?|Group))", 1), F.lit("")), F.try_element_at("heads", F.lit(1)))
    head = F.nullif(F.regexp_extract(text, r"(?:负责人|PI|Head)\s*[:：]\s*([一-鿿]{2,5}|[A-Z][a-z]+(?: [A-Z][a-z]+)+)", 1), F.lit(""))
    anchors = F.filter(F.transform("links", lambda x: X.clean_name(x["text"])), lambda n: n != "")
    listed = F.filter(F.transform(F.split(F.regexp_extract(text, r"成员\s*[:：]\s*([^\n。]{2,300})", 1), "[,，、；;\\s]+"), X.clean_name), lambda n: n != "")
    return facts.select("page_id", "url", F.trim(name).alias("lab_name"), head.alias("pi"), X.extract_areas(text).alias("areas"), F.array_sort(F.array_distinct(F.concat(anchors, listed))).alias("members"), X.is_recruiting(text).alias("recruiting"), X.snippet(text, 200).alias("snippet"))


_PLAN, _CAMP = "招生计划|招生目录|拟招|导师名单|名额分配", "夏令营|summer"


def extract_notice(facts: DataFrame) -> DataFrame:
    """Notices: category, deadline (the last date), quota, gpa, rank, e-mail, published (the first date), a snippet of 300 characters."""
    text = F.col("text")
    start = F.left(text, F.lit(600))
    category = F.when(start.rlike(_PLAN), "plan").when(F.concat_ws(" ", "title", text).rlike(f"(?i){_CAMP}"), "camp").otherwise("notice")
    extra = F.to_json(F.struct(X.deadline(text).alias("deadline"), X.extract_quota(text).alias("quota"), X.extract_gpa(text).alias("gpaReq"), X.extract_rank(text).alias("rankReq"), X.extract_email(text).alias("email")))
    return facts.select("page_id", "url", "title", category.alias("category"), extra.alias("extra_json"), F.try_element_at(X.extract_dates(text), F.lit(1)).alias("published_at"), X.snippet(text, 300).alias("snippet"))


PAGE_WORDS = {
    "teacher_list": "师资队伍|教师名录|导师名单|教职工|faculty",
    "lab": "实验室|课题组|研究组|lab",
    "members": "成员|members",
    "notice": "通知|公告|简章|招生|notice",
    "plan": "招生计划|招生目录|计划",
}


def classify_page(facts: DataFrame, name_links: DataFrame | None = None, words: dict[str, str] | None = None) -> DataFrame:
    """(page_id, page_type, points): four sums over title, first 800 characters and address, the most wins, ties plan > notice > lab > teacher_list;
    all 0 is unknown. Text is lower-cased before, so upper-case words of a rule never match."""
    w = PAGE_WORDS | (words or {})
    rows = facts.select("page_id", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.left("text", F.lit(800))).alias("x"), F.lower("url").alias("u"))
    rows = rows.join(name_links, "page_id", "left") if name_links is not None else rows.withColumn("n_name_links", F.lit(0))
    rows = rows.withColumn("s", F.concat("t", F.lit("\n"), "x")).withColumn("k", F.coalesce("n_name_links", F.lit(0)))
    pt = lambda cond, p: F.when(cond, p).otherwise(0)
    s, t, x, u = (F.col(c) for c in "stxu")
    teacher = pt(s.rlike(w["teacher_list"]), 4) + F.least(F.floor(F.col("k") / 2), F.lit(6)) + pt(u.rlike("szdw|jsdw|faculty|teacher|staff|people|rencai"), 3)
    lab = pt(t.rlike(w["lab"]), 5) + pt(x.rlike(w["lab"]), 2) + pt(s.rlike(w["members"]), 3) + pt(s.rlike("pi |负责人"), 2) + pt(u.rlike("lab|labs|yjjg|yjzx|research|group|centre"), 2)
    notice = pt(s.rlike(w["notice"]), 5) + pt(F.size(X.extract_dates(s)) > 0, 3) + pt(X.extract_quota(s).isNotNull(), 2) + pt(s.rlike("报名|申请截止"), 1) + pt(u.rlike("notice|tzgg|bszn|zsxx|notify|announce"), 2)
    plan = pt(s.rlike(w["plan"]), 5) + pt(s.rlike("导师") & s.rlike("名额"), 3) + pt(u.rlike("plan|dszs|dsmc|recruit|mentor"), 2)
    scored = rows.select("page_id", *[c.cast("int").alias(n) for n, c in (("plan", plan), ("notice", notice), ("lab", lab), ("teacher_list", teacher))])
    top = F.greatest("plan", "notice", "lab", "teacher_list")
    kind = F.when(top == 0, "unknown").when(F.col("plan") == top, "plan").when(F.col("notice") == top, "notice").when(F.col("lab") == top, "lab").otherwise("teacher_list")
    return scored.select("page_id", kind.alias("page_type"), top.alias("points"))


def extract_supervisor_rows(facts: DataFrame) -> DataFrame:
    """Rows of tables whose first cell is a name as "name | c1 | c2"; a page without any is one notice."""
    rows = facts.select("page_id", "url", F.explode("cells").alias("r")).select("page_id", "url", "r.row_no", "r.cells").where(P.is_han_name(F.trim(F.col("cells")[0])))
    items = rows.select("page_id", "url", "row_no", F.lit("plan").alias("category"), F.array_join(F.slice("cells", 1, 3), " | ").alias("item"))
    rest = facts.join(items.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "url", F.lit(-1).alias("row_no"), F.lit("notice").alias("category"), F.col("title").alias("item"))
    return items.unionByName(rest)


def mine_prose_people(texts: DataFrame, university: str) -> DataFrame:
    """(page_id, name, title, areas) named in running text of pages that mention the university: lists after 导师, then "X教授" with areas from around it."""
    pages = texts.where(F.contains("text", F.lit(university)))
    lists = F.flatten(F.transform(F.regexp_extract_all("text", F.lit("导师\\s*[:：]\\s*([^\\n。]{2,200})")), lambda s: F.split(s, "[、,，；;\\s]+")))
    listed = pages.select("page_id", F.explode(F.transform(lists, X.clean_name)).alias("name")).where("name <> ''").select("page_id", "name", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("areas"), F.lit(1).alias("way"))
    said = pages.select("page_id", F.explode(F.regexp_extract_all("text", F.lit("((?:[^\\n]{0,50})[一-鿿]{2,4}(?:副教授|教授|研究员)[^\\n]{0,100})"))).alias("m"))
    named = said.select("page_id", F.regexp_extract("m", "([一-鿿]{2,3})(?:副教授|教授|研究员)", 1).alias("name"), X.extract_title(F.col("m")).alias("title"), X.extract_areas(F.col("m")).alias("areas"), F.lit(2).alias("way")).where("name <> ''")
    w = Window.partitionBy("page_id", "name").orderBy("way")
    return listed.union(named).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "way")


def mine_author_lists(items: DataFrame) -> DataFrame:
    """(item_id, name, title, areas) from 作者 lists of result texts."""
    names = F.transform(F.split(F.regexp_extract("text", "作者\\s*[:：]\\s*([^\\n。]{2,200})", 1), "[,，、；;\\s]+"), X.clean_name)
    return items.select("item_id", F.explode(F.array_distinct(names)).alias("name"), X.extract_title(F.col("text")).alias("title"), X.extract_areas(F.col("text")).alias("areas")).where("name <> ''")


NEXT = "^(?:下一页|下页|next|>|>>|»)$"


def crawl_frontier(links: DataFrame, visited: DataFrame, cap: int = 20) -> DataFrame:
    """Next pages of a list: numbers up to 25, words for next, paging addresses; not the visited ones, ``cap`` per list."""
    text = F.lower(F.trim("text"))
    paging = F.col("url").rlike(r"(?i)(?:[?&](?:page|pageno|p|pn)=\d+|[_/]\d{1,3}\.s?html?$)")
    number = F.when(text.rlike("^[0-9]{1,2}$"), text.cast("int"))
    found = links.where((number.between(1, 25)) | text.rlike(NEXT) | paging).select("page_id", "url").distinct()
    fresh = found.join(visited.select("url"), "url", "left_anti")
    return fresh.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("url"))).where(F.col("n") <= cap).drop("n")


def page_variants(url: Column, pages: int) -> Column:
    """Addresses of pages 2 to ``pages``: the first known page parameter replaced, else _N before .htm, else pageNo=N appended."""
    known = r"(?i)([?&](?:pageNo|page|pageIndex|curPage|p)=)\d+"
    mark = F.lit("{n}")
    made = F.when(url.rlike(known), F.regexp_replace(url, known, "$1{n}")).when(url.rlike(r"\.html?$"), F.regexp_replace(url, r"(?:_\d+)?(\.html?)$", "_{n}$1")).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("pageNo={n}")))
    return F.transform(F.sequence(F.lit(2), F.lit(pages)), lambda n: F.replace(made, mark, n.cast("string")))


def discover_colleges(links: DataFrame, base: str, words: str = "计算机|软件|人工智能|信息|computer|software|informat", first: int = 12) -> DataFrame:
    """Links to colleges: sub-domains or college paths with a short anchor; those with a subject word, or else the first 12."""
    site = P.same_site(F.col("url"), F.lit(base)) & (F.char_length("text") <= 40)
    college = links.where(site & (F.col("url").rlike(r"(?i)/(?:xy|college|school|department|yx)") | (F.regexp_extract("url", "://([^/]+)", 1) != F.regexp_extract(F.lit(base), "://([^/]+)", 1))))
    marked = college.withColumn("fits", F.lower("text").rlike(words) | F.lower("url").rlike(words))
    some = marked.groupBy("page_id").agg(F.bool_or("fits").alias("any"))
    ranked = marked.join(some, "page_id").withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("at")))
    return ranked.where("(any and fits) or (not any and n <= 12)".replace("12", str(first))).select("page_id", "url", "text")


def discover_list_pages(links: DataFrame, words: str = "师资|教师|导师|faculty|people|staff") -> DataFrame:
    """Pages that list people: anchors with such words, those on pages one hop away, and siblings in the same directory; scored, best first."""
    from .windows import url_score

    hop1 = links.where(F.lower("text").rlike(words)).select("page_id", "url", F.lit(1).alias("hop"))
    near = hop1.select(F.col("url").alias("page_url")).distinct()
    hop2 = links.join(near, "page_url", "left_semi").where(F.lower("text").rlike(words)).select("page_id", "url", F.lit(2).alias("hop"))
    folder = F.regexp_extract("url", "^(.*/)", 1)
    dirs = hop1.select("page_id", folder.alias("folder")).distinct()
    siblings = links.withColumn("folder", folder).join(dirs, ["page_id", "folder"], "left_semi").select("page_id", "url", F.lit(3).alias("hop"))
    return hop1.union(hop2).union(siblings).groupBy("url").agg(F.min("hop").alias("hop"), F.min("page_id").alias("page_id")).withColumn("score", url_score(F.col("url"))).orderBy(F.desc("score"), "hop", "url")


# Paths below a site's address where lists of labs and of notices are looked for, in this order, and words that such a page says.
LAB_PATHS = """/kycg/sysdjs.htm /kycg/index.htm /yjjg/index.htm /yjjg/list.htm /labs/ /research/ /research/groups/ /research-groups/ /kxyj/index.htm /keyanjigou/
/yjzx/index.htm /lab/ /labs.html /kybm/ /kyjg/ /yjjgml/ /info/1060/list.htm /info/1061/list.htm /info/1062/list.htm /info/1070/list.htm /info/1071/list.htm
/info/1072/list.htm /jxky/kyjg.htm /jxky/yjjg.htm /syslists/ /platbase/ /platform/ /dept/labs.htm /xkyjy/yjjg.htm /yjjg/yjjgjs.htm /yjjg/yjzx.htm
/yjjg/gjhzjg.htm /szrygk/yjjg.htm /kxyj/yjjg.htm /kxyj/yjzx.htm""".split()
NOTICE_PATHS = """/bszn/ /yjszs/ /zsxx/ /tzgg/ /tzgg/index.htm /ggtz/ /graduate/ /yjszs/index.htm /info/3/list.htm /info/4/list.htm /info/5/list.htm /zsb/ /yjsb/ /baoyan/
/tuimian/ /tzgg/yjs.htm /tzgg/zsxx.htm /yjss/tzgg.htm /zsb/tzgg.htm /yjszs/tzgg.htm /yjszs/zsxx.htm /ggxx/ /tztg/ /xyzx/ /xytz/ /notice/ /news/grad/ /grad/news/
/portal/siteapp78/index.html /content/channel/2/ /content/channel/3/""".split()
LAB_WORDS = ["课题组", "研究组", "实验室", "研究中心", "联合实验室", "Laboratory", "Lab", "Research Group", "Research Lab"]
NOTICE_WORDS = """预推免 夏令营 推免通知 保研通知 招生通知 招生简章 接收推荐免试 研究生招生公告 学术夏令营 报名须知 招生公告 导师招生计划 接收调剂 拟接收 推免报名
意向导师 招收名额 拟招收 开放课题 接受简历 招生计划表 招生计划汇总 招生 保研 推免""".split()


def _says(text: Column, words: list[str]) -> Column:
    """Whether a text has one of some words; after an English one of at most three letters a word must end."""
    forms = [w.replace(" ", r"\s+") + (r"\b" if w.isascii() and len(w) <= 3 else "") for w in words]
    return F.coalesce(text.rlike("|".join(forms)), F.lit(False))


@dataclass(frozen=True)
class PathRule:
    """Where pages of a kind are looked for, what their title or first characters must say, how many pages are enough, and how many addresses are given."""

    paths: list[str]
    words: list[str]
    head: int
    enough: int
    most: int
    follow: bool = False


PATH_RULES = {"lab": PathRule(LAB_PATHS, LAB_WORDS, 300, 20, 30, True), "notice": PathRule(NOTICE_PATHS, NOTICE_WORDS, 400, 5, 5)}


def discover_by_paths(pages: DataFrame, bases: DataFrame, kind: str, links: DataFrame | None = None, rules: dict[str, PathRule] = PATH_RULES) -> DataFrame:
    """(base, n, url): list pages of labs or notices of each base address, in order.

    ``pages`` is (page_id, url, title, text) as fetched, one row an address. Those at a base's known paths count if their title or
    first characters have a word of the kind; labs also give the links on these pages, from ``links``, that have such a word and lead to the
    same site. After the page that makes them enough no further path is looked at. Few paths per base: they are spread and meet pages by address.
    """
    rule = rules[kind]
    probed = bases.select("base").distinct().select("base", F.posexplode(F.array(*map(F.lit, rule.paths))).alias("path", "way"))
    probed = probed.select("base", "path", F.concat("base", "way").alias("url"))
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.left(F.coalesce("text", F.lit("")), F.lit(rule.head)))
    hits = pages.join(probed, "url").where(_says(said, rule.words)).select("base", "path", F.lit(-1).alias("at"), "url", "page_id")
    found = hits.drop("page_id")
    if rule.follow and links is not None:
        on = links.where(~P.skip_href(F.col("url"))).select("page_id", "at", F.col("url").alias("to"), "text").join(hits.select("page_id", "base", "path"), "page_id")
        near = on.where(_says(F.concat_ws(" ", "text", "to"), rule.words) & P.same_site(F.col("to"), F.col("base")))
        found = found.union(near.select("base", "path", "at", F.col("to").alias("url")))
    first = found.groupBy("base", "url").agg(F.min(F.struct("path", "at")).alias("x")).select("base", "url", "x.path", "x.at")
    per = Window.partitionBy("base")
    counted = first.withColumn("before", F.count("*").over(per.orderBy("path").rangeBetween(Window.unboundedPreceding, -1))).where(F.col("before") < rule.enough)
    return counted.withColumn("n", F.row_number().over(per.orderBy("path", "at", "url"))).where(F.col("n") <= rule.most).select("base", "n", "url")


def resolve_url(base: Column, href: Column) -> Column:
    """An address by RFC 3986 for absolute, //, /, ?, # and plain relative references; those with dot segments are left to :func:`parse`."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(bare == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(bare, "^(.*/)", 1))
    h = F.trim(href)
    return F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).when(F.startswith(h, F.lit("?")), F.concat(bare, h)).when(F.startswith(h, F.lit("#")), F.concat(F.regexp_extract(base, "^([^#]*)", 1), h)).when(h == "", base).otherwise(F.concat(folder, h))
