"""Predicates as Columns: folded filters that Catalyst pushes to the scan, keyword and name rules, page and link rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"一-鿿"


def like_pattern(text: str) -> str:
    """A substring pattern for LIKE in which the text's own wildcards mean themselves."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", text) + "%"


def has(column: str | Column, text: str) -> Column:
    """Case-insensitive substring."""
    return (F.col(column) if isinstance(column, str) else column).ilike(like_pattern(text))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the given conditions; of none, true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def keyword_match(text: Column, keyword: str) -> Column:
    """An ASCII keyword of at most 4 characters needs a non-letter, non-digit on both sides; any other is a substring. Case doesn't count."""
    if keyword.isascii() and len(keyword) <= 4:
        return text.rlike(r"(?i)(?<![\p{L}\p{Nd}])" + re.escape(keyword) + r"(?![\p{L}\p{Nd}])")
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def keyword_match_term(text: str, term: str) -> Column:
    """:func:`keyword_match` where the keyword is a column too."""
    short = F.expr(f"length({term}) <= 4 and {term} rlike '^[\\\\x00-\\\\x7f]*$'")
    bounded = F.expr(f"regexp_like({text}, concat('(?i)(?<![\\\\p{{L}}\\\\p{{Nd}}])', '\\\\Q', {term}, '\\\\E', '(?![\\\\p{{L}}\\\\p{{Nd}}])'))")
    return F.when(short, bounded).otherwise(F.expr(f"contains(lower({text}), lower({term}))"))


_TOKEN = re.compile(r'(-?)(?:(\w+)([:=]))?(?:"([^"]*)"|(\S+))')


def boolean_filter(query: str, fields: dict[str, str]) -> Column:
    """One Column for a search text: a space is AND, | is OR, a leading - is NOT, "x" is x not flanked by Han characters.

    ``fields`` maps a prefix (``name:`` or ``name=``) to a column; a word without prefix may occur in any of them. A
    column that is null holds nothing. An empty query keeps all rows.
    """

    def term(sign: str, field: str, quoted: str | None, word: str | None) -> Column:
        columns = [F.coalesce(F.col(c), F.lit("")) for c in ([fields[field]] if field in fields else fields.values())]
        if quoted is not None:
            hit = any_of(*[c.rlike(f"(?i)(?<![{HAN}]){re.escape(quoted)}(?![{HAN}])") for c in columns])
        else:
            hit = any_of(*[F.contains(F.lower(c), F.lit(word.lower())) for c in columns])
        return ~hit if sign else hit

    def branch(part: str) -> Column:
        return all_of(*[term(s, f if f in fields else "", q or None if q != "" else None, w if not f or f in fields else f + sep + w) for s, f, sep, q, w in _TOKEN.findall(part)])

    parts = [p for p in query.split("|") if p.strip()]
    return any_of(*map(branch, parts)) if parts else F.lit(True)


def is_han_name(c: Column) -> Column:
    """2 to 5 Han characters."""
    return c.rlike(f"^[{HAN}]{{2,5}}$")


def is_latin_name(c: Column) -> Column:
    """Two to four capitalised words."""
    return c.rlike(r"^[A-Z][a-z]+(?:\s[A-Z][a-z]+){1,3}$")


def is_institution(c: Column, suffixes=("大学", "学院", "研究所", "研究院", "实验室", "中心")) -> Column:
    return c.rlike("(?:" + "|".join(map(re.escape, suffixes)) + ")$")


def is_bad_name(c: Column, exact=(), roots=()) -> Column:
    """Blank, listed as no name, or holding a root that names don't have; the lists are arguments."""
    bad = F.coalesce(F.trim(c), F.lit("")) == ""
    if exact:
        bad |= c.isin(*exact)
    return bad | c.rlike("|".join(map(re.escape, roots))) if roots else bad


def valid_person(name: Column, university: Column, exact=(), roots=()) -> Column:
    """The gate before a person is stored: a Han or Latin name, not bad, no institution, not the university itself."""
    good = (is_han_name(name) | is_latin_name(name)) & ~is_bad_name(name, exact, roots) & ~is_institution(name) & (name != F.coalesce(university, F.lit("")))
    return F.coalesce(good, F.lit(False))


def skip_href(c: Column) -> Column:
    """Empty, a fragment, a script, mail or phone link, or a binary file."""
    h = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (h == "") | h.rlike(r"^(?:#|javascript:|mailto:|tel:)|\.(?:pdf|docx?|xlsx?|pptx?|zip|rar|7z|jpe?g|png|gif|bmp|svg|mp4|avi|mp3)$")


def site_of(url: Column) -> Column:
    """The last three labels of a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    return F.when(host != "", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), "."))


def same_site(url: Column, base: Column) -> Column:
    """The last three host labels agree, or one host is below the other."""
    a, b = site_of(url), site_of(base)
    return F.coalesce(F.endswith(a, b) | F.endswith(b, a), F.lit(False))


def is_home_redirect(requested: Column, final: Column, title: Column, n_name_links: Column, section: str = "师资|教师|导师|faculty|people|staff") -> Column:
    """A deep address that ended at the root or an index page, or a short title without a section word on a page with under two name links."""
    path = lambda u: F.coalesce(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    deep = F.length(F.regexp_replace(path(requested), r"^/|/$", "")) > 0
    home = path(final).rlike(r"^/?(?:index\.[a-z]+)?$")
    bare = (F.length(F.coalesce(title, F.lit(""))) <= 12) & ~F.coalesce(title, F.lit("")).rlike("(?i)" + section) & (n_name_links < 2)
    return deep & (home | bare)


def looks_like_schedule(areas: Column) -> Column:
    return areas.rlike(r"(?:周[一二三四五六日]|\d{1,2}:\d{2}|第\d+周)")


def clean_people(name: Column, areas: Column, roots=("大学", "学院", "会议", "通知", "公告", "讲座")) -> Column:
    """Keeps rows whose name holds no root of organisations or events and whose areas aren't a timetable."""
    return ~F.coalesce(name.rlike("|".join(map(re.escape, roots))), F.lit(False)) & ~F.coalesce(looks_like_schedule(areas), F.lit(False))


def clean_people_strict(name: Column, university: Column, words=(), suffixes=("大学", "学院", "系", "所", "中心", "实验室")) -> Column:
    """Keeps rows whose trimmed name has 2 to 12 characters, no digits, is no link, markup, navigation word or organisation."""
    n = F.trim(F.coalesce(name, F.lit("")))
    bad = (n == F.coalesce(university, F.lit(""))) | ~F.char_length(n).between(2, 12) | n.rlike(r"[0-9]|^返回|^(?i:http|www\.)|^<")
    bad |= n.rlike("(?:" + "|".join(map(re.escape, suffixes)) + ")$")
    return ~(bad | n.isin(*words)) if words else ~bad


def long_areas_to_null(areas: Column, most: int = 80) -> Column:
    """Text over ``most`` characters without a list separator is no list of areas: null."""
    return F.when((F.char_length(areas) > most) & ~areas.rlike("[,、]"), F.lit(None)).otherwise(areas)


# What a search hit about staff says, and what a page of staff is headed.
FACULTY_WORDS = "导师 教授 副教授 研究方向 师资".split()
FACULTY_PAGES = r"师资队伍|师资力量|师资简介|师资介绍|教师队伍|教职工|专任教师|全体教师|教师简介|教师列表|教师信息|导师简介|导师队伍|教师风采|(?i:faculty|teaching\s+staff|academic\s+staff|our\s+(?:faculty|team|people|staff)|professors\s+and\s+staff)"


def likely_faculty(snippet: Column, words=FACULTY_WORDS, pages: str = FACULTY_PAGES) -> Column:
    """A hit that names staff or a page of staff; null is none."""
    return F.coalesce(snippet.rlike("|".join(map(re.escape, words)) + "|" + pages), F.lit(False))


def notice_relevant(title: Column, words=("夏令营", "推免", "招生", "admission", "summer")) -> Column:
    return F.coalesce(title.rlike("(?i)" + "|".join(map(re.escape, words))), F.lit(False))


def title_names_university(title: Column, university: Column) -> Column:
    """A university whose name is two characters before 大学 needs its whole name; any other its name or its first four characters."""
    stem = F.regexp_replace(university, "(?:大学|学院)$", "")
    return F.when(F.char_length(stem) <= 2, F.contains(title, university)).otherwise(F.contains(title, university) | F.contains(title, F.left(university, F.lit(4))))


def in_field(fields: Column, pattern: str = "^Computer|^Engineering|^Mathematics|^Physics|^Decision Sciences|Information|Telecommunications") -> Column:
    """Any field fits, or there are none."""
    return (F.coalesce(F.size(fields), F.lit(0)) <= 0) | F.exists(fields, lambda f: F.coalesce(f.rlike(pattern), F.lit(False)))
