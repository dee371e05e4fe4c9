"""Text and array functions as Columns: tokens, terms, fields found in page text, labels and scores."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators differ by reader, on purpose: tokens, session terms and tags each have their own.
TOKEN_SEPARATORS = r"[\s,，、；;。.]+"
SESSION_SEPARATORS = r"[,，；;\s/]+"
TAG_SEPARATORS = r"[,，;；、/\s]+"

_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def session_terms(c: Column, separators: str = SESSION_SEPARATORS) -> Column:
    """What stands between separators, lower-cased, of two characters or more; repeats stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"([^{separators[1:-2]}]{{2,}})"))


#: As the rule above, where Java's white space is the ASCII one.
_SESSION_TERM = re.compile(f"[^{SESSION_SEPARATORS[1:-2]}]{{2,}}", re.ASCII)


def pack_terms(c: Column) -> Column:
    """The session terms of a text with their counts, deflated, as :func:`unpack_terms` reads them; null where there is none."""

    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([_pack(Counter(_SESSION_TERM.findall(t))) for t in texts], dtype=object)

    return F.pandas_udf(packed, "binary")(F.lower(F.coalesce(c, F.lit(""))))


def _pack(counts: Counter) -> bytes | None:
    by_count: dict[int, list[str]] = {}
    for term, n in counts.items():
        by_count.setdefault(n, []).append(term)
    # A line for each count; no term holds a space or a line feed.
    return zlib.compress("\n".join(f"{n} {' '.join(sorted(terms))}" for n, terms in by_count.items()).encode("utf-8", "surrogatepass")) if counts else None


def unpack_terms(packed: bytes | None) -> list[tuple[int, list[str]]]:
    """Each count with the terms that have it."""
    lines = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if packed else []
    return [(int(n), terms) for n, *terms in (line.split(" ") for line in lines)]


_GAPS = " \t\n\x0b\f\r" + TOKEN_SEPARATORS[3:-2]
_PART, _LONGER = (re.compile(f"[^{_GAPS}]{{{n},}}") for n in (2, 5))
_IS_GAP = np.zeros(1 << 16, bool)
_IS_GAP[[ord(x) for x in _GAPS]] = True
#: Texts are cut together up to so many characters.
_TOGETHER = 1_000_000


def _pieces(texts: pd.Series) -> pd.Series:
    """The distinct parts of 2 to 30 characters and windows of each lower-cased text, a line for each; none holds white space."""
    out = []
    for _, some in texts.groupby(texts.str.len().cumsum() // _TOGETHER, sort=False):
        for text, windows in zip(some, _windows(list(some)), strict=True):
            # Parts of up to 4 characters are windows.
            out.append("\n".join(chain(windows, {p for p in _LONGER.findall(text) if len(p) <= 30})))
    return pd.Series(out, dtype=object)


def _windows(texts: list[str]) -> list[list[str]]:
    """The distinct windows of each text: up to 4 characters from any place on, 2 at least, without a separator."""
    codes = np.frombuffer(("\n".join(texts) + "\n" * 4).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.bincount(codes, minlength=0x110000) > 0
    used[[ord(x) for x in _GAPS]] = False
    alphabet = np.flatnonzero(used).astype(np.uint32)
    if len(alphabet) >= 1 << 16:  # a window of so many kinds of characters doesn't fit 64 bits
        return [list({p[i : i + 4] for p in _PART.findall(t) for i in range(len(p) - 1)}) for t in texts]
    rank = np.zeros(0x110000, np.uint64)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)
    x = rank[codes]  # 0 for a separator
    n = len(x) - 3
    w, open_ = x[:n] << np.uint64(48), x[:n] > 0
    for k in (1, 2, 3):
        open_ = open_ & (x[k : k + n] > 0)
        w |= np.where(open_, x[k : k + n], 0) << np.uint64(48 - 16 * k)
    ends = np.cumsum([len(t) + 1 for t in texts])
    several = (x[:n] > 0) & (x[1 : n + 1] > 0)
    own = [np.unique(w[a:b][several[a:b]]) for a, b in zip(ends - [len(t) + 1 for t in texts], ends, strict=True)]
    distinct, at = np.unique(np.concatenate(own), return_inverse=True)
    places = (distinct[:, None] >> np.array([48, 32, 16, 0], np.uint64)) & np.uint64(0xFFFF)
    chars = np.append(np.uint32(10), alphabet)[np.append(places, np.zeros((len(places), 1), np.uint64), axis=1).astype(np.int64)]
    kept = np.append(places > 0, np.ones((len(places), 1), bool), axis=1)  # a line end after each window
    names = np.array(chars[kept].tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1], object)
    return [list(x) for x in np.split(names[at], np.cumsum([len(x) for x in own])[:-1])]


#: So many distinct terms a task holds before it hands their counts on.
_HELD = 2_000_000


def window_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (id, text, whole), lower-cased: (term, digest, id, df), how many texts have each term of :func:`tokenize_windows`.

    Windows of many texts are counted at once as numbers. A whole text of more than 30 characters is named by its digest and an id that has it. A
    term may come in several rows, whose counts are to be added.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    others: Counter = Counter()  # terms that are no number
    for batch in batches:
        ids, texts, wholes = (batch.column(n).to_pylist() for n in ("id", "text", "whole"))
        digests = []
        for i, whole in zip(ids, wholes, strict=True):
            if len(whole) > 30:
                digests.append((hashlib.sha256(whole.encode("utf-8", "surrogatepass")).digest(), i))
            elif len(whole) == 1 or any(x in whole for x in _GAPS):  # else it is a part or a window
                others[whole] += 1
        if digests:
            yield _counts([None] * len(digests), [1] * len(digests), [d for d, _ in digests], [i for _, i in digests], batch)
        sizes = np.cumsum([len(t) for t in texts])
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // _TOGETHER)) + 1):
            some = [texts[i] for i in at]
            others.update(chain.from_iterable({p for p in _LONGER.findall(t) if len(p) <= 30} for t in some))
            plain, odd = some, []
            if not _is_plain("".join(some)):
                plain, odd = [t for t in some if _is_plain(t)], [t for t in some if not _is_plain(t)]
            others.update(chain.from_iterable({p[i : i + 4] for p in _PART.findall(t) for i in range(len(p) - 1)} for t in odd))
            if plain:
                held.append(_numbered(plain))
        if len(held) > 1 and sum(len(x) for x, _ in held) > _HELD or len(held) > 64:
            held = [_added(held)]
        if held and len(held[0][0]) > _HELD:
            for x in _parts(_added(held), batch):
                yield x
            held = []
        if len(others) > _HELD // 2:
            yield _counts(list(others), list(others.values()), None, None, batch)
            others = Counter()
    if held:
        yield from _parts(_added(held), batch)
    if others:
        yield _counts(list(others), list(others.values()), None, None, batch)


def _is_plain(text: str) -> bool:
    """Whether windows of a text are numbers: each character is one code unit, none is 0."""
    return "\0" not in text and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text))


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts, four code units in 64 bits each, 0 behind their end; and in how many texts each is."""
    x = np.frombuffer(("\n".join(texts) + "\n" * 4).encode("utf-16-le"), np.uint16)
    open_ = ~_IS_GAP[x]
    n = len(x) - 3
    several = open_[:n] & open_[1 : n + 1]
    w = x[:n].astype(np.uint64) << np.uint64(48)
    so_far = open_[:n]
    for k in (1, 2, 3):
        so_far = so_far & open_[k : k + n]
        w |= np.where(so_far, x[k : k + n], 0).astype(np.uint64) << np.uint64(48 - 16 * k)
    starts = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    own = [np.sort(w[a:b][several[a:b]]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return _counted(np.concatenate([x[np.append(True, x[1:] != x[:-1])] if len(x) else x for x in own]))


def _counted(numbers: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, in order, each with how often it comes, or with the sum of its counts."""
    if not len(numbers):
        return numbers, np.zeros(0, np.int64)
    if counts is None:
        numbers, sums = np.sort(numbers), None
    else:
        order = np.argsort(numbers, kind="stable")
        numbers, sums = numbers[order], counts[order]
    at = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    return numbers[at], np.diff(np.append(at, len(numbers))) if sums is None else np.add.reduceat(sums, at)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    return _counted(np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held]))


def _parts(counted: tuple[np.ndarray, np.ndarray], like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Windows by name, some at a time."""
    for a in range(0, len(counted[0]), 200_000):
        numbers, counts = (x[a : a + 200_000] for x in counted)
        units = (numbers[:, None] >> np.array([48, 32, 16, 0], np.uint64)).astype(np.uint16)
        lines = np.append(units, np.full((len(units), 1), 10, np.uint16), axis=1)
        names = lines[lines > 0].tobytes().decode("utf-16-le").split("\n")[:-1]
        yield _counts(names, counts, None, None, like)


def _counts(terms: list, counts, digests: list | None, ids: list | None, like: pa.RecordBatch) -> pa.RecordBatch:
    n = len(terms)
    columns = [pa.array(terms, pa.string()), pa.array(digests or [None] * n, pa.binary()), pa.array(ids or [None] * n, like.schema.field("id").type), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["term", "digest", "id", "df"])


def tokenize_windows(c: Column) -> Column:
    """Distinct tokens: the whole trimmed text, its parts of 2 to 30 characters, and windows of 4 characters over each
    part, which shrink to 3 and 2 at the part's end. All lower-cased; a null or blank text has none.

    Texts are cut by numpy in tasks and come back as one string each, so a batch holds few objects.
    """
    text = F.coalesce(c, F.lit(""))
    whole = F.lower(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))
    lines = F.pandas_udf(_pieces, "string")(F.lower(text))
    # A text without parts gives one empty line.
    own = lambda x: F.array_remove(F.array_remove(F.split(x["lines"], "\n"), x["whole"]), "")
    made = lambda x: F.when(x["whole"] == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(x["whole"]), own(x)))
    # As the only element of an array, the whole text is made once and named.
    return F.element_at(F.transform(F.array(F.struct(whole.alias("whole"), lines.alias("lines"))), made), 1)


def fold_accents(c: Column) -> Column:
    """Lower-cased, without the accents of Latin letters."""
    return F.translate(F.lower(c), *_ACCENTS)


def tokenize_words(c: Column) -> Column:
    """All runs of letters and digits, lower-cased, without accents, in order."""
    return F.regexp_extract_all(fold_accents(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


@cache
def _word_codes() -> np.ndarray:
    """For each code point the letter or digit that it counts as in words, a space for any other."""
    codes = np.array([c if unicodedata.category(chr(c))[0] in "LN" else 32 for c in range(0x110000)], np.uint32)
    codes[[ord(c) for c in _ACCENTS[0]]] = [ord(c) for c in _ACCENTS[1]]
    return codes


def _spaced(text: str) -> str:
    """A lower-cased text with a space for each character that is in no word, without accents."""
    return _word_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes().decode("utf-32-le", "surrogatepass")


def holding_words(asked: frozenset[str]):
    """For mapInArrow over (doc_id, text), lower-cased: (doc_id, term) for each asked word that a word of :func:`tokenize_words` of the text holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A word has no space, so what holds it is one word.
            made = [(at, w) for at, text in enumerate(map(_spaced, batch.column("text").to_pylist())) for w in asked if w in text]
            if made:
                at, terms = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(terms, pa.string())], ["doc_id", "term"])

    return run


def asked_words(asked: frozenset[str]):
    """For mapInArrow over (doc_id, text), lower-cased: (doc_id, term, tf, dl, first), a row for each asked word of :func:`tokenize_words` that a text
    has, one without a term where it has none; dl counts all its words, first marks one row of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                words = _spaced(text).split()
                counts = Counter([w for w in words if w in asked]) or {None: 0}
                made += [(at, term, n, len(words), i == 0) for i, (term, n) in enumerate(counts.items())]
            if made:
                at, *columns = zip(*made, strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
                arrays = [batch.column("doc_id").take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "term", "tf", "dl", "first"])

    return run


def term_counts(terms: Column) -> Column:
    """Each distinct term of an array with its count, as (term, n), by term: sorted and cut where terms change, so a task holds one array."""

    def counted(sorted_terms: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(sorted_terms)), lambda i: (i == 1) | (F.get(sorted_terms, i - 1) != F.get(sorted_terms, i - 2)))
        ends = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(sorted_terms) + 1)
        cut = lambda at: F.transform(at, lambda i, k: F.struct(F.get(sorted_terms, i - 1).alias("term"), (ends(at, k) - i).cast("long").alias("n")))
        return F.element_at(F.transform(F.array(starts), cut), 1)

    # Without terms a sequence from 1 to 0 would count down.
    return F.when(F.size(terms) > 0, F.element_at(F.transform(F.array(F.sort_array(terms)), counted), 1)).otherwise(F.array().cast("array<struct<term:string,n:bigint>>"))


def ngrams(c: Column, n: int) -> Column:
    """All n-character pieces of a text, in one pass over it; a null or shorter text has none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def tokenize_mixed(c: Column) -> Column:
    """ASCII words, lower-cased, and 2- and 3-grams over the Han characters alone; repeats stay."""
    text = F.coalesce(c, F.lit(""))
    han = F.regexp_replace(text, r"[^一-鿿]", "")
    words = F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z][a-zA-Z0-9-]*)")), lambda w: F.lower(w))
    return F.concat(words, ngrams(han, 2), ngrams(han, 3))


def normalize_term(c: Column, synonyms: dict[str, str]) -> Column:
    """The canonical term of a synonym (by trimmed lower case), else the trimmed original."""
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    found = F.create_map(*pairs)[F.lower(F.trim(c))] if pairs else F.lit(None)
    return F.coalesce(found, F.trim(c))


def normalize_terms(c: Column, synonyms: dict[str, str]) -> Column:
    return F.array_distinct(F.transform(c, lambda t: normalize_term(t, synonyms)))


def bigram_set(c: Column) -> Column:
    return F.array_distinct(ngrams(F.coalesce(c, F.lit("")), 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of character 2-grams: 1 if both are empty, 0 if one is."""
    x, y = bigram_set(a), bigram_set(b)

    def share(sets: Column) -> Column:  # the sets are made once and named
        met = F.size(F.array_intersect(sets[0], sets[1]))
        both = F.size(sets[0]) + F.size(sets[1])
        return F.when(both == 0, F.lit(1.0)).otherwise(met / (both - met))

    return F.element_at(F.transform(F.array(F.array(x, y)), share), 1)


#: Terms of more characters are searched for each shorter one, so that a very long one isn't cut at every place.
_CUT = 64


def maximal_terms(terms: Column, least: int = 3) -> Column:
    """Distinct terms of at least so many characters that no longer term holds, in order of appearance.

    A term is cut into its pieces of just those lengths that shorter terms have, and what is among these pieces goes; so the work
    follows the characters, not the pairs of terms.
    """

    def held(kept: Column, lengths: Column, t: Column) -> Column:
        n = F.char_length(t)
        pieces = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(t, i, k))
        cut = F.flatten(F.transform(F.filter(lengths, lambda k: k < n), pieces))
        return F.when(n <= _CUT, cut).otherwise(F.filter(kept, lambda u: (F.char_length(u) < n) & F.contains(t, u)))

    def top(x: Column) -> Column:
        return F.array_except(x["kept"], F.flatten(F.transform(x["kept"], lambda t: held(x["kept"], x["lengths"], t))))

    def measured(kept: Column) -> Column:
        return F.struct(kept.alias("kept"), F.array_distinct(F.transform(kept, lambda t: F.char_length(t))).alias("lengths"))

    kept = F.filter(F.array_distinct(terms), lambda t: F.char_length(t) >= least)
    # As the only element of an array, the terms and their lengths are made once and named.
    return F.element_at(F.transform(F.transform(F.array(kept), measured), top), 1)


def drop_substrings(terms: Column, least: int = 3) -> Column:
    """:func:`maximal_terms`, longest first, ties by text."""
    keyed = F.transform(maximal_terms(terms, least), lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))
    return F.transform(F.sort_array(keyed), lambda s: s["t"])


def term_union(*arrays: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*arrays)))


def area_tags(c: Column, n: int = 4, most: int = 15) -> Column:
    """The first n parts that are short and no sentences."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), TAG_SEPARATORS), lambda t: F.trim(t)), lambda t: F.char_length(t).between(1, most) & ~t.rlike("[。！？年]"))
    return F.slice(parts, 1, n)


def snippet(c: Column, n: int) -> Column:
    """White space collapsed, cut to n characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.char_length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def written_title(html: Column) -> Column:
    """What stands in the first title element as it is written, but for &amp;, with white space collapsed; "" without one, null for null html.

    Other references stay; :func:`~lodestar.operators.pages.parse` reads a title as a browser does.
    """
    inner = F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(F.replace(inner, F.lit("&amp;"), F.lit("&")), r"[ \t\n\f\r]+", " "))


def conversation_title(c: Column) -> Column:
    return snippet(c, 30)


# Titles that a page may name, and looser ones that count where none of these is.
TITLES = "正教授 特聘教授 长聘教授 讲席教授 冠名教授 教授 副教授 助理教授 讲师 助理讲师 研究员 副研究员 助理研究员 高级工程师 正高级工程师 工程师 博士生导师 硕士生导师 博导 硕导".split()
LOOSE_TITLES = ["Professor", "Associate Professor", "Assistant Professor", "Lecturer", "Researcher", "Research Fellow", "Postdoc", "特聘研究员", "青年研究员", "青年教授", "四青人才", "青年长江", "青年千人"]


def extract_title(c: Column) -> Column:
    """The title named first, else the first of the looser ones; null if none."""
    first = lambda words: F.nullif(F.regexp_extract(c, f"({'|'.join(words)})", 1), F.lit(""))
    return F.coalesce(first(TITLES), first(LOOSE_TITLES))


def extract_email(c: Column) -> Column:
    """The first address of plain shape; null if none."""
    return F.nullif(F.regexp_extract(c, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", 1), F.lit(""))


# Labels of research areas in order of precedence, whether a colon must follow, the least and most characters of the areas, and what ends them.
AREA_LABELS = (
    ("研究方向", True, 8, 300, "。；;\n\r"),
    ("研究领域", True, 8, 300, "。；;\n\r"),
    ("主要方向", True, 8, 300, "。；;\n\r"),
    ("主要研究方向", False, 8, 300, "。；;\n\r"),
    ("主要研究领域", False, 8, 300, "。；;\n\r"),
    ("主要研究方面", False, 8, 300, "。；;\n\r"),
    ("研究兴趣", True, 8, 300, "。；;\n\r"),
    ("研究内容", True, 8, 300, "。；;\n\r"),
    ("Research Interests", False, 8, 400, ".;\n\r"),
    ("Research Interest", False, 8, 400, ".;\n\r"),
    ("Research Areas", False, 8, 400, ".;\n\r"),
    ("Research Area", False, 8, 400, ".;\n\r"),
    ("Specializations", False, 8, 400, ".;\n\r"),
    ("Specialization", False, 8, 400, ".;\n\r"),
    ("个人简介", False, 15, 400, "。\n"),
)


def _labelled(c: Column, label: str, colon: bool, least: int, most: int, ends: str) -> Column:
    """What stands between a label and the next end mark, or the end of the text; null if that is too short or too long.

    An end mark within the first ``least`` characters doesn't end it, a line break there does.
    """
    words = r"\s+".join(label.split(" "))
    rest = F.ltrim(F.try_element_at(F.split(c, f"(?i){words}\\s*{'[：:]' if colon else '[：:]?'}", 2), F.lit(2)))
    value = F.concat(F.left(rest, F.lit(least)), F.element_at(F.split(F.substr(rest, F.lit(least + 1)), f"[{ends}]", 2), 1))
    fits = F.char_length(value).between(least, most) & ~F.left(rest, F.lit(least)).rlike(r"[\r\n]")
    return F.when(fits, value)


def extract_areas(c: Column, labels=AREA_LABELS, most: int = 400) -> Column:
    """What follows the first label that has something after it, in the order of the labels, up to ``most`` characters, lines joined by ；; null if none."""
    found = F.coalesce(*[_labelled(c, *label) for label in labels])
    return F.left(F.regexp_replace(F.trim(found), r"[\r\n]+", "；"), F.lit(most))


def extract_dates(c: Column) -> Column:
    """All days from 2023 to 2049 written as numbers of year, month and day, in order, as they are written; days that no calendar has don't count."""
    written = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9]{4}(?:年[0-9]{1,2}月|[-/.][0-9]{1,2}[-/.])[0-9]{1,2}日?)"))

    def is_day(date: Column) -> Column:
        n = F.split(date, "[^0-9]+")
        day = F.try_to_timestamp(F.concat_ws("-", n[0], n[1], n[2]), F.lit("yyyy-M-d"))
        return day.isNotNull() & F.year(day).between(2023, 2049)

    return F.filter(written, is_day)


def deadline(c: Column) -> Column:
    """The last date named; null if none."""
    return F.try_element_at(extract_dates(c), F.lit(-1))


def _plain_digits(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "０１２３４５６７８９％", "0123456789%")


def _clauses(c: Column) -> Column:
    return F.split(_plain_digits(c), "[，。\n]")


def _first(values: Column) -> Column:
    """The first value that isn't null."""
    return F.try_element_at(F.array_compact(values), F.lit(1))


# Words of admission, and how many characters may stand between one and a number of persons.
ADMISSION = ("招收", "接收", "接受")
ADMISSION_GAP = 15


def extract_quota(c: Column) -> Column:
    """How many are admitted: in the first clause that says so, the number of persons soon after a word of admission; else the number before 名额.

    Null if there is none, or if it is too large for a whole number.
    """

    def after_word(clause: Column) -> Column:
        rest = F.try_element_at(F.split(clause, "|".join(ADMISSION), 2), F.lit(2))
        persons = F.regexp_substr(rest, F.lit(r"[0-9]+\s*[人名]"))
        return F.when(F.position(persons, rest) <= ADMISSION_GAP + 1, F.regexp_substr(persons, F.lit("[0-9]+")).try_cast("int"))

    before = F.split(_plain_digits(c), "名额")
    places = F.transform(F.slice(before, 1, F.size(before) - 1), lambda x: F.regexp_substr(F.regexp_replace(x, r"(?:个|招生|\s)+$", ""), F.lit("[0-9]+$")).try_cast("int"))
    return F.coalesce(_first(F.transform(_clauses(c), after_word)), _first(places))


def extract_gpa(c: Column) -> Column:
    """The grade that stands after GPA and a sign of comparison; null if none."""
    after = F.transform(F.split(_plain_digits(c), "(?i)gpa"), lambda x: F.ltrim(x))
    asked = F.filter(F.slice(after, 2, F.size(after)), lambda x: F.left(x, F.lit(1)).isin("≥", ">", "≧", "="))
    return _first(F.transform(asked, lambda x: F.regexp_substr(F.ltrim(x, F.lit("≥>≧= ")), F.lit(r"^[0-9]+(\.[0-9]+)?")).try_cast("double")))


def extract_rank(c: Column) -> Column:
    """The share of a year's best that may apply, in percent: the number after 前, if 排 or 排名 stands before it and a percent sign after the number, or
    if 成绩 stands at most ten characters before it in the clause; null if none."""

    def in_clause(clause: Column) -> Column:
        parts = F.split(clause, "前")

        def at(tail: Column, i: Column) -> Column:
            head, number = F.element_at(parts, i + 1), F.regexp_substr(F.ltrim(tail), F.lit("^[0-9]+"))
            ranked = head.rlike("排名?$") & F.ltrim(tail).rlike("^[0-9]+%")
            graded = head.rlike("成绩.{0,10}$")
            return F.when(ranked | graded, number.try_cast("int"))

        return _first(F.transform(F.slice(parts, 2, F.size(parts)), at))

    return _first(F.transform(_clauses(c), in_clause))


# Fixed value: phrases by which a page says that it takes students.
RECRUITING = r"正在招收|本年度招[收生]|招收推免|接收保研|欢迎[联系报考优]|招募学生|诚招|招收硕[士博]|open\s+position|looking\s+for\s+student|joining\s+(?:our\s+)?group|welcome.*student|欢迎.*联系"


def is_recruiting(c: Column, words: str = RECRUITING) -> Column:
    return F.coalesce(c.rlike(f"(?i){words}"), F.lit(False))


def clean_name(c: Column) -> Column:
    """A name without titles, brackets, ASCII characters and separators; "" unless 2 to 5 Han characters are left."""
    n = F.regexp_replace(F.coalesce(c, F.lit("")), r"（[^）]*）|\([^)]*\)|副教授|教授|博士生导师|博士|导师|讲师|研究员|院士|老师", "")
    n = F.regexp_replace(n, r"[\x00-\x7f\s·•、，。：；　]", "")
    return F.when(n.rlike(r"^[一-鿿]{2,5}$"), n).otherwise("")


def char_count_han(c: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^一-鿿]", ""))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first (pattern, value) rule whose pattern occurs; used to guess provinces."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def cross_domain(note: Column, domains: list[tuple[str, list[str]]]) -> Column:
    """The terms of the first key that the note holds; an empty array means a pure school."""
    out = F.array().cast("array<string>")
    for key, terms in reversed(domains):
        out = F.when(F.contains(F.coalesce(note, F.lit("")), F.lit(key)), F.array(*map(F.lit, terms))).otherwise(out)
    return out


def strip_prefix(org: Column, university: Column) -> Column:
    """An organisation without its university: the full name in front, else its first 4, 3 or 2 characters."""
    out = org
    for n in (2, 3, 4):
        cut = F.left(university, F.lit(n))
        out = F.when(F.startswith(org, cut), F.substring(org, F.lit(n + 1), F.char_length(org))).otherwise(out)
    return F.trim(F.when(F.startswith(org, university), F.substring(org, F.char_length(university) + 1, F.char_length(org))).otherwise(out))


def title_from_citations(cited: Column) -> Column:
    return F.when(cited >= 5000, "教授").when(cited >= 800, "副教授").otherwise("讲师/研究员")


def title_from_h_index(h: Column) -> Column:
    return F.when(h >= 20, "教授").when(h >= 10, "副教授").otherwise("讲师/研究员")


def interests(subfields: Column, topics: Column) -> Column:
    """At most 4 subfields, then topics until 5 distinct, joined by ；."""
    return F.array_join(F.slice(F.array_distinct(F.concat(F.slice(F.array_distinct(subfields), 1, 4), topics)), 1, 5), "；")


def years_kept(counts: Column, low: int = 2015, high: int = 2030) -> Column:
    return F.filter(counts, lambda x: x["y"].between(low, high))


def active_year(counts: Column) -> Column:
    """The last year with any work; null if none."""
    return F.array_max(F.transform(F.filter(years_kept(counts), lambda x: x["w"] > 0), lambda x: x["y"]))


# The nine universities whose people are ranked higher.
FAVOURED = ("清华大学", "北京大学", "复旦大学", "上海交通大学", "浙江大学", "中国科学技术大学", "南京大学", "哈尔滨工业大学", "西安交通大学")


def tier_boost(university: Column, favoured: tuple[str, ...] = FAVOURED, boost: float = 1.3) -> Column:
    """1.3 if the name holds one of the favoured nine."""
    hit = F.coalesce(university.rlike("|".join(favoured)), F.lit(False))
    return F.when(hit, F.lit(boost)).otherwise(F.lit(1.0))


def gpa_factor(gpa: Column, rank_pct: Column, top5: Column) -> Column:
    """1 if the grade reaches the least one (3.7 for the top five, else 3.3) and the rank is in the first 20 %, 0.6 if both are far off, else 0.85."""
    least = F.when(top5, 3.7).otherwise(3.3)
    return F.when((gpa >= least) & (rank_pct <= 20), 1.0).when((gpa < least - 0.3) & (rank_pct > 30), 0.6).otherwise(0.85)


def gpa_bucket(gpa: Column) -> Column:
    """The bucket that is stored."""
    return F.when(gpa >= 3.8, "high").when(gpa >= 3.5, "mid").otherwise("low")


def gpa_match_bucket(gpa: Column) -> Column:
    """The bucket that comparisons of users use; its edges differ from those stored."""
    return F.when(gpa >= 3.7, "high").when(gpa >= 3.4, "mid").otherwise("low")


def com_label(code: Column) -> Column:
    labels = {"strong": "强", "weak": "弱", "mix_ds": "博弱+硕强", "mix_sd": "博强+硕弱", "cas_mix": "所混合"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code], F.lit("未知"))


def reason_text(parts: list[tuple[Column, str]]) -> Column:
    """Phrases whose conditions hold, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in parts])), "；")


def match_reason(terms: Column, n: int = 3) -> Column:
    kept = F.slice(drop_substrings(terms), 1, n)
    return F.when(F.size(kept) > 0, F.concat(F.lit("匹配方向："), F.array_join(kept, "、"))).otherwise("综合匹配")


def render_template(template: Column, variables: Column) -> Column:
    """Each {name} replaced by its value in a map; a null value by nothing."""
    return F.reduce(F.map_entries(variables), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def salvage_json(c: Column, keys: list[str]) -> Column:
    """A map of string fields from noisy JSON: fences are stripped, the outer braces cut out, and a field that strict
    parsing lost is looked for on its own; of both readings the longer one counts. A missing field is null."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), "```[a-zA-Z]*", ""), r"(?s)(\{.*\})", 1)
    strict = F.from_json(body, "map<string,string>")
    out = []
    for k in keys:
        loose = F.nullif(F.regexp_extract(body, rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
        first = strict[k]
        out += [F.lit(k), F.when(F.length(F.coalesce(loose, F.lit(""))) > F.length(F.coalesce(first, F.lit(""))), loose).otherwise(first)]
    return F.create_map(*out)


def edu_dates(c: Column) -> Column:
    """(start, end) of a course of study as YYYY.MM: the first date starts it; words for now end it four years later in June."""
    year, month = F.regexp_extract(c, r"(20[0-9]{2})[.年/-]([0-9]{1,2})", 1), F.regexp_extract(c, r"(20[0-9]{2})[.年/-]([0-9]{1,2})", 2)
    start = F.when(year != "", F.concat(year, F.lit("."), F.lpad(month, 2, "0")))
    end = F.when((year != "") & c.rlike("至今|在读|present|now"), F.concat((F.try_to_number(F.nullif(year, F.lit("")), F.lit("9999")) + 4).cast("int").cast("string"), F.lit(".06")))
    return F.struct(start.alias("start"), end.alias("end"))


def promote_section(c: Column, marker: str, least: int = 3500, most: int = 4000) -> Column:
    """In a text over ``least`` characters the part from the marker on comes first; then it is cut at ``most``."""
    at = F.instr(c, marker)
    moved = F.when((F.char_length(c) > least) & (at > 1), F.concat(F.substring(c, at, F.char_length(c)), F.lit("\n"), F.substring(c, F.lit(1), at - 1))).otherwise(c)
    return F.left(moved, F.lit(most))


def venue_counts(c: Column, venues: dict[str, str], word_boundary: bool = False) -> Column:
    """Distinct venue names of each grade A, B, C that the text holds, as a struct; names are substrings unless ``word_boundary``."""
    text = F.lower(F.coalesce(c, F.lit("")))
    hit = (lambda v: text.rlike(r"(?<![a-z0-9])\Q" + v.lower() + r"\E(?![a-z0-9])")) if word_boundary else (lambda v: F.contains(text, F.lit(v.lower())))
    return F.struct(*[sum((hit(v).cast("int") for v, g in venues.items() if g == grade), F.lit(0)).alias(grade.lower()) for grade in "ABC"])


def activity_score(bio: Column, pubs: Column, venue_a: Column, grants=("NSFC", "国家自然科学基金", "重点研发", "863", "973")) -> Column:
    """50 + 8 for each of the years 2022 to 2025 in the publications + at most 30 for A venues + 5 for each grant word, at most 100."""
    text = lambda c: F.coalesce(c, F.lit(""))
    years = sum((F.when(F.contains(text(pubs), F.lit(str(y))), 8).otherwise(0) for y in range(2022, 2026)), F.lit(0))
    words = sum((F.when(F.contains(text(bio), F.lit(g)), 5).otherwise(0) for g in grants), F.lit(0))
    return F.least(F.lit(100), F.lit(50) + years + F.least(F.lit(30), venue_a * 3) + words)
