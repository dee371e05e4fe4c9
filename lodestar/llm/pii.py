"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: for each kind the base form, and looser forms. Base spans that
pass their check always stand. The looser ones are judged by boosted trees over format and context features. The trees
learn from two tables of equal weight: base candidates of the corpus, which pass or fail their checks, and looser forms
that :data:`LESSONS` puts into personal and other contexts. A threshold for each kind is calibrated for precision on a part of the
looser forms that the trees didn't see. Features are bits, so counts of candidates by bit pattern are all that training
needs, from all rows; they make a table of at most 8 * 2**len(FEATURES) rows a fold. Trees are compiled into one
expression. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage

KINDS = ("email", "ip", "card", "phone")

#: (kind, looser form?, pattern, texts without which it isn't looked for). Possessive parts and the looks behind make
#: matching linear and stack-free, and leave the matches of the plain forms as they are.
GENERATORS = (
    (0, False, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    (1, False, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "digits"),
    (2, False, r"[0-9](?:[\x20-]?[0-9])++", "digits"),
    (3, False, r"\+[0-9][\x20().0-9-]+[0-9]", "digits and contains(t, '+')"),
    (0, True, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}", "t rlike '[\\\\[(](?i:at)[\\\\])]'"),
    (1, True, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "digits and contains(t, ':')"),
    (2, True, r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9])", "digits"),
    (3, True, r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9]{8,12}(?![0-9])", "digits"),
)

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Bits that a tree may ask for, as expressions over span (its text), before and after (the text around it), n (its digits).
FEATURES = {
    "embedded": "before rlike '[A-Za-z0-9]$' or after rlike '^[A-Za-z0-9]'",
    "valid": "case kind when 2 then n between 13 and 19 and {luhn} when 3 then n between 10 and 15 else true end",
    "denied": "lower(before) rlike '(?:part|order|item|version|serial|isbn|ref|reference|invoice|model|catalog|catalogue|article|sku|lot|batch|ticket|case|issue|release|build|id|key|fingerprint|checksum|hash|mac|sum|score|range|code|artikel|pedido|commande)(?:[^a-z]+(?:no|nr|number|id|code|is|was))*[^a-z]*$'",
    "pairs": "span rlike '^(?:[0-9A-Fa-f]{2}:){7}[0-9A-Fa-f]{2}$'",
    "assigned": "before rlike '[=#/\"]\\\\s*$'",
    "announced": "lower(before) rlike '(?:tel|phone|telefon|telefono|call|dial|ring|mobile|cell|fax|contact|mail|card|visa|mastercard|account|server|host|address|ip|ipv6|reach|text|write|whatsapp)(?:[^a-z]+(?:is|at|on|to|no|nr|number|me|us|him|her|them|my|the|under))*[^a-z]*$'",
    "separated": "span rlike '[\\\\x20().:/_-]'",
    "digits_10": "n >= 10",
    "digits_13": "n >= 13",
    "digits_20": "n >= 20",
    "opened": "span rlike '^(?:[+(]|00)'",
    "grouped": "span rlike '^(?:[+][0-9]{1,3}[\\\\x20.-]?)?[(]?[0-9]{3}[)]?[\\\\x20.-]+[0-9]{3}[\\\\x20.-][0-9]{4}$|^(?:[0-9]{4}[\\\\x20._/-]?){3}[0-9]{4}$'",
    "domain": "span rlike '[.\\\\])][\\\\x20]?[A-Za-z]{2,}$'",
}


@dataclass(frozen=True)
class Node:
    """A split on a bit, or a leaf if ``bit`` is None."""

    bit: int | None
    no: Node | None = None
    yes: Node | None = None
    value: float = 0.0

    def score(self, pattern: int) -> float:
        return self.value if self.bit is None else (self.yes if pattern >> self.bit & 1 else self.no).score(pattern)

    def sql(self) -> str:
        return f"{self.value!r}D" if self.bit is None else f"case when (pattern & {1 << self.bit}) <> 0 then {self.yes.sql()} else {self.no.sql()} end"


@dataclass(frozen=True)
class Trees:
    base: float
    trees: tuple[Node, ...]
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)  #: by kind; no probability reaches 2

    def probability(self, pattern: int) -> float:
        return 1 / (1 + math.exp(-self.base - sum(t.score(pattern) for t in self.trees)))

    def column(self) -> Column:
        """Probability as an expression over ``pattern``."""
        return F.expr(f"1 / (1 + exp(-({' + '.join([f'{self.base!r}D', *(t.sql() for t in self.trees)])})))")

    def selects(self) -> Column:
        """Whether ``probability`` reaches the threshold of ``kind``."""
        return F.expr(f"probability >= get(array({', '.join(f'{t!r}D' for t in self.thresholds)}), kind)")


def _grow(rows: list[tuple[int, float, float]], bits: int, depth: int) -> Node:
    """A tree over (pattern, gradient, curvature): the splits that lower the loss most."""
    total = lambda some: (sum(r[1] for r in some), sum(r[2] for r in some))
    gain = lambda g, h: g * g / (h + 1.0)
    g, h = total(rows)
    best = (1e-6, None)
    for bit in range(bits if depth else 0):
        yes = [r for r in rows if r[0] >> bit & 1]
        if yes and len(yes) < len(rows):
            gy, hy = total(yes)
            better = gain(gy, hy) + gain(g - gy, h - hy) - gain(g, h)
            if better > best[0]:
                best = (better, bit)
    if best[1] is None:
        return Node(None, value=0.3 * g / (h + 1.0))
    bit = best[1]
    return Node(bit, _grow([r for r in rows if not r[0] >> bit & 1], bits, depth - 1), _grow([r for r in rows if r[0] >> bit & 1], bits, depth - 1))


def boost(counts: list[tuple[int, float, float]], rounds: int = 60, depth: int = 4, step_weight: float = 10_000.0) -> Trees:
    """Fits trees to (pattern, weight of candidates, weight of those that are personal). Without both classes nothing is ever selected."""
    n, good = sum(c for _, c, _ in counts), sum(k for _, _, k in counts)
    if not 0 < good < n:
        return Trees(-30.0, ())
    bits = len(FEATURES) + 3
    base = math.log(good / (n - good))
    score = {p: base for p, _, _ in counts}
    scale = min(1.0, step_weight / n)
    trees = []
    for _ in range(rounds):
        rows = []
        for p, c, k in counts:
            q = 1 / (1 + math.exp(-score[p]))
            rows.append((p, scale * (k - c * q), scale * c * q * (1 - q)))
        tree = _grow(rows, bits, depth)
        trees.append(tree)
        for p in score:
            score[p] += tree.score(p)
    return Trees(base, tuple(trees))


def calibrate(model: Trees, counts: list[tuple[int, float, float]], precision: float = 0.95) -> Trees:
    """Sets each kind's threshold, 0.5 at least, to the least probability from which on at least ``precision`` of these looser candidates are personal."""
    thresholds = []
    for kind in range(len(KINDS)):
        threshold, seen, passed = 2.0, 0.0, 0.0
        own = [(model.probability(p), c, k) for p, c, k in counts if p >> len(FEATURES) & 3 == kind]
        for q, c, k in sorted(own, reverse=True):
            seen, passed = seen + c, passed + k
            if passed >= precision * seen:
                threshold = max(q, 0.5)
        thresholds.append(threshold)
    return Trees(model.base, model.trees, tuple(thresholds))


#: What training puts looser forms into: kind, personal?, the text around {x}, and shapes of x, in which # is any digit, & a checked
#: card number, ! a card number that fails its check, h any group of hexadecimal digits and w any short word.
LESSONS = (
    (3, True, ("call {x} today", "tel {x}", "phone: {x}", "my mobile is {x}", "reach me at {x} after six", "Fax {x}.", "or dial {x}", "contact us: {x}", "{x}", "she lives there, {x}", "text me on {x}", "Telefon {x}"), ("(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "00##########")),
    (3, False, ("part no. {x} in stock", "order {x} shipped", "item {x}", "version {x}", "serial number {x}", "isbn {x}", "ref: {x}", "invoice no {x}", "model {x} fits", "catalog number is {x}", "sku={x}", "/img/{x}"), ("###-###-####", "###.###.####", "### ### ####", "00##########")),
    (2, True, ("card {x}", "visa: {x}", "paid with {x}", "my account is {x}", "{x}", "card number {x} expires soon"), ("&",)),
    (2, False, ("card {x}", "serial {x}", "{x}", "key {x}", "part {x} in stock", "paid with {x}"), ("!",)),
    (2, False, ("serial no {x}", "key is {x}", "sku={x}", "batch {x}", "license code {x}"), ("&",)),
    (1, True, ("server {x}", "host: {x}", "address is {x}", "from {x} port 22", "{x}", "logged in at {x}", "ip {x}"), ("h:h:h:h:h:h:h:h",)),
    (1, False, ("key fingerprint {x}", "checksum {x}", "mac {x}", "hash is {x}", "{x}", "id {x}"), ("hh:hh:hh:hh:hh:hh:hh:hh",)),
    (1, False, ("key fingerprint {x}", "checksum {x}", "hash is {x}", "score {x}"), ("h:h:h:h:h:h:h:h",)),
    (0, True, ("mail {x}", "write to {x} please", "contact: {x}", "{x}", "reach me at {x}", "address {x}"), ("w [at] w.com", "w(at)w.org", "w [at] w [dot] net", "w.w (at) w.de", "w [at] w (dot) w (dot) com")),
    (0, False, ("look {x}", "see {x}", "we meet {x}", "{x}"), ("w (at) 9.30", "w [at] w.5", "w (at) 10.15")),
)


def lessons(spark: SparkSession, each: int = 12) -> DataFrame:
    """(doc_id, text, kind, personal): each context of :data:`LESSONS` with each shape, ``each`` times, with made-up digits and words; the same at every call."""
    rng = random.Random(11)
    pick = lambda some, n: "".join(rng.choices(some, k=n))

    def card(good: bool) -> str:
        digits = pick("3456", 1) + pick("0123456789", 14)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(digits))
        last = (-total) % 10 if good else (-total + rng.randint(1, 9)) % 10
        sep = rng.choice("./_")
        return sep.join((digits + str(last))[i : i + 4] for i in range(0, 16, 4))

    def fill(shape: str) -> str:
        if shape in "&!":
            return card(shape == "&")
        if ":" in shape:
            return ":".join(pick("0123456789abcdef", 2 if g == "hh" else rng.choice((1, 3, 4, 4, 4))) for g in shape.split(":"))
        shape = re.sub("#", lambda _: pick("0123456789", 1), shape)
        return re.sub(r"\bw\b", lambda _: pick("abcdefghijklmnoprstuvw", rng.randint(3, 8)), shape) if "#" not in shape else shape

    rows = []
    for kind, personal, contexts, shapes in LESSONS:
        for context in contexts:
            for shape in shapes:
                for _ in range(each):
                    rows.append({"doc_id": len(rows), "text": context.replace("{x}", fill(shape)), "lesson_kind": kind, "personal": personal})
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<doc_id: bigint, text: string, lesson_kind: int, personal: boolean>>")
    return spark.range(1).select(F.inline(made))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: int, loose: bool, pattern: str, when: str) -> str:
    """All matches of one generator with the text between them; nothing if the text lacks what it needs."""
    p = _literal(pattern)
    made = f"transform(regexp_extract_all(t, {p}, 0), (x, i) -> named_struct('kind', {kind}, 'loose', {str(loose).lower()}, 'i', i, 'span', x))"
    gaps = f"transform(split(t, {p}, -1), x -> named_struct('gap', length(x), 'tail', right(x, 24), 'head', left(x, 1)))"
    none = "cast(array() as array<struct<kind:int,loose:boolean,i:int,span:string,gap:int,before:string,after:string>>)"
    zipped = f"zip_with({made}, {gaps}, (m, g) -> named_struct('kind', m.kind, 'loose', m.loose, 'i', m.i, 'span', m.span, 'gap', g.gap, 'before', g.tail, 'after', g.head))"
    # The gap after the last match pairs with no match; its head is the last match's surroundings.
    return f"case when {when} then {zipped} else {none} end"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digest, kind, loose, span, start, end, passes, pattern): all proposed spans, and one row without a span for each row of ``docs``.

    Offsets count code points, the end is exclusive. ``passes``: a base form that meets its check. ``digest``: hash of the text.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("digest", F.xxhash64("t")).withColumn("digits", F.expr("t rlike '[0-9]'"))
    found = rows.withColumn("c", F.expr(f"flatten(array({', '.join(_matches(*g) for g in GENERATORS)}))"))
    found = found.select("row", "doc_id", "digest", F.explode_outer("c").alias("c")).select("row", "doc_id", "digest", "c.*")
    own = Window.partitionBy("row", "kind", "loose").orderBy("i")
    found = found.withColumn("after", F.lead("after").over(own)).withColumn("gap", F.coalesce("gap", F.lit(0)))
    found = found.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("span"), F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("start", F.col("end") - F.length("span")).withColumn("number", F.expr("regexp_replace(span, '[^0-9]', '')")).withColumn("n", F.length("number"))
    luhn = "aggregate(sequence(1, n), 0, (a, k) -> a + (ascii(substr(number, n - k + 1, 1)) - 48) * (2 - k % 2) - case when k % 2 = 0 and ascii(substr(number, n - k + 1, 1)) > 52 then 9 else 0 end) % 10 = 0"
    passes = f"case when span is null or loose then false when kind = 0 then true when kind = 1 then span rlike '^{_BYTE}(?:[.]{_BYTE}){{3}}$' when kind = 2 then case when n between 13 and 19 then {luhn} else false end else n between 9 and 15 end"
    bits = " + ".join(f"case when {sql} then {1 << i} else 0 end" for i, sql in enumerate(FEATURES.values())).replace("{luhn}", luhn)
    found = found.withColumn("passes", F.expr(passes)).withColumn("pattern", F.expr(f"case when span is not null then {bits} + (kind << {len(FEATURES)}) + case when loose then {4 << len(FEATURES)} else 0 end end"))
    # Short numbers are no candidates, but a row stays for each document.
    worth = F.col("passes") | F.col("loose") | (F.col("n") >= 7)
    return _rows(found, worth)


def _rows(found: DataFrame, worth: Column) -> DataFrame:
    marked = found.withColumn("worth", F.coalesce(worth, F.lit(False)))
    lead = F.row_number().over(Window.partitionBy("row").orderBy(F.col("worth").desc(), "kind", "loose", "i"))
    kept = marked.withColumn("lead", lead).where("worth or lead = 1")
    span = lambda c: F.when(F.col("worth"), F.col(c)).alias(c)
    return kept.select("row", "doc_id", "digest", *[span(c) for c in ("kind", "loose", "span", "start", "end", "passes", "pattern")])


def train(found: DataFrame) -> Trees:
    """Fits the trees on base candidates of the corpus, by counts of their bit patterns, and on three quarters of :func:`lessons`; the last quarter calibrates."""
    counts = found.where("span is not null and not loose").groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("passes").alias("k"))
    corpus = sorted((r["pattern"], r["n"], r["k"]) for r in counts.collect())
    taught = lessons(found.sparkSession)
    tried = candidates(taught.select("doc_id", "text")).where("loose").join(taught.drop("text"), "doc_id").where("kind = lesson_kind")
    by_fold = tried.groupBy("pattern", (F.xxhash64("doc_id") % 4 == 0).alias("held")).agg(F.count("*").alias("n"), F.count_if("personal").alias("k")).collect()
    fit, held = (sorted((r["pattern"], r["n"], r["k"]) for r in by_fold if r["held"] == x) for x in (False, True))
    weight = sum(n for _, n, _ in fit) / max(1, sum(n for _, n, _ in corpus))
    return calibrate(boost([(p, weight * n, weight * k) for p, n, k in corpus] + fit), held)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """(row, doc_id, digest, kind, start, end, base, probability): the spans to redact, and one row with null kind for a document without any.

    Base spans that pass their checks, and looser ones whose probability reaches their kind's threshold and that overlap
    neither a base span nor a looser one that starts before. A null or empty text has no spans. Rows that repeat are
    separate (``row`` numbers them), a null id stays null, other columns are ignored. An empty table gives no rows.
    """
    found = Stage(docs.sparkSession, "pii")(candidates(docs, id_col, text_col))
    model = model or train(found)
    judged = found.withColumn("probability", F.when(F.col("span").isNotNull(), model.column())).withColumn("base", F.coalesce(F.col("passes"), F.lit(False)))
    judged = judged.withColumn("chosen", F.col("base") | F.coalesce(F.col("loose") & model.selects(), F.lit(False)))
    up = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.col("start").desc(), "end", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    clash = (F.max(F.when(F.col("chosen"), F.col("end"))).over(up) > F.col("start")) | (F.min(F.when(F.col("base"), F.col("start"))).over(down) < F.col("end"))
    judged = judged.withColumn("chosen", F.col("chosen") & (F.col("base") | ~F.coalesce(clash, F.lit(False))))
    lead = F.row_number().over(Window.partitionBy("row").orderBy(F.col("chosen").desc(), "start", "kind"))
    kept = judged.withColumn("lead", lead).where("chosen or lead = 1")
    return kept.select("row", "doc_id", "digest", *[F.when(F.col("chosen"), F.col(c)).alias(c) for c in ("kind", "start", "end", "base", "probability")])


def _joined(only: str) -> str:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return f"array_join(transform(filter(spans, s -> {only}), s -> concat(get({names}, s.kind), ':', s.start, ':', s.end)), ',')"


def summary(spans: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans (all, as kind:start:end, by kind, then start)."""
    one = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", "base")))).alias("spans"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return one.select("doc_id", *counts, F.sha2(F.expr(_joined("s.base")), 256).alias("base_sha256"), F.expr(_joined("true")).alias("spans"))


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of (doc_id, digest, kind, start, end) in the text replaced by its kind in brackets; overlapping spans make one gap.

    Spans belong to an id (null or not) and a hash of the text, so several texts of one id keep their own. A null text stays null.
    """
    names = f"array({', '.join(repr(k.upper()) for k in KINDS)})"
    marks = spans.where("kind is not null").groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("__s"))
    merged = f"""aggregate(__s, named_struct('at', cast(0 as bigint), 'text', ''), (a, s) -> named_struct('at', greatest(a.at, s.end), 'text',
        case when s.start >= a.at then concat(a.text, substr(`{text_col}`, cast(a.at + 1 as int), cast(s.start - a.at as int)), '[', get({names}, s.kind), ']') else a.text end),
        a -> concat(a.text, substr(`{text_col}`, cast(a.at + 1 as int))))"""
    out = docs.join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__digest")), "left")
    return out.select(*[F.when(F.col("__s").isNull(), F.col(c)).otherwise(F.expr(merged)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
