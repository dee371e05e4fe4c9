"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is cut into fragments. What a document has in a fragment is a row of its own; overlaps of a
pair are counted in each fragment separately, in whatever task the fragment's rows meet, and summed per pair. The
result is exact up to collisions of 64-bit hashes.

Which pairs are counted: two sets that are similar enough share a whole cell of a finer cut (see :mod:`.shingles`), so
documents meet under hashes of whole cells; of these each document keeps its rarest ones, as many as a similar partner
needs. Of each set there is a bitmap besides, twice as many bits as members, each the parity of the members that fall on
it. Two bitmaps differ in no more bits than the sets do in members, so most pairs below the threshold are left out before
any members travel.

Only one document of each set goes further, so copies cost nothing. The documents of a signature are first compared
with one of them alone, then, where many stay in different components, with others chosen by hash; what is still
unresolved is paired row by row if the documents are few, and in blocks of bounded size inside tasks if they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Stage, components, small
from .shingles import Cuts, WordHashes, batches, digests, shingle_sets

#: Fragments in which overlaps are counted apart, a range of the global order each.
FRAGMENTS = 16
#: Documents of one signature that are paired row by row; more go into blocks of so many.
FEW = 8
BLOCK = 256
#: How often the documents of a large signature are compared with one of them, as long as that halves what is unresolved.
ROUNDS = 5
#: A signature that so many sets of a sixteenth of all have is not counted by gathering its rows.
HOT = 64

KEY = ["doc_id", "which"]
#: A signature with its class, of which there are fewer than 64, in its lowest bits.
CLASSED = "(signature & -64L) | class"


def _sized(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in batches(frames, "text"):
            s, start = shingle_sets(frame["text"], n, hashes)
            a, b = digests(s, start)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_shingles": np.diff(start), "d1": a, "d2": b})

    return run


def _sketch(n: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, cuts = WordHashes(), Cuts(threshold)
        for frame in batches(frames, "text"):
            s, start = shingle_sets(frame["text"], n, hashes)
            a, b = digests(s, start)
            ids, size = frame["doc_id"].to_numpy(), np.diff(start)
            rows = cuts.signatures(s, start)
            if not rows:
                continue
            at = np.array([r[0] for r in rows], int)
            yield pd.DataFrame({"doc_id": ids[at], "n_shingles": size[at], "d1": a[at], "d2": b[at], "class": [r[1] for r in rows], "least": [r[2] for r in rows], "signatures": [r[3] for r in rows]})

    return run


def _sets(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in batches(frames, "text"):
            s, start = shingle_sets(frame["text"], n, hashes)
            which = np.where(frame["several"].to_numpy(bool), digests(s, start)[0], 0)
            rows = []
            for i, w, x, y in zip(frame["doc_id"].to_numpy(), which, start[:-1], start[1:], strict=True):
                own = s[x:y]
                ends = np.searchsorted(own, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(60))
                rows.append((i, w, y - x, *bitmaps(own), [p.view(np.int64) for p in np.split(own, ends)]))
            yield pd.DataFrame(rows, columns=["doc_id", "which", "n", "bits", "half", "parts"])

    return run


def bitmaps(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the members that fall on each of 2n bits, rounded up to a power of two, and the same folded to half as many bits."""
    words = 1 << (max(1, -(-len(members) // 32)) - 1).bit_length()
    odd = np.bincount((members & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return bits, bits[: words // 2] ^ bits[words // 2 :] if words > 1 else bits[:0]


#: Bits in which the bitmaps of a and b differ, compared at the fewer bits of both; 0 if they are too unequal to be compared.
DIFFERENT = """coalesce(aggregate(zip_with(case when size(bits_a) > size(bits_b) then half_a else bits_a end, case when size(bits_b) > size(bits_a) then half_b else bits_b end,
    (x, y) -> bit_count(x ^ y)), 0L, (t, x) -> t + cast(x as bigint)), 0L)"""


def _links(pairs: DataFrame, sets: DataFrame, threshold: float, stage: Stage) -> DataFrame:
    """Of the pairs (a, which_a, b, which_b), the (a, b) whose overlaps, counted in each fragment and summed, reach the threshold.

    Only members of sets whose pairs pass by their bitmaps travel, as long as these are few enough to be sent to where the sets lie.
    """
    side = lambda x, *more: sets.select(F.col("doc_id").alias(x), F.col("which").alias(f"which_{x}"), F.col("n").alias(f"n_{x}"), *more)
    met = pairs.join(side("a", F.col("bits").alias("bits_a"), F.col("half").alias("half_a")), ["a", "which_a"]).join(side("b", F.col("bits").alias("bits_b"), F.col("half").alias("half_b")), ["b", "which_b"])
    met = met.withColumn("shared", F.expr(f"(n_a + n_b - {DIFFERENT}) div 2")).where(_similar(threshold)).select("a", "which_a", "b", "which_b", "n_a", "n_b")
    met = stage(met)
    part = F.posexplode("parts").alias("fragment", "members")
    x, y = (sets.select(F.col("doc_id").alias(i), F.col("which").alias(f"which_{i}"), "parts") for i in "ab")
    x = x.join(small(met), ["a", "which_a"]).select(*met.columns, part).where("size(members) > 0").withColumnRenamed("members", "x")
    later = met.select("b", "which_b").distinct()
    if later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else nearly all sets travel anyway
        y = y.join(F.broadcast(later), ["b", "which_b"], "left_semi")
    y = y.select("b", "which_b", part).where("size(members) > 0").withColumnRenamed("members", "y")
    both = x.join(y, ["b", "which_b", "fragment"])
    partial = both.select("a", "which_a", "b", "which_b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).cast("long").alias("partial"))
    counted = partial.groupBy("a", "which_a", "b", "which_b", "n_a", "n_b").agg(F.sum("partial").alias("shared"))
    return counted.where(_similar(threshold)).select("a", "b").distinct()


def _similar(threshold: float):
    """100 * shared >= percent * union in whole numbers."""
    percent = round(threshold * 10_000)
    return F.expr(f"10000 * shared >= {percent} * (n_a + n_b - shared)")


def _block_pairs(threshold: float):  # applied to the rows of one pair of blocks
    percent = round(threshold * 10_000)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, which, size, group = (frame[c].to_numpy() for c in ("doc_id", "which", "n", "component"))
        words = frame["bits"].map(len).to_numpy()
        rows = []
        for w in np.unique(words):  # pairs whose smaller bitmap has w words
            at = np.flatnonzero((words == w) | (words == 2 * w))
            bits = np.array([frame["bits"].iloc[k] if words[k] == w else frame["half"].iloc[k] for k in at], np.int64).view(np.uint64)
            for k in np.flatnonzero(words[at] == w):
                i = at[k]
                j = np.flatnonzero((group[at] != group[i]) & ((words[at] > w) | (at > i)))
                different = np.bitwise_count(bits[j] ^ bits[k]).sum(axis=1).astype(np.int64)
                j = at[j]
                most = (size[i] + size[j] - different) // 2
                rows += [(ids[i], which[i], ids[x], which[x]) for x in j[10_000 * most >= percent * (size[i] + size[j] - most)]]
        return pd.DataFrame(rows, columns=["a", "which_a", "b", "which_b"]).astype("int64")

    return run


def similar_documents(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of n-word shingles have Jaccard similarity >= threshold, and gives each its component.

    Returns one row per id of ``docs``: doc_id long, n_shingles long, component_id long (the least doc_id that links
    reach, itself included). Words are runs outside ASCII white space with A-Z lower-cased. A text of fewer than n words
    has one shingle, all its words. A null, empty or blank text has none and links with nothing. Rows with a null id
    are left out, as they can't be named; rows that repeat an id with the same text come once, and rows that give an
    id several texts count as linked. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "ngram")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    sized = stage(docs.mapInPandas(_sized(n), "doc_id long, n_shingles long, d1 long, d2 long").distinct())
    first = stage(sized.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = stage(sized.join(small(first), ["d1", "d2"]).where("doc_id <> first").select("doc_id", "d1", "d2", "first"))
    several = stage(sized.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id", F.lit(True).alias("several")))

    rare = _rarest(docs, n, threshold, copies, several, stage)
    wanted = rare.groupBy("doc_id").agg(F.max(F.col("which") != 0).alias("several"))
    sets = stage(docs.join(small(stage(wanted)), "doc_id").mapInPandas(_sets(n), f"{', '.join(f'{k} long' for k in KEY)}, n long, bits array<long>, half array<long>, parts array<array<long>>").dropDuplicates(KEY))

    found = components(_links(stage(_with_pivot(rare, 0, threshold)), sets, threshold, stage), stage)
    rest = stage(_unresolved(rare, found))
    left = rest.where(f"met > {FEW}").count()
    for step in range(1, ROUNDS):
        if not left:
            break
        some = _links(stage(_with_pivot(rest.where(f"met > {FEW}"), step, threshold)), sets, threshold, stage)
        found = components(found.union(some).toDF("a", "b"), stage)
        rest = stage(_unresolved(rest, found))
        before, left = left, rest.where(f"met > {FEW}").count()
        if 2 * left > before:
            break
    more = _few(rest, threshold).union(_many(rest, sets, threshold)).distinct()
    edges = found.union(_links(stage(more), sets, threshold, stage)).union(copies.select("doc_id", "first"))
    found = components(edges.toDF("a", "b"), stage).withColumnRenamed("node", "doc_id")
    stage.drop(sets, rare, rest)
    out = sized.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _rarest(docs: DataFrame, n: int, threshold: float, copies: DataFrame, several: DataFrame, stage: Stage) -> DataFrame:
    """(signature, doc_id, which, n): signatures that several sets have, for each set as many of the rarest as it needs.

    which tells the texts of an id with several apart, by their digest; of other ids it is 0, which keeps the rows short.
    Rare means few sets have it. Any order will do that is the same for all sets: one window counts how many have a
    signature, but of those that show often in a sixteenth of the sets, sixteen times that is taken, and their rows are dealt
    over many groups, so no task gathers them. Signatures take as much room as texts nearly, so they are never written: a
    sixteenth is made for the count, then all of them are made in the tasks that deal them out.
    """

    def made(texts: DataFrame) -> DataFrame:
        rows = texts.mapInPandas(_sketch(n, threshold), "doc_id long, n_shingles long, d1 long, d2 long, class int, least int, signatures array<long>")
        return rows.join(small(copies.select("doc_id", "d1", "d2")), ["doc_id", "d1", "d2"], "left_anti")

    sixteenth = made(docs.where("pmod(xxhash64(doc_id), 16) = 0")).select("class", F.explode("signatures").alias("signature")).select(F.expr(CLASSED).alias("signature"))
    # Of a signature that many have: how many about, and in the lowest bits room for the group a row is dealt to.
    hot = stage(sixteenth.groupBy("signature").agg(F.count("*").alias("count")).where(f"count >= {HOT}").select("signature", F.expr("shiftleft(16 * count, 12)").alias("many")))
    rows = made(docs).join(small(several), "doc_id", "left").withColumn("which", F.when(F.col("several"), F.col("d1")).otherwise(F.lit(0)))
    # A row of the large shuffle is little more than a signature and an id: the class goes into the lowest bits of the signature,
    # and size (up to 2^27 shingles) and least share go with the first signature of a set and class only, which is kept though it be lone.
    packed = F.expr("case when pos = 0 then shiftleft(n_shingles, 36) + least end")
    rows = rows.select("doc_id", "which", "n_shingles", "least", "class", F.posexplode("signatures").alias("pos", "signature")).withColumn("signature", F.expr(CLASSED))
    rows = rows.select("which", packed.alias("set"), "signature", "doc_id").join(small(hot), "signature", "left")
    rows = rows.select("which", "set", F.expr("many + (xxhash64(doc_id, signature) & 4095)").alias("many"), "signature", "doc_id")
    counted = F.count("*").over(Window.partitionBy("signature", "many"))
    met = stage(rows.withColumn("spread", F.coalesce(F.shiftright("many", 12), counted)).drop("many").where("spread > 1 or set is not null"))
    own = Window.partitionBy("doc_id", "which", "class")
    ranked = met.withColumn("class", F.expr("signature & 63")).withColumn("all", F.count(F.expr("nullif(spread, 1)")).over(own)).withColumn("set", F.max("set").over(own))
    ranked = ranked.where("spread > 1").withColumn("rank", F.row_number().over(own.orderBy("spread", "signature")))
    kept = stage(ranked.where("rank <= `all` - (set & 68719476735) + 1").select("signature", *KEY, F.expr("shiftright(set, 36)").alias("n")))
    stage.drop(met)
    # Of signatures with the same documents one is enough.
    h = F.xxhash64(*KEY)
    documents = kept.groupBy("signature").agg(F.count("*").alias("met"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"))
    one = documents.where("met > 1").groupBy("met", "low", "high").agg(F.min("signature").alias("signature")).select("signature")
    rare = stage(kept.join(one.hint("merge"), "signature").distinct())
    stage.drop(kept)
    return rare


def _with_pivot(rows: DataFrame, step: int, threshold: float) -> DataFrame:
    """Pairs of one document of each signature, the least at step 0 and then one by hash, with the others that aren't in its component yet."""
    order = F.col("doc_id") if step == 0 else F.xxhash64("doc_id", F.lit(step))
    known = [c for c in ("component",) if c in rows.columns]
    pivots = rows.groupBy("signature").agg(F.min(F.struct(order.alias("order"), *KEY, "n", *known)).alias("pivot"))
    met = rows.join(pivots, "signature").where(f"doc_id <> pivot.doc_id and least(n, pivot.n) >= {threshold} * greatest(n, pivot.n) - 1e-6")
    if known:
        met = met.where("component <> pivot.component")
    return met.select(F.col("pivot.doc_id").alias("a"), F.col("pivot.which").alias("which_a"), F.col("doc_id").alias("b"), F.col("which").alias("which_b")).distinct()


def _unresolved(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Documents under a signature whose documents aren't in one component yet."""
    rows = rows.select("signature", *KEY, "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    groups = rows.groupBy("signature").agg(F.count("*").alias("met"), F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(groups.where("met > 2 and low < high"), "signature").select("signature", *KEY, "component", "n", "met")


def _few(rest: DataFrame, threshold: float) -> DataFrame:
    """Pairs in different components where at most FEW documents have a signature."""
    rest = rest.where(f"met <= {FEW}")
    a, b = (rest.select("signature", F.col("doc_id").alias(x), F.col("which").alias(f"which_{x}"), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = f"a < b and c_a <> c_b and least(n_a, n_b) >= {threshold} * greatest(n_a, n_b) - 1e-6"
    return a.join(b, "signature").where(near).select("a", "which_a", "b", "which_b").distinct()


def _many(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The same where more have a signature, from blocks of bounded size that meet each other in tasks, by bitmaps."""
    rows = rest.where(f"met > {FEW}").join(sets.select(*KEY, "bits", "half"), KEY).withColumn("blocks", F.expr(f"cast(ceil(met / {BLOCK}) as int)"))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("signature", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *KEY, "component", "n", "bits", "half")
    return rows.groupBy("signature", "low", "high").applyInPandas(_block_pairs(threshold), "a long, which_a long, b long, which_b long")
