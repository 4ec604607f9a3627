"""MinHash near-dedup by Order MinHash with banded alignment.

Texts are sequences of words (lower-cased runs of non-space); their shingles
are runs of five words, each labelled with its occurrence number in the text.
For each of `samples` random orders of labelled shingles a text keeps its
`length` smallest ones *in text order* and hashes them: two texts agree on a
sample with about their edit similarity to that power. Texts that agree on a
sample, or on two or three neighbouring ones, are compared with their group's
representative, not with each other; the pair is linked if the banded alignment of the shingle sequences matches M of n
and m with M / (n + m - M) >= threshold. Texts that agree on a sample and are then
not in one class are looked at again: a pair that shares a shingle of at most RARE
of these texts is aligned, unless the shingles that it shares and the commoner ones
of either text are too few for the threshold, or the parities of their numbers of
shingles by hash differ too much. Pairs that share common shingles alone need enough
of them to reach it. Texts that have so many are compared with representatives of the
common shingles that a pair must share one of; then all pairs that still are of two
classes and share such a shingle are aligned, unless counts, the shingle's places or
parities prove them to be under the threshold. So every pair that agrees on a sample is in one class, aligned or proven
to be under the threshold. Classes are the connected components.

Defined results: a null text is the empty text; texts of the same words (the
empty ones too) are one class whatever their case and spacing; texts of fewer
than five words have one shingle, all their words. Rows whose id is null take
no part. Repeated ids are one document, the union of their texts' links. Ties
take the smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .common import OWN

#: Column of each row's own number: its id, or one above all ids where ids repeat.
NUMBER = OWN + "number"

K, SAMPLES, LENGTH, THRESHOLD = 5, 20, 3, 0.8
#: Random priorities by which a sample's group picks its representative: several, so that
#: texts that miss one representative meet others.
PRIORITIES = 5
#: Neighbouring samples that groups agree on, at most.
WIDEST = 3
#: Texts that a shingle may be in for all of them to be compared by it; commoner shingles are only counted.
RARE = 16
#: Representatives of a common shingle, at most, that texts are compared with before all pairs are.
REPRESENTATIVES = 32
#: Rows of a common shingle that are paired with as many others in one part of a join.
BLOCK = 512
#: Numbers of 64 bits that hold the parities of a text's numbers of shingles by hash.
PARITIES = 8
#: Bytes of text that are hashed at a time.
CHUNK = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[32] = True


def canonical(text: str | None) -> bytes:
    """The words of a text, lower-case, one space between them."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def labelled(shingles: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The shingles' hashes with each one's occurrence number in its text mixed in."""
    doc = np.repeat(np.arange(len(m), dtype=np.uint64), m)
    key = shingles ^ wordhash.mix(doc + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.r_[False, ranked[1:] == ranked[:-1]]
    run = np.flatnonzero(~same)
    nth = np.arange(len(key)) - np.repeat(run, np.diff(np.r_[run, len(key)]))
    number = np.empty(len(key), np.uint64)
    number[order] = nth.astype(np.uint64)
    return wordhash.mix(shingles + number * np.uint64(0xD1B54A32D192ED03))


def sketches(shingles: np.ndarray, m: np.ndarray, samples: int, length: int) -> np.ndarray:
    """(texts, samples) Order MinHash sketches; a text without shingles has zeros."""
    out = np.zeros((len(m), samples), np.int64)
    full = np.flatnonzero(m > 0)
    if not len(full):
        return out
    m = m[full]
    base = labelled(shingles, m)
    ends = np.cumsum(m)
    starts = ends - m
    doc = np.repeat(np.arange(len(m)), m)
    # Values under `most` hold the smallest ones of all but a few texts; those few are looked at whole.
    share = np.minimum(1.0, (8.0 * length) / m)
    most = np.where(share >= 1, np.uint64(0xFFFFFFFFFFFFFFFF), (share * 2.0**64 * (1 - 1e-9)).astype(np.uint64))
    limit = np.repeat(most, m)
    need = np.minimum(m, length)
    c = wordhash.seeds(length, 1 << 21) | np.uint64(1)
    for s, seed in enumerate(wordhash.seeds(samples, 1 << 22)):
        value = (base ^ seed) * np.array([seed | np.uint64(1)])
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(value <= limit)
        short = np.flatnonzero(np.bincount(doc[at], minlength=len(m)) < need)
        if len(short):
            at = np.union1d(at, np.concatenate([np.arange(starts[d], ends[d]) for d in short]))
        order = np.lexsort((value[at], doc[at]))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(doc[at], doc[at])
        at = np.sort(at[rank < length])  # in text order
        rank = np.arange(len(at)) - np.searchsorted(doc[at], doc[at])
        sketch = np.zeros(len(m), np.uint64)
        for j in range(length):
            here = at[rank == j]
            sketch[doc[here]] += base[here] * c[j]
        out[full, s] = wordhash.mix(sketch ^ seed).view(np.int64)
    return out


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, samples: int, length: int) -> DataFrame:
    """(doc, words, sketch): words is a digest of the words of the text, sketch its samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.given_back()
        for pdf in batches:
            i = 0
            while i < len(pdf):
                texts, size, j = [], 0, i
                while j < len(pdf) and (size < CHUNK or not texts):
                    texts.append(canonical(pdf["text"].iat[j]))
                    size += len(texts[-1])
                    j += 1
                grams, m = wordhash.shingles_of(*wordhash.words_of(texts, _SPACE), k)
                yield pd.DataFrame(
                    {
                        "doc": pdf["doc"].iloc[i:j].to_numpy(),
                        "words": [hashlib.blake2b(t, digest_size=16).digest() for t in texts],
                        "sketch": list(sketches(grams, m, samples, length)),
                    }
                )
                i = j
        common.given_back()

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc long, words binary, sketch array<long>")


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """The alignment similarity M / (n + m - M) of two shingle sequences, or 0.0 where it is under the threshold.

    M is the length of the longest common subsequence whose matches lie within
    the band that any alignment of that similarity keeps to; bit-parallel, a
    row of the alignment table at a time.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if n == m and np.array_equal(a, b):
        return 1.0
    least = threshold * (n + m) / (1 + threshold)  # matches needed
    if min(n, m) < least - 1e-9:
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < least - 1e-9:  # no alignment has more
        return 0.0
    band = int(n + m - 2 * least + 1e-9)
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else []
    tail = int(differ[0]) if len(differ) else rest
    a, b = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    matched = head + tail
    if a and b:
        places: dict[int, int] = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | (1 << i)
        every = (1 << len(a)) - 1
        row, window = every, (1 << (2 * band + 1)) - 1
        for j, y in enumerate(b):
            hit = places.get(y)
            if hit:
                hit &= window << (j - band) if j >= band else window >> (band - j)
                up = row & hit
                if up:
                    row = ((row + up) | (row - up)) & every
        matched += len(a) - row.bit_count()
    similarity = matched / (n + m - matched)
    return similarity if similarity >= threshold - 1e-12 else 0.0


def verified(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose alignment reaches the threshold, as (a, b, similarity)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.given_back()
        for pdf in batches:
            keep, last, last_text = [], None, None
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                if last_text is None or tb != last_text:  # representatives come in runs
                    last, last_text = wordhash.shingles_of(*wordhash.words_of([canonical(tb)], _SPACE), k)[0], tb
                mine = wordhash.shingles_of(*wordhash.words_of([canonical(ta)], _SPACE), k)[0]
                if similarity := aligned(mine, last, threshold):
                    keep.append((a, b, similarity))
            yield pd.DataFrame(keep, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return pairs.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, similarity double")


def labelled_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(id, class, n, grams) of rows (id, class, text): the text's distinct labelled shingles, n of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.given_back()
        for pdf in batches:
            i, sizes = 0, pdf["text"].str.len().to_numpy()
            while i < len(pdf):
                j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), CHUNK, "right")) + i)
                grams, m = wordhash.shingles_of(*wordhash.words_of([canonical(t) for t in pdf["text"].iloc[i:j]], _SPACE), k)
                parts = np.split(labelled(grams, m).view(np.int64), np.cumsum(m)[:-1])
                yield pd.DataFrame({"id": pdf["id"].iloc[i:j].to_numpy(), "class": pdf["class"].iloc[i:j].to_numpy(), "n": m, "grams": parts})
                i = j

    return texts.select("id", "class", "text").mapInPandas(run, "id long, class long, n long, grams array<long>")


def unsettled(classes: DataFrame, component: DataFrame, samples: int) -> DataFrame:
    """(id, class) of the texts that share a sample with a text of another class."""
    known = classes.join(component.hint("merge"), "head", "left").select("head", F.coalesce("component", "head").alias("class"), "sketch")
    sample = known.select("head", "class", F.posexplode("sketch").alias("s", "sk"))
    mixed = sample.groupBy("s", "sk").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("s", "sk")
    return sample.join(mixed.hint("merge"), ["s", "sk"]).groupBy("head").agg(F.first("class").alias("class")).select(F.col("head").alias("id"), "class")


def gram_hits(texts: DataFrame, k: int) -> DataFrame:
    """(id, class, n, g, df) of rows (id, class, text): shingles g of several classes, that df texts have."""
    rows = common.written(labelled_shingles(texts, k), "omh-rest")
    gram = rows.select("id", "class", "n", F.explode("grams").alias("g"))
    count = gram.groupBy("g").agg(F.count("*").alias("df"), F.min("class").alias("low"), F.max("class").alias("high"))
    count = count.where("low < high").select("g", "df")  # others are shared by no pair of different classes
    return common.written(gram.join(common.written(count, "omh-counts").hint("merge"), "g"), "omh-hits")


def profiles(hit: DataFrame, threshold: float) -> DataFrame:
    """(id, n, held, often, odd, rarest): how many of gram_hits() a text has, how many of these are common, the parities of their numbers by hash.

    rarest: of a text whose common shingles may reach the threshold, the rarest
    of these, of which a pair that shares common ones alone shares one.
    """
    odd = [F.bit_xor(F.when(F.pmod("g", F.lit(PARITIES)) == i, F.expr(f"shiftleft(1L, cast(pmod(g div {PARITIES}, 64) as int))")).otherwise(F.lit(0))) for i in range(PARITIES)]
    grams = F.sort_array(F.collect_list(F.when(F.col("df") > RARE, F.struct("df", "g"))))
    text = hit.groupBy("id", "n").agg(F.count("*").alias("held"), grams.alias("grams"), F.array(*odd).alias("odd")).withColumn("often", F.size("grams"))
    first = F.greatest(F.lit(0), F.col("often") - F.ceil(threshold * F.col("n") - 1e-6).cast("int") + 1)
    return common.written(text.select("id", "n", "held", "often", "odd", F.slice("grams", 1, first)["g"].alias("rarest")), "omh-profiles")


def may_reach(x: str, y: str, threshold: float) -> Column:
    """Whether x and y, rows of profiles(), may share enough shingles, going by the parities that differ."""
    differ = sum((F.bit_count(F.col(f"{x}.odd")[i].bitwiseXOR(F.col(f"{y}.odd")[i])) for i in range(PARITIES)), F.lit(0))
    return F.col(f"{x}.held") + F.col(f"{y}.held") - differ >= 2 * needed(x, y, threshold)


def needed(x: str, y: str, threshold: float) -> Column:
    """The matches that x and y need."""
    return threshold / (1 + threshold) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6


def overlooked(hit: DataFrame, profile: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes that share a rare shingle and may reach the threshold.

    A pair's matches are at most the labelled shingles that both texts have:
    those found by rare ones, and at most the common ones of either text.
    """
    rare = hit.where(F.col("df") <= RARE)
    x, y = (rare.select("g", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "class", "n"))) for side in "ab")
    alike = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6
    pair = x.join(y.hint("merge"), "g").where(F.expr("id_a < id_b and class_a != class_b") & alike)
    pair = pair.groupBy("id_a", "id_b").agg(F.count("*").alias("shared"))
    for side, of in (("x", "id_a"), ("y", "id_b")):
        pair = pair.join(profile.select(F.col("id").alias(of), F.struct("n", "held", "often", "odd").alias(side)).hint("merge"), of)
    enough = F.col("shared") + F.least("x.often", "y.often") >= needed("x", "y", threshold)
    return pair.where(enough & may_reach("x", "y", threshold)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def commonplace(profile: DataFrame, component: DataFrame) -> DataFrame:
    """(g, id, n, held, often, odd, class, place): the texts by their rarest common shingles g, which have that place, from 1, the rarest first."""
    known = component.withColumnRenamed("head", "id")
    row = profile.where(F.size("rarest") > 0).join(known.hint("merge"), "id", "left").withColumn("class", F.coalesce("component", "id"))
    row = row.select("id", "n", "held", "often", "odd", "class", F.posexplode("rarest").alias("at", "g"))
    return row.withColumn("place", F.col("at") + 1).drop("at")


def represented(row: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows of commonplace() and their shingles' representatives, of different classes, that may reach the threshold."""
    own = ("id", "n", "held", "often", "odd", "class")
    part, priority = (F.xxhash64("id", F.pmod("g", F.lit(PRIORITIES)), F.lit(seed)) for seed in (0, 1))
    lead = row.groupBy("g", F.pmod(part, F.lit(REPRESENTATIVES)).alias("part")).agg(F.min_by(F.struct(*own), priority).alias("y"))
    pair = row.select("g", F.struct(*own).alias("x")).join(lead.hint("merge"), "g")
    enough = F.least("x.often", "y.often") >= needed("x", "y", threshold)
    pair = pair.where((F.col("x.class") != F.col("y.class")) & enough & may_reach("x", "y", threshold))
    return pair.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def remaining(row: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of rows of commonplace() of one shingle, of different classes, that may reach the threshold.

    A shingle's rows are dealt to blocks, and pairs of blocks are joined apart. A
    pair is found by the rarest shingle that it shares, if by no other: no
    more than the shingles after its place are shared beside it.
    """
    count = row.groupBy("g").agg(F.count("*").alias("rows"), F.min("class").alias("low"), F.max("class").alias("high"))
    count = count.where("low < high").select("g", F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = row.join(count.hint("merge"), "g").withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("id", "n", "held", "often", "place", "odd", "class", "block").alias("of"))
    x, y = (dealt.select("g", "i", "j", F.col("of").alias(side)).hint("merge") for side in "xy")
    once = F.expr("x.block = i and y.block = j and (i < j or x.id < y.id) and x.class != y.class")
    after = F.least(F.col("x.often") - F.col("x.place"), F.col("y.often") - F.col("y.place")) + 1
    pair = x.join(y, ["g", "i", "j"]).where(once & (after >= needed("x", "y", threshold)) & may_reach("x", "y", threshold))
    return pair.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def aligned_pairs(pairs: DataFrame, text: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts' alignment reaches the threshold; text has rows (id, text)."""
    pairs = common.written(pairs, "omh-more-pairs")
    side_a, side_b = (text.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")).hint("merge") for x in "ab")
    return common.written(verified(pairs.join(side_a, "a").join(side_b, "b"), k, threshold).select("a", "b"), "omh-more")


def rejoined(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (head, component) with the classes of further links (a, b) made one: components of classes, not of texts."""
    for x in "ab":
        known = component.select(F.col("head").alias(x), F.col("component").alias(f"class_{x}"))
        links = links.join(known.hint("merge"), x, "left").withColumn(f"class_{x}", F.coalesce(f"class_{x}", x))
    over = common.written(common.connected_components(links, "class_a", "class_b").select("node", F.col("component").alias("over")), "omh-over")
    moved = component.join(over.hint("merge"), component["component"] == over["node"], "left").select("head", F.coalesce("over", "component").alias("component"))
    alone = over.join(component.hint("merge"), over["node"] == component["head"], "left_anti").select(F.col("node").alias("head"), F.col("over").alias("component"))
    return common.written(moved.union(alone), "omh-component")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(docs with an id and NUMBER, whether ids repeat): the id where it comes once, else a number of the row's own above all ids."""
    known = docs.where(F.col(id_col).isNotNull())
    number = F.col(id_col).cast("long")
    counts = known.groupBy(number.alias(OWN + "id")).agg(F.count("*").alias("n"))
    repeated = common.written(counts.where("n > 1").select(OWN + "id"), "omh-repeated")
    if repeated.isEmpty():
        return known.withColumn(NUMBER, number), False
    top = known.agg(F.max(number)).first()[0]
    if top >= 1 << 62:
        raise ValueError("ids that repeat must be under 2^62")
    many = common.written(known.join(repeated.hint("merge"), number == F.col(OWN + "id"), "left_semi"), "omh-repeats")
    many = common.written(many.withColumn(NUMBER, F.lit(top + 1) + F.monotonically_increasing_id()), "omh-repeats")
    return known.join(repeated.hint("merge"), number == F.col(OWN + "id"), "left_anti").withColumn(NUMBER, number).unionByName(many), True


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc, cluster, kept): cluster is the smallest id of the document's class, kept tells doc = cluster.

    All texts of an id are aligned, and tie their classes together. Rows with a null
    id have no row; an empty table has none; other columns aren't read.
    """
    rows, repeated = numbered(docs, id_col, text_col)
    found = _classes(rows, NUMBER, text_col, **options)
    if repeated:
        found = common.written(rows.select(F.col(id_col).cast("long").alias("id"), F.col(NUMBER).alias("doc")).join(found.hint("merge"), "doc").select("id", F.col("cluster").alias("c")).distinct(), "omh-tied")
        first = found.groupBy("id").agg(F.min("c").alias("first"))
        over = common.connected_components(found.join(first.hint("merge"), "id").select("c", "first"), "c", "first")
        found = found.join(over.hint("merge"), found["c"] == over["node"], "left").select("id", F.coalesce("component", "c").alias("c")).distinct()
        least = found.groupBy("c").agg(F.min("id").alias("cluster"))
        found = found.join(least.hint("merge"), "c").select(F.col("id").alias("doc"), "cluster")
    return found.select("doc", "cluster", (F.col("cluster") == F.col("doc")).alias("kept"))


def _classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, samples: int = SAMPLES, length: int = LENGTH, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc, cluster) of docs with an id each: cluster is the smallest of the document's class."""
    sketch = common.written(sketched(docs, id_col, text_col, k, samples, length), "omh")
    # One document stands for all of the same words; documents of one id are tied together below.
    classes = sketch.groupBy("words").agg(F.min("doc").alias("head"), F.min_by("sketch", "doc").alias("sketch"))
    classes = common.written(classes, "omh-classes")
    member = sketch.select("doc", "words").join(classes.select("words", "head").hint("merge"), "words").select("doc", "head").distinct()
    member = common.written(member, "omh-members")
    common.cleaned(docs.sparkSession)

    # Groups by one sample, and by two and three neighbouring ones: in these, texts that are alike
    # only in part no longer stand between those that are near copies.
    def group(width: int) -> Column:
        part = lambda i: [F.get("sketch", (i + j) % samples) for j in range(width)]
        return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.xxhash64(*part(i), F.lit(width)))

    keys = [group(width) for width in range(1, WIDEST + 1)]
    bucket = classes.select("head", F.posexplode(F.concat(*keys)).alias("s", "sk"))
    priority = F.struct(F.xxhash64("head", F.floor(F.col("s") / samples), F.col("s") % PRIORITIES).alias("p"), "head")
    leader = bucket.groupBy("s", "sk").agg(F.min(priority).alias("lead"), F.count("*").alias("n")).where("n > 1").select("s", "sk", F.col("lead.head").alias("lead"))
    pairs = bucket.join(leader.hint("merge"), ["s", "sk"]).where("head != lead").select(F.least("head", "lead").alias("a"), F.greatest("head", "lead").alias("b"), "lead")
    # A pair is aligned once; its representative goes second.
    pairs = pairs.groupBy("a", "b").agg(F.min("lead").alias("lead")).select(
        F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("lead").alias("b")
    )
    pairs = common.written(pairs, "omh-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = common.written(text.join(ids.hint("merge"), "id").groupBy("id").agg(F.min("text").alias("text")), "omh-text")
    text_a, text_b = (text.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")).hint("merge") for x in "ab")
    common.cleaned(docs.sparkSession)
    candidates = pairs.join(text_a, "a").join(text_b, "b")
    links = verified(candidates, k, threshold).select("a", "b")
    component = common.connected_components(links, "a", "b").withColumnRenamed("node", "head")
    common.cleaned(docs.sparkSession)
    # Texts of one sample and several classes, of which not all pairs have been compared.
    again = unsettled(classes, component, samples)
    hit = gram_hits(again.join(text.hint("merge"), "id"), k)
    profile = profiles(hit, threshold)
    common.cleaned(docs.sparkSession)
    pairs = overlooked(hit, profile, threshold).union(represented(commonplace(profile, component), threshold)).distinct()
    component = rejoined(component, aligned_pairs(pairs, text, k, threshold))
    common.cleaned(docs.sparkSession)
    component = rejoined(component, aligned_pairs(remaining(commonplace(profile, component), threshold), text, k, threshold))
    cluster = F.coalesce("component", "head")
    return member.join(component.hint("merge"), "head", "left").groupBy("doc").agg(F.min(cluster).alias("cluster"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class of near duplicates, of the smallest id; rows with a null id stay as they are.

    Rows of one id with texts that aren't alike are different documents and stay.
    """
    rows, repeated = numbered(docs, id_col, text_col)
    found = _classes(rows, NUMBER, text_col, **options)
    if repeated:
        ids = rows.select(F.col(NUMBER).alias("doc"), F.col(id_col).cast("long").alias("id"))
        found = common.written(found.join(ids.hint("merge"), "doc"), "omh-kept")
        best = found.groupBy("cluster").agg(F.min(F.struct("id", "doc")).alias("best"))
        gone = found.join(best.hint("merge"), "cluster").where("doc <> best.doc").select(F.col("doc").alias(NUMBER))
    else:
        gone = found.where("doc <> cluster").select(F.col("doc").alias(NUMBER))
    left = rows.join(gone.hint("merge"), NUMBER, "left_anti").select(*docs.columns)
    return left.unionByName(docs.where(F.col(id_col).isNull()))
