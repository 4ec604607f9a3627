"""Collocations: phrases of up to five words that come together more often than their parts let expect.

Texts are cut into pieces at punctuation, and identical pieces become one row
with a multiplicity. N-grams of pieces, weighted by it, are pre-aggregated where
they are read and counted out of core by duckdb, a hash bucket a task. First
words and pairs are counted; longer n-grams are sent only if all their pairs
may be frequent, by a Bloom filter of those that are (a false positive costs a
row, not a result: counts are exact). Then candidates look up their parts'
counts: requests are shuffled to the bucket of the part, and answers back to the
candidate.

Every part of a frequent phrase is at least as frequent, so the counts of what
reaches the least count hold all lookups. What is broadcast is the filter, at
most `FILTER_BITS` in size; where it fills up, more n-grams are sent.

Defined results: a null language is `und`; null and empty texts have no pieces;
texts of any length are read whole, a piece having no limit of its own; copies
and repeated rows count as often as they come; ties go by count and then by the
phrase's UTF-8 bytes; columns other than the two named are not read; an empty
table has no phrases.
"""

from __future__ import annotations

import string
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, wordhash
from .common import OWN

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words whose n-grams a task pre-aggregates at a time.
CHUNK_WORDS = 1 << 20
#: Bits of the filter for each frequent pair, and in all at most.
BITS_A_PAIR, FILTER_BITS = 16, 1 << 28
#: What duckdb holds of a bucket before it spills.
BUCKET_MEMORY = "300MB"
#: Ways in which lookups of single words are split, and languages when they are ranked.
SPLIT = 32

_GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
_STEPS = wordhash.seeds(2 * LONGEST, 1 << 24) | np.uint64(1)


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, weight): each language's distinct pieces, their words one space apart, and how often they come."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    text = F.translate(text_col, string.ascii_uppercase + "\t", string.ascii_lowercase + " ")
    piece = F.explode(F.split(F.regexp_replace(text, "  +", " "), r"[.,;:!?\x0A-\x0D]")).alias("piece")
    rows = docs.select(lang, piece).select("lang", F.trim("piece").alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("weight"))


class PairFilter:
    """A Bloom filter of pairs' hashes, two bits each."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.words = np.zeros(bits >> 6, np.uint64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([keys >> self.shift, wordhash.mix(keys ^ _STEPS[-1]) >> self.shift])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)


class Words:
    """The words of a batch of pieces, as spans of one buffer, with hashes of their n-grams."""

    def __init__(self, batch: pa.Table):
        text = batch["piece"].combine_chunks().cast(pa.large_string())
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        self.data = np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]]
        spaces = np.flatnonzero(self.data[offsets[0] :] == 32) + offsets[0]
        self.starts = np.sort(np.concatenate([offsets[:-1], spaces + 1]))
        self.ends = np.sort(np.concatenate([offsets[1:], spaces]))
        self.piece = np.searchsorted(offsets, self.starts, side="right") - 1
        self.weight = batch["weight"].to_numpy()[self.piece]
        langs = batch["lang"].combine_chunks().dictionary_encode()
        langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
        self.langs, codes = langs.dictionary, langs.indices.to_numpy()
        self.lang = codes[self.piece]
        self.hash = wordhash.hash_spans(self.data, self.starts, self.ends - self.starts)
        names = [x.as_py().encode() + b"\0" for x in self.langs]
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.lang_hash = wordhash.hash_spans(np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def starts_of(self, n: int) -> np.ndarray:
        """The words at which an n-gram of a piece begins."""
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray, n: int, second: bool = False) -> np.ndarray:
        """Hashes of the n-grams beginning at those words, by language."""
        out = self.lang_hash[self.lang[at]] + np.uint64(n)
        for j in range(n):
            out = out + (wordhash.mix(self.hash[at + j] ^ _STEPS[0]) if second else self.hash[at + j]) * _STEPS[j + LONGEST * second]
        return wordhash.mix(out)

    def counted(self, at: np.ndarray, n: int) -> pa.Table | None:
        """Distinct n-grams of those beginning at `at`, with the sums of their weights."""
        if not len(at):
            return None
        keys = self.keys(at, n)
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        other = self.keys(at, n, second=True)
        if (other != other[first][group]).any():  # n-grams that share the first hash
            _, first, group = np.unique(np.stack([keys, other]), axis=1, return_index=True, return_inverse=True)
        f = np.zeros(len(first), np.int64)
        np.add.at(f, group, self.weight[at])
        at = at[first]
        begin, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)
        phrase = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(self.data[take]))
        columns = [self.langs.take(pa.array(self.lang[at])).cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(f)]
        return pa.Table.from_arrays(columns, schema=_GRAMS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= 6 * CHUNK_WORDS:
            yield Words(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield Words(pa.Table.from_batches(held))


def _emitted(chosen: Callable[[Words], Iterator[tuple[np.ndarray, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            for at, n in chosen(words):
                table = words.counted(at, n)
                if table is not None:
                    yield from table.to_batches(max_chunksize=1 << 16)

    return run


def _bucket(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a bucket's n-grams that reach `least`: an aggregation by duckdb, which spills to a scratch folder of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory() as scratch:
            with duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as db:
                rows = pa.RecordBatchReader.from_batches(_GRAMS, (b.cast(_GRAMS) for b in batches))
                db.register("rows", rows)
                found = db.execute(f"SELECT lang, phrase, words, sum(f)::BIGINT AS f FROM rows GROUP BY ALL HAVING sum(f) >= {int(least)}").to_arrow_reader(1 << 16)
                for batch in found:
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.columns, _GRAMS)], schema=_GRAMS)

    return run


def _counted(cut: DataFrame, chosen: Callable[[Words], Iterator[tuple[np.ndarray, int]]], least: int) -> DataFrame:
    schema = "lang string, phrase string, words int, f long"
    rows = cut.mapInArrow(_emitted(chosen), schema).repartition("lang", "phrase")
    return common.written(rows.mapInArrow(_bucket(least), schema), "phrases")


def _filter(pairs: DataFrame) -> PairFilter:
    """The filter of all frequent pairs: their bits are set by the executors, word by word."""
    count = pairs.count()
    made = PairFilter(min(FILTER_BITS, 1 << max(16, (BITS_A_PAIR * count).bit_length())))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            at = np.unique(made.places(words.keys(words.starts_of(2), 2)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = pairs.select("lang", F.col("phrase").alias("piece"), F.col("f").alias("weight")).mapInArrow(bits, "at long, bits long")
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    made.words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return made


def frequent(cut: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f): all n-grams of 1 to `longest` words that come `least` times or more in the pieces of `cut`."""
    short = _counted(cut, lambda words: ((words.starts_of(n), n) for n in (1, 2)), least)
    if longest < 3:
        return short.where(F.col("words") <= longest)
    known = cut.sparkSession.sparkContext.broadcast(_filter(short.where("words = 2")))

    def longer(words: Words) -> Iterator[tuple[np.ndarray, int]]:
        pair = np.zeros(len(words.piece), bool)
        at = words.starts_of(2)
        pair[at] = known.value.holds(words.keys(at, 2))
        for n in range(3, longest + 1):
            at = words.starts_of(n)
            for j in range(n - 1):
                at = at[pair[at + j]]
            yield at, n

    return short.unionByName(_counted(cut, longer, least))


def _part(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(OWN + "w", first, count), " ")


def _within(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): phrases inside a longer candidate, with the largest count of one."""
    def spans(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.col("words") - n + 1, F.lit(1)))
        return F.when(F.col("words") > n, F.transform(starts, lambda i: _part(i, F.lit(n))))

    inside = F.explode(F.flatten(F.array_compact(F.array(*map(spans, range(2, LONGEST))))))
    rows = candidates.where("words > 2").withColumn(OWN + "w", F.split("phrase", " ")).select("lang", inside.alias("phrase"), "f")
    return rows.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def _scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """candidates (lang, phrase, words, f) with a, l, r, n and score of their lowest cut; parts are looked up by shuffled requests."""
    k, salt = F.col(OWN + "k"), OWN + "salt"
    cuts = candidates.withColumn(OWN + "w", F.split("phrase", " ")).withColumn(OWN + "k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    side = lambda head, first, size: F.struct(F.lit(head).alias("head"), size.alias("size"), _part(first, size).alias("part"))
    sides = F.explode(F.array(side(True, F.lit(1), k), side(False, k + 1, F.col("words") - k))).alias("x")
    asked = cuts.select("lang", "phrase", "f", k, sides).select("lang", "phrase", "f", k, "x.*")
    # Single words are parts of many phrases: their lookups are split over copies of their counts.
    asked = asked.withColumn(salt, F.when(F.col("size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SPLIT))).otherwise(0))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("words") == 1, F.lit(SPLIT - 1)).otherwise(0).cast("long")))
    parts = counts.where(F.col("words") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("f").alias(OWN + "f"), copies.alias(salt))
    answers = asked.join(parts, ["lang", "part", salt]).repartition("lang", "phrase")
    both = answers.groupBy("lang", "phrase", OWN + "k").agg(F.max("f").alias("a"), *(F.max(F.when(F.col("head") == side, F.col(OWN + "f"))).alias(name) for side, name in ((True, "l"), (False, "r"))))
    both = both.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = F.min(F.struct(score.alias("score"), k.alias("k"), "l", "r", "a", "n")).alias("x")
    return both.groupBy("lang", "phrase").agg(best).select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words that come `least` times or more.

    Of a phrase that comes a times, in n words of the language, with parts that come
    l and r times, the score is floor(1000 a n / (l r)) at the cut where that is least.
    Phrases that a longer one contains whenever they come are left out.
    """
    cut = common.written(pieces(docs, lang_col, text_col), "pieces")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = cut.groupBy("lang").agg(F.sum(F.col("weight") * words).alias("n"))
    counts = frequent(cut, longest, least)
    candidates = counts.where("words > 1")
    kept = candidates.join(_within(candidates), ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * f").drop("longer")
    scored = _scored(kept, counts, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = scored.withColumn(OWN + "part", F.pmod(F.xxhash64("phrase"), F.lit(SPLIT)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", OWN + "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
