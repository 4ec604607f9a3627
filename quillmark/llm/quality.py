"""Quality by importance resampling: hashed n-gram models of target and of raw text, and Gumbel top-k.

Tokens are runs of word characters or of marks, lower-cased; a text's n-grams
are its tokens and its pairs of neighbours, hashed into `BUCKETS` buckets (a
token beside itself hashes as one symbol of repetition). A text's log weight
is the sum over its n-grams of log p_target - log p_raw. Its key adds Gumbel
noise, drawn from its id; the k largest keys are a sample of k texts, without
replacement, in proportion to their weights.

The raw model counts all texts. The target model counts a bounded sample: half
of the first `SAMPLE` rows by hash of the id among those that labels call good,
whole. By default k is the number of all texts whose
log weight reaches the cut that errs least on the other half and as many rows
that labels call bad.

Defined results: null and empty texts have no n-gram and log weight 0; keys
tied with the k-th largest are all kept; null ids share one draw; with no
labelled good row all weights are 0 and everything is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

BUCKETS = 1 << 16
SAMPLE = 20_000
PRIOR = 4.0
CHUNK = 2 << 20
FAN_IN = 32
#: Parts of the counts that are summed apart.
SLICES = 32
_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_KIND = np.where(_WORD, 2, 1).astype(np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of every text, its text's number)."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    lengths = np.diff(np.r_[change, len(data)])
    token = kind[change] > 0
    starts, lengths = change[token], lengths[token]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = wordhash.hash_spans(data, starts, lengths)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(first, starts, side="right") - 1
    pair = doc[1:] == doc[:-1]
    a, b = h[:-1][pair], h[1:][pair]
    two = np.where(a == b, np.uint64(1), wordhash.mix(a * np.uint64(0x9E3779B97F4A7C15) + b))
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([h & mask, two & mask]).astype(np.int64), np.concatenate([doc, doc[1:][pair]])


def chunks(texts: pd.Series) -> Iterator[list[str | None]]:
    out: list[str | None] = []
    size = 0
    for t in texts:
        out.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def counted(rows: DataFrame) -> np.ndarray:
    """(2, BUCKETS) n-gram counts of all rows (text, target) and of the target rows, summed up a tree of tasks.

    Counts travel in slices, each summed apart, until there is one of each: the
    driver gets as much as one task's counts, whatever the number of tasks.
    """
    schema = "part int, slice int, counts binary"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.given_back()
        total = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            flag = pdf["target"].to_numpy(bool)
            for at, texts in _offsets(pdf["text"]):
                grams, doc = ngrams(texts)
                total[0] += np.bincount(grams, minlength=BUCKETS)
                total[1] += np.bincount(grams[flag[at : at + len(texts)][doc]], minlength=BUCKETS)
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "slice": range(SLICES), "counts": [x.tobytes() for x in total.reshape(SLICES, -1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for part, i, data in zip(pdf["part"], pdf["slice"], pdf["counts"]):
                total.setdefault((part, i), np.zeros(2 * BUCKETS // SLICES, np.int64))[:] += np.frombuffer(data, np.int64)
        for (part, i), x in total.items():
            yield pd.DataFrame({"part": [part], "slice": [i], "counts": [x.tobytes()]})

    n = rows.rdd.getNumPartitions()
    out = rows.select("text", "target").mapInPandas(count, schema)
    while n > 1:
        n = -(-n // FAN_IN)
        up = F.floor(F.col("part") / FAN_IN).cast("int").alias("part")
        out = out.select(up, "slice", "counts").repartition(max(n, SLICES), "part", "slice").mapInPandas(add, schema)
    total = np.zeros((SLICES, 2 * BUCKETS // SLICES), np.int64)
    for row in out.collect():  # a row of each slice
        total[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    return total.reshape(2, BUCKETS)


def _offsets(texts: pd.Series) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    for part in chunks(texts):
        yield at, part
        at += len(part)


def ratios(counts: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with PRIOR added to counts on the scale of the target sample.

    On that scale a rare n-gram's absence from a small sample says little.
    """
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    expected = counts[0] * (counts[1].sum() / counts[0].sum())
    return np.log(counts[1] + PRIOR) - np.log(expected + PRIOR)


def log_weights(texts: pd.Series, ratio: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for part in chunks(texts):
        grams, doc = ngrams(part)
        out.append(np.bincount(doc, weights=ratio[grams], minlength=len(part)))
    return np.concatenate(out)


def log_weight(text: Column | str, ratio: np.ndarray) -> Column:
    data = ratio.astype(np.float32).tobytes()

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.given_back()
        table = np.frombuffer(data, np.float32).astype(float)
        for texts in batches:
            yield pd.Series(log_weights(texts, table))
        common.given_back()

    return weigh(text)


def gumbel(id_col: str, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, key: str, k: int) -> float:
    """The k-th largest of the keys, exactly: histograms of ever narrower ranges, bounded rows to the driver."""
    edge = keys.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if not edge["n"] or k < 1:
        return float("inf")
    if k >= edge["n"]:
        return float("-inf")
    lo, hi, above = edge["lo"], edge["hi"], 0
    while True:
        here = keys.where(F.col(key).between(lo, hi))
        slot = F.floor((F.col(key) - lo) / ((hi - lo) or 1.0) * 1000)
        bars = {r["slot"]: r for r in here.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for s in sorted(bars, reverse=True):
            if above + bars[s]["n"] >= k:
                break
            above += bars[s]["n"]
        lo, hi, n = bars[s]["lo"], bars[s]["hi"], bars[s]["n"]
        if lo == hi:
            return lo
        if n <= 5000:
            return sorted((r[0] for r in keys.where(F.col(key).between(lo, hi)).select(key).collect()), reverse=True)[k - above - 1]


class Resampler:
    """The fitted ratios, and the cut on log weights that errs least on labelled rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: int = 5, sample: int = SAMPLE):
        self.id_col, self.text_col = id_col, text_col
        doc = F.col(id_col).cast("long").alias("doc")
        label = labels.select(doc, F.col(label_col).alias("y")).where("doc is not null and y in (0, 1)").groupBy("doc").agg(F.min("y").alias("y"))
        label = label.where(common.remainder("doc", held) != 0)
        parts = [label.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(sample) for y in (0, 1)]
        chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * sample rows
        text = docs.select(doc, F.col(text_col).alias("text"))
        fitted = (F.col("y") == 1) & (F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(2)) == 0)
        rows = text.join(chosen, "doc", "left").select("text", F.coalesce(fitted, F.lit(False)).alias("target"))
        self.ratio = ratios(counted(rows))
        seen = text.join(chosen, "doc").where(~fitted).select("y", log_weight("text", self.ratio).alias("w"))
        self.cut = self._best(np.array([(r["w"], r["y"]) for r in seen.limit(4 * sample).collect()]).reshape(-1, 2))

    @staticmethod
    def _best(seen: np.ndarray) -> float:
        """The middle of the widest range of cuts with the fewest labelled rows on the wrong side."""
        if not len(seen) or not (seen[:, 1] == 0).any():
            return float("-inf")
        w, y = seen[np.argsort(seen[:, 0], kind="stable")].T
        wrong = np.r_[0, np.cumsum(y == 1)] + ((y == 0).sum() - np.r_[0, np.cumsum(y == 0)])
        edges = np.r_[w[0] - 2, w, w[-1] + 2]
        best = np.flatnonzero(wrong == wrong.min())
        i = best[np.argmax(edges[best + 1] - edges[best])]
        return float((edges[i] + edges[i + 1]) / 2)

    def keyed(self, docs: DataFrame, weight: str, key: str, seed: int = 0) -> DataFrame:
        docs = docs.withColumn(weight, log_weight(F.col(self.text_col), self.ratio))
        return docs.withColumn(key, F.col(weight) + gumbel(self.id_col, seed))

    def size(self, keys: DataFrame, weight: str) -> int:
        return keys.where(F.col(weight) >= self.cut).count()


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) of every row of docs."""
    model = Resampler(docs, labels, id_col, text_col)
    keys = common.written(model.keyed(docs.select(id_col, text_col), "log_weight", "gumbel_key").select(id_col, "log_weight", "gumbel_key"), "gumbel")
    least = kth_largest(keys, "gumbel_key", model.size(keys, "log_weight") if k is None else k)
    return keys.withColumn("selected", F.col("gumbel_key") >= least)


def selected(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the sample takes; weights are computed again rather than joined."""
    model = Resampler(docs, labels, id_col, text_col)
    weight, key = f"{common.OWN}weight", f"{common.OWN}key"
    keys = common.written(model.keyed(docs.select(id_col, text_col), weight, key).select(weight, key), "gumbel")
    least = kth_largest(keys, key, model.size(keys, weight) if k is None else k)
    return model.keyed(docs, weight, key).where(F.col(key) >= least).drop(weight, key)
