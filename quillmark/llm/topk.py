"""Exact top-k by inner product from impact-ordered indexes, a score at a time.

Candidates are integer vectors, dealt into indexes of at most `INDEX_ROWS`. An
index holds a posting for each component: its row, dimension and impact level,
which is the component's size without the last `SHIFT` bits. Postings are kept
in segments of one level and dimension, by descending level; an index is built
once, written, and serves all queries. Bands of segments are processed in that
order, for some queries at a time, each adding its quantised scores to the
rows' accumulators. What is unprocessed of a row has a known length, so that
its score lies within that length times the query's of its accumulator.
Processing stops for a query only when these bounds prove that few rows can be
among its k best; those rows are scored again exactly. The indexes' answers
meet in one k-best per query.

Queries go to the indexes in blocks of at most `QUERY_ROWS`, one broadcast at a
time, which is freed once the block's answers are written.

Defined results: vectors null, empty, or holding null or non-finite components
take no part; rows and queries with components of `WIDE` or more have no
postings but are scored exactly as whole numbers of any size, and only an
answer whose score doesn't fit a long is an error; only vectors of one length
are compared; rows with the query's id are its own; repeated rows are
candidates each; ties go to the smaller id; a null id takes no part; other
columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHIFT, INDEX_ROWS, QUERY_ROWS, QUERIES_AT_ONCE = 2, 16_384, 8_192, 128
#: Products of smaller components fit 64 bits, whatever the number of dimensions up to 2 ** 9 (see Index.narrow).
WIDE = 1 << 27
#: Shares of postings below the bands' lowest levels.
BANDS = (0.75, 0.5, 0.25)


def product(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of whole numbers held as doubles, exactly."""
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


class Index:
    """Postings of whole-number vectors by descending impact level, and the vectors for exact scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that ties come in the order of ids
        self.ids, vectors = ids[order], vectors[order]
        dims = vectors.shape[1]
        most = min(WIDE, int((2.0**62 / max(1, dims)) ** 0.5))
        wide = (np.abs(vectors) >= most).any(axis=1)
        self.most, self.wide = most, [(int(i), vectors[i]) for i in np.flatnonzero(wide)]
        self.exact = np.where(wide[:, None], 0, vectors).astype(np.int64)
        self.plain = ~wide
        level = np.abs(self.exact) >> SHIFT
        row, dim = np.nonzero(self.exact)
        order = np.lexsort((row, dim, -level[row, dim]))
        self.row, self.dim = row[order].astype(np.int32), dim[order].astype(np.int32)
        level = level[self.row, self.dim]
        edges = sorted({int(np.quantile(level, share)) for share in BANDS if level.size} | {0}, reverse=True)
        self.ends = [int(np.searchsorted(-level, -edge, side="right")) for edge in edges]

    def bands(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(dimensions x rows matrix of a band's quantised components, length of each row that is unprocessed after it)."""
        rest = (self.exact.astype(float) ** 2).sum(axis=1)
        start = 0
        for end in self.ends:
            row, dim = self.row[start:end], self.dim[start:end]
            value = self.exact[row, dim]
            # The middle of a level stands for its values; level 0 for none.
            level = np.abs(value) >> SHIFT
            middle = np.where(level > 0, np.sign(value) * ((level << SHIFT) + (1 << SHIFT) / 2 - 0.5), 0.0)
            band = np.zeros(self.exact.shape[::-1])
            band[dim, row] = middle
            rest = rest + np.bincount(row, (value - middle) ** 2 - value.astype(float) ** 2, minlength=len(rest))
            yield band, np.sqrt(np.maximum(rest, 0))
            start = end

    def best(self, query_id: int, query: np.ndarray, members: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, score, id) of the k best of the members, and of the rows that have no postings."""
        if (np.abs(query) >= self.most).any():
            found = [(product(query, self.exact[i]), i) for i in members.tolist()]
        else:
            found = list(zip((self.exact[members] @ query.astype(np.int64)).tolist(), members.tolist()))
        found += [(product(query, v), i) for i, v in self.wide if self.ids[i] != query_id]
        found.sort(key=lambda x: (-x[0], x[1]))
        return [(int(query_id), s, int(self.ids[i])) for s, i in found[:k]]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, score, id) of the k best of each query, without rows of the query's own id."""
        own = self.ids[None, :] == query_ids[:, None]
        out: list[tuple[int, int, int]] = []
        wide = (np.abs(queries) >= self.most).any(axis=1)
        for t in np.flatnonzero(wide).tolist():
            out += self.best(query_ids[t], queries[t], np.flatnonzero(self.plain & ~own[t]), k)
        todo = np.flatnonzero(~wide)
        size = np.sqrt((queries[todo] ** 2).sum(axis=1))
        size = dict(zip(todo.tolist(), size.tolist()))
        score = np.zeros((len(queries), len(self.ids)))
        for b, (band, rest) in enumerate(self.bands()):
            if not len(todo):
                break
            score[todo] += queries[todo] @ band
            # |sum of the unprocessed| <= |query| |rest|; a little more for rounding.
            lengths = np.array([size[t] for t in todo.tolist()])
            slack = np.outer(lengths, rest + 1e-7 * (1 + np.abs(self.exact).max(initial=0))) + 1e-6
            ours = self.plain & ~own[todo]
            low = np.where(ours, score[todo] - slack, -np.inf)
            at = max(0, low.shape[1] - k)
            possible = ours & (score[todo] + slack >= np.partition(low, at, axis=1)[:, at][:, None])
            done = (possible.sum(axis=1) <= max(4 * k, len(self.ids) // 64)) | (b == len(self.ends) - 1)
            for t, members in zip(todo[done].tolist(), possible[done]):
                out += self.best(query_ids[t], queries[t], np.flatnonzero(members), k)
            todo = todo[~done]
        return out


def scaled(vector: Column) -> Column:
    """floor(256 * x) of every component as array<double>, or null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # Beyond 2 ** 52 all doubles are whole numbers; floor would make longs of them.
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, lambda x: whole(x.cast("double") * 256)))


def indexes(candidates: DataFrame, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(dims, postings) of candidates (id, v): an index in each row, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(dims: int) -> pd.DataFrame:
            rows = held.pop(dims)
            made = Index(np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], float))
            return pd.DataFrame({"dims": [dims], "postings": [pickle.dumps(made, 5)]})

        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["v"]):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == index_rows:
                    yield row(len(v))
        for dims in list(held):
            yield row(dims)

    return common.written(candidates.mapInPandas(run, "dims int, postings binary"), "topk-index")


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates (id, v) of each query (id, v); v of scaled()."""
    candidates, queries = (df.select(F.col("id").cast("long").alias("id"), "v").where("id is not null and v is not null") for df in (candidates, queries))
    spark = candidates.sparkSession
    built, found = None, None
    for block in _blocks(queries, query_rows):
        built = indexes(candidates, index_rows) if built is None else built
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dims, data in zip(pdf["dims"], pdf["postings"]):
                    index = pickle.loads(data)
                    mine = [(q, v) for q, v in held.value if len(v) == dims]
                    for i in range(0, len(mine), QUERIES_AT_ONCE):
                        part = mine[i : i + QUERIES_AT_ONCE]
                        out = index.search(np.array([q for q, _ in part], np.int64), np.array([v for _, v in part], float), k)
                        if any(abs(s) >= 1 << 63 for _, s, _ in out):
                            raise OverflowError("a score among the best of an index doesn't fit a long")
                        yield pd.DataFrame(out, columns=["query_id", "score", "vec_id"]).astype("int64")

        part = common.written(built.mapInPandas(run, "query_id long, score long, vec_id long"), "topk-found")
        held.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, rows: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block: list[tuple[int, np.ndarray]] = []
    for r in queries.toLocalIterator():  # the stated query set, a block in memory at a time
        block.append((r["id"], np.array(r["v"], float)))
        if len(block) == rows:
            yield block
            block = []
    if block:
        yield block
