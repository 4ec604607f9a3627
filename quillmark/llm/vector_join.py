"""Embedding near-dedup by an epsilon grid order join.

Unit vectors within cosine c lie within eps = sqrt(2 - 2c) of each other, and
so do their projections on any orthonormal axes. Vectors are sorted by the
cells, eps wide, of their leading principal coordinates (the epsilon grid
order), cut into blocks of `BLOCK_ROWS`, and blocks of one label are paired
where their boxes of projections lie within eps. A pair of blocks is joined by
halving its intervals of the order, skipping pairs whose boxes are farther
apart, down to leaves that are compared by exact dot products in double.

Equal vectors of a label are one class, joined once. A pair of blocks returns
its rows' numbers of links and a spanning forest of the links, never all of
them; components come from the forests. Pairs are joined in tiles of
2 ** `TILE` by 2 ** `TILE` neighbouring blocks, to which each block goes once.

The principal axes are those of a bounded sample (`AXES_SAMPLE` vectors); they
decide how much is skipped, not what is found.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors with a null label or id, link with nothing; vectors of
different lengths don't link; rows of one vector (repeated rows too) link with
each other; rows of one id and different vectors have their own links, and are
in one component; a component's id is its smallest vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD, AXES, AXES_SAMPLE = 0.98, 6, 10_000
BLOCK_ROWS, LEAF, TILE = 512, 128, 4

_NONE = np.iinfo(np.int64).max


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """(length, AXES) orthonormal axes by vector length, of a bounded sample of v by hash of the key."""
    by_length: dict[int, list[np.ndarray]] = {}
    for r in vectors.orderBy("key").limit(AXES_SAMPLE).select("v").toLocalIterator():
        by_length.setdefault(len(r["v"]), []).append(np.array(r["v"], float))
    out = {}
    for d, rows in by_length.items():
        x = np.stack(rows)
        scale = np.abs(x).max(axis=1, keepdims=True)
        x = x / scale
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[d] = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d) + 1e-12 * np.eye(d))[1][:, ::-1][:, :AXES]
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def ordered(classes: DataFrame, eps: float) -> DataFrame:
    """classes (key, cid, label, head, size, v) with dims and the cells of their projections, as projected by Arrow batches."""
    axes = principal_axes(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["dims"] = [len(v) for v in pdf["v"]]
            for d, part in pdf.groupby("dims"):
                x = unit(np.array([np.asarray(v, float) for v in part["v"]]))
                a = axes.get(d, np.eye(d)[:, :AXES])
                cell = np.floor(x @ a / eps).astype(np.int64)
                cell = np.pad(cell, ((0, 0), (0, AXES - cell.shape[1])))
                yield part.assign(cell=list(cell))[["label", "cid", "head", "size", "dims", "cell", "v"]]

    out = classes.mapInPandas(run, "label string, cid long, head long, size long, dims int, cell array<long>, v array<double>")
    keys = [F.col("label"), F.col("dims"), *(F.col("cell")[i] for i in range(AXES)), F.col("head"), F.col("cid")]
    parts = max(1, classes.rdd.getNumPartitions())
    return out.repartitionByRange(parts, *keys).sortWithinPartitions(*keys), axes


def blocks_of(classes: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the order: bid, label, dims, box (lo, hi) and their rows as bytes."""
    rows, axes = ordered(classes, eps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for pdf in batches:
            for r in pdf[["label", "dims", "cid", "head", "size", "v"]].itertuples(index=False):
                if held and (key != (r.label, r.dims) or len(held) == block_rows):
                    yield pack(held, key)
                    held = []
                key = (r.label, r.dims)
                held.append(r)
        if held:
            yield pack(held, key)

    def pack(held: list, key: tuple) -> pd.DataFrame:
        x = unit(np.array([np.asarray(r.v, float) for r in held]))
        y = x @ axes.get(key[1], np.eye(key[1])[:, :AXES])
        return pd.DataFrame(
            {
                "label": [key[0]],
                "dims": [key[1]],
                "lo": [y.min(axis=0)],
                "hi": [y.max(axis=0)],
                "cids": [np.array([r.cid for r in held], np.int64).tobytes()],
                "heads": [np.array([r.head for r in held], np.int64).tobytes()],
                "sizes": [np.array([r.size for r in held], np.int64).tobytes()],
                "x": [x.tobytes()],
                "y": [np.ascontiguousarray(y).tobytes()],
            }
        )

    out = rows.mapInPandas(run, "label string, dims int, lo array<double>, hi array<double>, cids binary, heads binary, sizes binary, x binary, y binary")
    return common.written(out.withColumn("bid", F.monotonically_increasing_id()), "ego-blocks")


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks of a label whose boxes lie within eps; met by slabs of the first axis."""
    slab = lambda c: F.floor(c / eps).cast("long")
    a = blocks.select("label", "dims", F.col("bid").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), slab(F.col("lo")[0]).alias("first"), slab(F.col("hi")[0]).alias("last"))
    a = a.withColumn("slab", F.explode(F.sequence("first", "last")))
    b = blocks.select("label", "dims", F.col("bid").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), slab(F.col("lo")[0] - eps).alias("from"), slab(F.col("hi")[0] + eps).alias("to"))
    b = b.withColumn("slab", F.explode(F.sequence("from", "to")))
    gap = "aggregate(sequence(0, size(alo) - 1), 0D, (s, i) -> s + pow(greatest(0D, blo[i] - ahi[i], alo[i] - bhi[i]), 2))"
    pairs = a.join(b, ["label", "dims", "slab"]).where((F.col("a") <= F.col("b")) & (F.col("slab") == F.greatest("first", "from")))
    return pairs.where(F.expr(gap) <= eps * eps).select("a", "b")


class Forest:
    """Components of the rows seen so far, by union-find."""

    def __init__(self) -> None:
        self.over: dict[int, int] = {}

    def root(self, x: int) -> int:
        over = self.over
        while (up := over.get(x, x)) != x:
            over[x] = over.get(up, up)
            x = up
        return x

    def tie(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.over[max(x, y)] = min(x, y)


def joined(a: dict, b: dict, eps: float, threshold: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """(links of a's rows, links of b's, forest by head) of the pairs within the threshold; a may be b."""
    same = a is b
    na, nb = np.zeros(len(a["heads"]), np.int64), np.zeros(len(b["heads"]), np.int64)
    forest = Forest()
    todo = [(0, len(na), 0, len(nb))]
    while todo:
        i, j, k, m = todo.pop()
        ya, yb = a["y"][i:j], b["y"][k:m]
        gap = np.maximum(0, np.maximum(yb.min(axis=0) - ya.max(axis=0), ya.min(axis=0) - yb.max(axis=0)))
        if gap @ gap > eps * eps:
            continue
        if j - i > LEAF or m - k > LEAF:
            ha, hb = (i + j) // 2, (k + m) // 2
            if same and (i, j) == (k, m):
                todo += [(i, ha, i, ha), (i, ha, ha, j), (ha, j, ha, j)]
            elif j - i >= m - k:
                todo += [(i, ha, k, m), (ha, j, k, m)]
            else:
                todo += [(i, j, k, hb), (i, j, hb, m)]
            continue
        near = a["x"][i:j] @ b["x"][k:m].T >= threshold
        diagonal = same and (i, j) == (k, m)
        if diagonal:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        na[i:j] += near @ b["sizes"][k:m]
        if not diagonal:
            nb[k:m] += a["sizes"][i:j] @ near
        # The leaf's components, by the smallest head that its links reach.
        heads_a, heads_b = a["heads"][i:j], b["heads"][k:m]
        low_a, low_b = heads_a, heads_b
        while True:
            back = np.minimum(low_b, np.where(near, low_a[:, None], _NONE).min(axis=0))
            there = np.minimum(low_a, np.where(near, back[None, :], _NONE).min(axis=1))
            if np.array_equal(there, low_a) and np.array_equal(back, low_b):
                break
            low_a, low_b = there, back
        for h, low in {*zip(heads_a.tolist(), low_a.tolist()), *zip(heads_b.tolist(), low_b.tolist())}:
            forest.tie(h, low)
    if same:
        return na + nb, na * 0, forest
    return na, nb, forest


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component, kept) of every row of vectors."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.when(fine & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.transform(v, lambda x: x.cast("double") + 0.0)).alias("v"),
    )
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.length("label").cast("string"), "label", F.col("v").cast("array<string>")), 256)))
    some = rows.where(F.col("v").isNotNull())
    classes = some.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = common.written(classes.withColumn("cid", F.monotonically_increasing_id()), "ego-classes")
    blocks = blocks_of(classes, eps, block_rows)
    pairs = near_blocks(blocks, eps)

    def run(tile: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        def part(r) -> dict:
            heads = np.frombuffer(r.heads, np.int64)
            return {"cids": np.frombuffer(r.cids, np.int64), "heads": heads, "sizes": np.frombuffer(r.sizes, np.int64), "x": np.frombuffer(r.x).reshape(len(heads), -1), "y": np.frombuffer(r.y).reshape(len(heads), -1)}

        held = {r.bid: part(r) for r in tile.itertuples(index=False)}
        counts, forest = [], Forest()
        for x, y in zip(pairs["a"], pairs["b"]):
            a, b = held[x], held[y]
            na, nb, found = joined(a, b, eps, threshold)
            for cids, n in ((a["cids"], na), (b["cids"], nb)):
                counts.append(pd.DataFrame({"cid": cids[n > 0], "links": n[n > 0]}))
            for h in found.over:
                forest.tie(h, found.root(h))
        out = pd.concat([pd.DataFrame({"cid": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)}), *counts]).groupby("cid", as_index=False)["links"].sum()
        ties = pd.DataFrame([(h, forest.root(h)) for h in forest.over], columns=["head", "other"], dtype="Int64")
        return pd.concat([out.astype("Int64"), ties])[["cid", "links", "head", "other"]]

    tiles = pairs.withColumns({"ta": F.shiftright("a", TILE), "tb": F.shiftright("b", TILE)})
    tiles = common.written(tiles, "ego-pairs")
    need = tiles.select("ta", "tb", F.col("a").alias("bid")).union(tiles.select("ta", "tb", "b")).distinct()
    shipped = need.select(F.col("ta").alias("sa"), F.col("tb").alias("sb"), "bid").join(blocks.select("bid", "cids", "heads", "sizes", "x", "y"), "bid")
    found = shipped.groupBy("sa", "sb").cogroup(tiles.groupBy("ta", "tb")).applyInPandas(run, "cid long, links long, head long, other long")
    found = common.written(found, "ego-links")
    # Rows of one id and several vectors tie their classes together.
    member = some.select("id", "key").join(classes.select("key", "head"), "key").select("id", "head").distinct()
    several = member.groupBy("id").agg(F.min("head").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = found.where("other is not null").select("head", "other").union(member.join(several, "id").where("head <> other").select("head", "other"))
    component = common.connected_components(edges, "head", "other").withColumnRenamed("node", "head")
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("key", "cid", "head", "size").join(links, "cid", "left").join(component, "head", "left")
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.coalesce("component", "head", "id")
    return out.select("id", F.coalesce(F.col("links"), F.lit(0)).alias("more"), F.coalesce(F.col("size") - 1, F.lit(0)).alias("twins"), component.alias("component")).select(
        "id", (F.col("more") + F.col("twins")).alias("n_links"), "component", (F.col("id") == F.col("component")).alias("kept")
    )
