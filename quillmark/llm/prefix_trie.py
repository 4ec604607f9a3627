"""Tries of conversations' prefixes: succinct level-order tries of sorted shards, merged at their edges.

A conversation is the list of its turns' digests. Sorted by them and dealt out
by ranges, conversations of one prefix are neighbours, so each shard is an
interval of the trie, however many conversations share a first turn or are the
same. A task builds its shard's trie level by level: a LOUDS bit vector (a one
for each child, a zero for each node's end) and an array of labels; counts,
smallest members, leaves and savings go up in reverse breadth-first order.

Only the nodes on the paths of a shard's first and last conversation can go on
in another shard. They are merged apart: their sums are grouped by node, a
trie of them alone rolls up what is beneath, and hashes of long lists of members
are taken from runs of them, in order, one run at a time. There are at most two
paths a shard, whatever the number of conversations.

Defined results: rows without a conversation id are left out; turns are ordered
by `turn`, null first, and ties by the digest of role and text; a null role or
text is empty; repeated rows are turns each; texts of any length are hashed where
they are read, and a conversation's digests (16 bytes a turn) are one row; columns
other than the four named are not read; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import OWN

#: Turns that a shard holds at most, about, and below which it isn't worth one.
SHARD_TURNS, LEAST_TURNS = 1 << 20, 1 << 13
#: Members of a run whose ids are one string.
RUN = 512
#: Rows of the upper trie up to which it goes to all executors, some 150 bytes each.
BROADCAST_ROWS = 100_000
NOBODY = hashlib.sha256(b"").hexdigest()
_LABEL = 16  # bytes of a digest

_PARTS = (
    "kind string, key string, parent_key string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, tokens long, ends string, label string"
)
_NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "label"]


def turn_lists(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order, as structs of (turn, label, words); label is the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), label.alias("label"), words.alias("words"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), one.alias("t"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(lists: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """(conv, turns) with each conversation's first turns taken from the first of its block of ids.

    Of conversation c they are the first h turns of conversation c - c % block, h
    being crc32(c as text) % most; its own turns after its first h follow.
    """
    lists = common.written(lists, "turns")
    heads = lists.where(F.col("conv") % block == 0).select(F.col("conv").alias(OWN + "base"), F.slice("turns", 1, most - 1).alias(OWN + "head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    head = F.slice(F.coalesce(F.col(OWN + "head"), F.slice("turns", 1, 0)), F.lit(1), h)
    both = lists.join(heads, F.col("conv") - F.col("conv") % block == F.col(OWN + "base"), "left")
    return both.select("conv", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


class Louds:
    """A trie's shape in level order: a super-root's '10', then for each node a one for each child and a zero."""

    def __init__(self, degrees: np.ndarray):
        self.nodes = len(degrees)
        bits = np.ones(2 * self.nodes + 1, bool)
        bits[np.r_[1, 2 + np.cumsum(degrees) + np.arange(self.nodes)]] = False
        self.packed = np.packbits(bits)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=2 * self.nodes + 1).astype(bool)

    def parents(self) -> np.ndarray:
        """Each node's parent: the number of zeros before its one, less the super-root's; -1 for the root."""
        bits = self.bits()
        return np.cumsum(~bits)[bits] - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits())) - 1


def rolled_up(levels: np.ndarray, parents: np.ndarray, sums: list[np.ndarray], least: list[np.ndarray], stop: np.ndarray | None = None) -> None:
    """Adds each node's sums to its parent's, and lowers its parent's least to its own, deepest level first; nodes in `stop` pass nothing on.

    levels has where each level begins, and the end.
    """
    for d in range(len(levels) - 2, 0, -1):
        level = np.arange(levels[d], levels[d + 1])
        if stop is not None:
            level = level[~stop[level]]
        for x in sums:
            np.add.at(x, parents[level], x[level])
        for x in least:
            np.minimum.at(x, parents[level], x[level])


class Shard:
    """The trie of sorted conversations: paths (their labels, joined), words of each turn, ids."""

    def __init__(self, paths: list[bytes], words: np.ndarray, convs: np.ndarray):
        rows = len(paths)
        self.paths, self.convs = paths, convs
        n = np.fromiter(map(len, paths), np.int64, rows) // _LABEL
        first = np.cumsum(n) - n
        data = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
        # How many labels a conversation has in common with the one before it.
        common_with = np.zeros(rows, np.int64)
        alive, k = np.arange(1, rows), 0
        while len(alive):
            alive = alive[(n[alive] > k) & (n[alive - 1] > k)]
            alive = alive[(data[first[alive] + k] == data[first[alive - 1] + k]).all(axis=1)]
            common_with[alive] += 1
            k += 1
        common_with[0] = -1  # the root is new to the first
        # A conversation's new nodes are those deeper; in level order, each level by conversations.
        new = n - common_with
        row = np.repeat(np.arange(rows), new)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(common_with, new) + 1
        order = np.argsort(depth, kind="stable")
        self.row, self.depth = row[order], depth[order]
        self.levels = np.searchsorted(self.depth, np.arange(int(self.depth[-1]) + 2))
        place = self.depth * rows + self.row
        self.node_of = lambda depth, row: np.searchsorted(place, depth * rows + row, side="right") - 1
        degrees = np.bincount(self.node_of(self.depth[1:] - 1, self.row[1:]), minlength=len(place))
        self.louds = Louds(degrees)
        self.labels = np.zeros((len(place), 2), np.uint64)
        self.tokens = np.zeros(len(place), np.int64)
        at = (first[self.row] + self.depth - 1)[1:]
        self.labels[1:], self.tokens[1:] = data[at], words[at]
        self.end = self.node_of(n, np.arange(rows))
        self.open = self.row == 0
        self.open[self.node_of(np.arange(n[-1] + 1), np.full(n[-1] + 1, rows - 1))] = True

    def keys(self) -> dict[int, str]:
        """Names of the open nodes: digests of their labels."""
        out = {}
        for row in (0, len(self.paths) - 1):
            digest, path = hashlib.md5(), self.paths[row]
            for d in range(len(path) // _LABEL + 1):
                digest.update(path[(d - 1) * _LABEL : d * _LABEL] if d else b"")
                out[int(self.node_of(d, row))] = digest.copy().hexdigest()
        return out

    def parts(self) -> pd.DataFrame:
        """Rows of _PARTS: closed nodes, whole; open nodes, with the sums of what is closed beneath; runs of members that end at open nodes."""
        parents, degrees = self.louds.parents(), self.louds.degrees()
        nodes, shut = self.louds.nodes, ~self.open
        count, low = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int64).max)
        np.add.at(count, self.end, 1)
        np.minimum.at(low, self.end, self.convs)
        rolled_up(self.levels, parents, [count], [low])
        leaves, saved = ((degrees == 0) & shut).astype(np.int64), np.where(shut, (count - 1) * self.tokens, 0)
        rolled_up(self.levels, parents, [leaves, saved], [], stop=self.open)
        children = degrees - np.bincount(parents[1:][self.open[1:]], minlength=nodes)
        keys = self.keys()
        above = np.r_[0, parents[1:]]
        hang = self.open[above]  # nodes right under an open one
        hang[0] = False
        ends = np.where(shut, NOBODY, None).astype(object)
        runs = []
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(self.end) != 0]), len(self.end)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            node = int(self.end[a])
            if shut[node]:
                ends[node] = hashlib.sha256(",".join(map(str, self.convs[a:b].tolist())).encode()).hexdigest()
            else:
                runs += [(keys[node], int(self.convs[k]), ",".join(map(str, self.convs[k : min(k + RUN, b)].tolist()))) for k in range(a, b, RUN)]
        out = pd.DataFrame({
            "kind": np.where(shut, "closed", "open"), "key": [keys.get(i) for i in range(nodes)], "parent_key": [keys[p] if h else None for p, h in zip(above.tolist(), hang.tolist())],
            "depth": self.depth, "conv_id": low, "parent_conv_id": pd.array(low[above], "Int64"), "n_convs": count, "n_children": children,
            "n_leaves": leaves, "saved_tokens": saved, "tokens": self.tokens, "ends": ends, "label": [x.tobytes().hex() for x in self.labels],
        })
        out.loc[hang | (np.arange(nodes) == 0), "parent_conv_id"] = pd.NA
        out.loc[self.depth == 0, "label"] = None
        more = pd.DataFrame(runs, columns=["key", "conv_id", "ends"]).assign(kind="run").reindex(columns=out.columns)
        whole = [c for c in out.columns if c not in ("kind", "key", "parent_key", "ends", "label")]
        return pd.concat([x.astype(dict.fromkeys(whole, "Int64")) for x in (out, more) if len(x)], ignore_index=True)


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [b for b in batches if len(b)]
    if got:
        pdf = pd.concat(got, ignore_index=True)
        words = np.concatenate([np.zeros(0, np.int64), *pdf["words"]]).astype(np.int64)
        yield Shard(pdf["path"].tolist(), words, pdf["conv"].to_numpy(np.int64)).parts()


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, ends_sha256) of runs that come by key and in order; holds one batch."""
    key, digest = None, None
    for pdf in batches:
        done = []
        for k, run in zip(pdf["key"], pdf["ends"]):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(run.encode())
            else:
                digest.update(b"," + run.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if digest:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def _upper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The merged open nodes, with what is beneath each rolled up."""
    got = [b for b in batches if len(b)]
    if not got:
        return
    pdf = pd.concat(got, ignore_index=True).sort_values(["depth", "key"], ignore_index=True)
    place = {k: i for i, k in enumerate(pdf["key"])}
    parents = np.array([-1] + [place[k] for k in pdf["parent_key"][1:]], np.int64)
    depth = pdf["depth"].to_numpy(np.int64)
    levels = np.searchsorted(depth, np.arange(int(depth[-1]) + 2))
    children = pdf["n_children"].to_numpy(np.int64) + np.bincount(parents[1:], minlength=len(pdf))
    leaves = pdf["n_leaves"].to_numpy(np.int64) + (children == 0)
    saved = pdf["saved_tokens"].to_numpy(np.int64) + (pdf["n_convs"].to_numpy(np.int64) - 1) * pdf["tokens"].to_numpy(np.int64)
    rolled_up(levels, parents, [leaves, saved], [])
    pdf["n_children"], pdf["n_leaves"], pdf["saved_tokens"] = children, leaves, saved
    pdf["parent_conv_id"] = pd.array(pdf["conv_id"].to_numpy()[np.maximum(parents, 0)], "Int64")
    pdf.loc[parents < 0, "parent_conv_id"] = pd.NA
    yield pdf[["key", *_NODES]]


def trie(lists: DataFrame, shards: int | None = None) -> DataFrame:
    """A row per node of the trie of (conv, turns): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, label.

    saved_tokens sums, over the node's subtree, each node's (n_convs - 1) times the
    words of its last turn; ends_sha256 is the digest of the ids of the conversations
    that end at the node, ascending and joined by commas; label is its last turn's.
    """
    spark = lists.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["label"]), "")).alias("path")
    rows = common.written(lists.select("conv", path, F.transform("turns", lambda t: t["words"]).alias("words")), "paths")
    turns = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = shards or max(1, -(-turns // SHARD_TURNS), min(-(-turns // LEAST_TURNS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartitionByRange(shards, "path", "conv").sortWithinPartitions("path", "conv")
    parts = common.written(dealt.mapInPandas(_shards, _PARTS), "trie")
    # A node is open in some shards: sums by node, then a small trie of them.
    ends = parts.where("kind = 'run'").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = ends.mapInPandas(_hashed, "key string, ends_sha256 string")
    sums = parts.where("kind = 'open'").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("tokens").alias("tokens"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("label").alias("label"),
    )
    sums = sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
    nodes = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, label string"
    upper = common.written(sums.repartition(1).mapInPandas(_upper, f"key string, {nodes}"), "upper")
    names = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias(OWN + "parent"))
    if upper.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    closed = parts.where("kind = 'closed'").withColumnRenamed("ends", "ends_sha256").join(names, "parent_key", "left")
    closed = closed.withColumn("parent_conv_id", F.coalesce("parent_conv_id", OWN + "parent"))
    return closed.select(*_NODES).union(upper.select(*_NODES))
