"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

The windows are the words of the lower-cased text, each with its bounding spaces
and a fixed pad that both dictionaries hold. (In windows of several words the
parser's choices among ordinary matches move lengths by more than a toxic word
does; README has figures.) A window's distance is the sum, over two parsers, of
its compressed length under a dictionary of ordinary text less that under a
dictionary that holds toxic text as well. There is a pair of dictionaries for
each cluster of texts of alike letters (a language, mostly), and one for texts
of clusters with too few toxic samples; clusters are learned from the texts, by
spherical k-means of the letters' counts.

The toxic dictionary holds what marks toxic texts of its cluster: of the spans
of 5 to 10 bytes within a word (its bounding spaces included) those that one,
two or three words of a text hold `RATE` times as often in toxic as in ordinary
texts, with a log-likelihood ratio of `EVIDENCE` or more, be they of ordinary
syllables or not. It holds whole covered stretches of words, those of most texts
last. The ordinary one is trained by zstandard on ordinary texts and has no word
with a mark.

A logistic model of a text's largest distances, and of its counts and shares of
windows beyond thresholds, is calibrated across `FOLDS` folds: each text is
scored with dictionaries that didn't see it. Clusters share its weights and
deviate from them as far as their own samples say.

Labels are learned from at most `SAMPLE` rows of a class, the first by hash of
the id among those that have a document: a bounded sample, of whole texts. All
texts are scored whole.

Defined results: null and empty texts have no window and get the score of a
text without distance; rows labelled twice count as toxic if one label does;
with no labelled rows of a class every score is 0; a very long word is one window.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 1500
#: Held by both dictionaries: keeps a window long enough to be compressed at all.
PAD = b"|=#0123456789abcdefghijklmnop#=|"
PARSERS = (zstandard.STRATEGY_LAZY2, zstandard.STRATEGY_BTOPT)
ORDINARY_BYTES = 32_768
#: Bytes of a span, least and most.
SHORTEST_SPAN, LONGEST_SPAN = 5, 10
#: How much oftener than in ordinary texts a mark occurs, and the least log-likelihood ratio of a mark;
#: where the sample is too small for any span to have that, those of the largest ratio are the marks.
RATE, EVIDENCE = 8, 30
#: Numbers of a text's words that hold a span, each of which is tested.
TIMES = (1, 2, 3)
#: Sample texts whose spans are merged at a time.
MERGED = 64
#: Words whose spans are held against the marks at a time.
COVERED = 10_000
FOLDS = 3
#: Clusters at most; texts nearer to a centre than APART need no further one; toxic samples that a cluster of its own needs.
CLUSTERS, APART, LEAST_TOXIC = 8, 0.93, 12
#: Thresholds of a window's distance, in bytes.
BEYOND = (2, 3, 5)
#: Words whose distances a worker keeps of each pair; it forgets all of them beyond that.
WORDS_KEPT = 100_000
_LETTERS = np.array([b for b in range(256) if b >= 128 or 97 <= b <= 122])


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def spans(of: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, hashes, words, places) of the spans of each length: words tells whose they are, places where they start in b" word "."""
    size = np.fromiter((len(w) + 2 for w in of), np.int64, len(of))
    data = np.frombuffer(b"".join(b" " + w + b" " for w in of), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(of)), size)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    room = size[word] - place
    hashes = np.zeros(len(data), np.uint64)
    for length in range(1, LONGEST_SPAN + 1):
        n = max(0, len(data) - length + 1)
        hashes = hashes[:n] * np.uint64(0x100000001B3) + data[length - 1 :] + np.uint64(1)
        if length >= SHORTEST_SPAN:
            at = np.flatnonzero(room[:n] >= length)
            yield length, hashes[at] * np.uint64(2 * length + 1), word[at], place[at]


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted ones."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def held(text: list[bytes], of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted span hashes of a text, for each of TIMES whether so many of its distinct words hold it), of all spans or of those among some."""
    distinct = sorted(set(text))
    found = [h for _, h, _, _ in spans(distinct)] if distinct else [np.zeros(0, np.uint64)]
    h = np.concatenate(found)
    if of is not None:
        h = h[among(h, of)]
    h, n = np.unique(h, return_counts=True)
    return h, n[:, None] >= np.array(TIMES)


def counted(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted span hashes, texts that hold each as often as each of TIMES) of the spans of `least` texts or more.

    A first pass counts texts by part of the hash, so that rare spans, which are
    most, are never held.
    """
    part = np.uint64((1 << 22) - 1)
    rough = np.zeros(1 << 22, np.uint16)
    for t in texts:
        rough[np.unique(held(t)[0] & part)] += 1
    keys, total = np.zeros(0, np.uint64), np.zeros((0, len(TIMES)), np.int32)
    for i in range(0, len(texts), MERGED):
        parts = [(keys, total)]
        for t in texts[i : i + MERGED]:
            h, n = held(t)
            often = rough[h & part] >= least
            parts.append((h[often], n[often]))
        keys, inverse = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        n = np.concatenate([n for _, n in parts])
        total = np.stack([np.bincount(inverse, n[:, j], len(keys)) for j in range(len(TIMES))], axis=1).astype(np.int32)
    often = total[:, 0] >= least
    return keys[often], total[often]


def unlike(texts: list[list[bytes]]) -> np.ndarray:
    """Which texts aren't near copies of earlier ones: those that agree with none on a least hash of their runs of three words."""
    seen: set[tuple[int, int]] = set()
    out = np.zeros(len(texts), bool)
    for at, t in enumerate(texts):
        runs = np.fromiter((zlib.crc32(b" ".join(t[i : i + 3])) for i in range(max(1, len(t) - 2))), np.uint64)
        least = {(j, int((runs * np.uint64(m) % np.uint64(4294967291)).min())) for j, m in enumerate((1, 2654435761, 2246822519, 3266489917))}
        out[at] = not least & seen
        seen |= least
    return out


def ratio_of(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of shares k1 / n1 and k0 / n0 against one common share."""

    def fits(k: np.ndarray, n: int) -> np.ndarray:
        p = k / n
        return k * np.log(np.maximum(p, 1e-300)) + (n - k) * np.log(np.maximum(1 - p, 1e-300))

    return 2 * (fits(k1, n1) + fits(k0, n0) - fits(k1 + k0, n1 + n0))


def letters(text: list[bytes]) -> np.ndarray:
    """The direction of the roots of a text's letter counts; 0 without letters."""
    x = np.sqrt(np.bincount(np.frombuffer(b"".join(text), np.uint8), minlength=256)[_LETTERS].astype(float))
    return x / (np.linalg.norm(x) or 1.0)


def centres(x: np.ndarray) -> np.ndarray:
    """Centres of clusters of directions: each next one amid the tenth farthest from the others, then spherical k-means."""
    c = x.sum(axis=0, keepdims=True)
    while True:
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).max(axis=1)
        far = x[np.argsort(near, kind="stable")[: max(3, len(x) // 10)]]
        if len(c) == CLUSTERS or len(x) < 3 or near.mean() > APART and (far @ c.T).max(axis=1).mean() > APART:
            return c
        c = np.vstack([c, far[(far @ far.T).sum(axis=1).argmax()]])
        for _ in range(10):
            mine = (x @ c.T).argmax(axis=1)
            c = np.stack([x[mine == i].sum(axis=0) if (mine == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def covered(of: list[bytes], marked: np.ndarray) -> dict[bytes, list[bytes]]:
    """The words that hold a mark, each with its spans that marks cover; COVERED words at a time."""
    out = {}
    for i in range(0, len(of), COVERED):
        some, cover = of[i : i + COVERED], {}
        for length, h, word, place in spans(some):
            at = np.flatnonzero(among(h, marked))
            for w, p in zip(word[at].tolist(), place[at].tolist()):
                cover.setdefault(w, np.zeros(len(some[w]) + 2, bool))[p : p + length] = True
        for w, part in cover.items():
            edge = np.flatnonzero(np.diff(np.r_[False, part, False]))
            data = b" " + some[w] + b" "
            out[some[w]] = [data[s:e] for s, e in zip(edge[::2], edge[1::2])]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on samples; all of the samples where they are too few to train on."""
    samples = [s.ljust(8) for s in samples if s.strip()]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


class Learner:
    """Sample texts of a cluster, and the dictionaries that some of them make."""

    def __init__(self, toxic: list[list[bytes]], ordinary: list[list[bytes]]):
        self.toxic, self.ordinary = toxic, ordinary
        self.texts = toxic + ordinary
        self.y = np.arange(len(self.texts)) < len(toxic)
        # Near copies tell no more than one text.
        self.new = np.concatenate([unlike(toxic), unlike(ordinary)])
        n1, n0 = (int((self.new & (self.y == y)).sum()) for y in (True, False))
        # What no ordinary text would make of a span of k toxic texts.
        best = ratio_of(np.arange(n1 + 1), np.zeros(n1 + 1), n1, max(1, n0))
        enough = np.flatnonzero(best >= EVIDENCE)
        keys, n = counted([t for t, new in zip(toxic, self.new) if new], int(enough[0]) if len(enough) else min(2, n1))
        often = n.max(axis=1, initial=0) > 0
        self.keys = keys[often]
        self.held = [self._held(t) if new else None for t, new in zip(self.texts, self.new)]

    def _held(self, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """held() of the keys, by their places: a few bytes a span, as those of all texts are kept."""
        h, times = held(text, self.keys)
        return np.searchsorted(self.keys, h).astype(np.int32), times

    def marks(self, used: np.ndarray) -> np.ndarray:
        """The sorted hashes of the spans that mark the toxic ones of the used texts."""
        n = np.zeros((2, len(self.keys), len(TIMES)), np.int64)
        for i in np.flatnonzero(used & self.new):
            at, times = self.held[i]
            n[int(self.y[i]), at] += times
        n1, n0 = (max(1, int((used & self.new & (self.y == y)).sum())) for y in (True, False))
        ratio = np.where(n[1] * n0 >= RATE * (n[0] + 0.5) * n1, ratio_of(n[1], n[0], n1, n0), 0).max(axis=1, initial=0)
        return self.keys[(ratio > 0) & (ratio >= min(EVIDENCE, ratio.max(initial=0)))]

    def dictionaries(self, used: np.ndarray) -> tuple[bytes, bytes]:
        """The contents of the ordinary and of the toxic dictionary, from the used texts."""
        marked = self.marks(used)
        toxic = [t for t, u in zip(self.toxic, used) if u]
        found = covered(sorted(set().union(*toxic)), marked)
        texts = Counter(span for t in toxic for span in {s for w in set(t) for s in found.get(w, ())})
        ordinary = [t for t, u in zip(self.ordinary, used[len(self.toxic) :]) if u]
        plain = trained([b" ".join(t[i : i + 80]) for t in ordinary for i in range(0, len(t), 80)], ORDINARY_BYTES).split(b" ")
        bare = covered(sorted(set(plain)), marked)
        return b" ".join(w for w in plain if w not in bare), b"".join(sorted(texts, key=lambda span: (texts[span], span)))


class Distance:
    """The compression distance of words; made in each worker from the dictionaries' contents."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.known: dict[bytes, int] = {}
        # Filler keeps the ordinary text at the same distance, and the pad apart, which would cost other lengths otherwise.
        self.pairs = [(self._compressor(ordinary + bytes(len(toxic) + 1) + PAD, s), self._compressor(ordinary + toxic + bytes(1) + PAD, s)) for s in PARSERS]

    @staticmethod
    def _compressor(content: bytes, strategy: int) -> zstandard.ZstdCompressor:
        content = content.ljust(64)
        log = len(content).bit_length()
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            5, source_size=64, dict_size=len(content), window_log=max(17, log + 1), hash_log=max(16, log), chain_log=max(16, log), min_match=5, strategy=strategy, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        dictionary.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def of(self, text_words: list[bytes]) -> np.ndarray:
        known = self.known
        for w in set(text_words).difference(known):
            window = b" " + w + b" " + PAD
            known[w] = sum(len(o.compress(window)) - len(t.compress(window)) for o, t in self.pairs)
        out = np.fromiter(map(known.__getitem__, text_words), np.int64, len(text_words))
        if len(known) > WORDS_KEPT:
            known.clear()
        return out


def features(distances: np.ndarray) -> list[float]:
    """Of a text's windows: 1, the three largest distances, how many are beyond each threshold and what share is, damped."""
    top = np.r_[np.sort(np.partition(distances, -3)[-3:])[::-1] if len(distances) > 3 else np.sort(distances)[::-1], 0, 0, 0][:3].clip(0)
    beyond = [int((distances >= least).sum()) for least in BEYOND]
    return [1.0, *map(float, top), *(float(np.log1p(n)) for n in beyond), *(float(np.log1p(100 * n / max(1, len(distances)))) for n in beyond)]


FEATURES = 4 + 2 * len(BEYOND)


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: np.ndarray, steps: int = 60) -> np.ndarray:
    """The weights of a ridge logistic regression of rows that count `times` each, by Newton's method with steps halved until they descend."""
    w = np.zeros(x.shape[1])
    keep = np.diag(ridge)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((times * (np.logaddexp(0, z) - y * z)).sum() + w @ keep @ w / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (times * (y - p)) - keep @ w)
        while (then := loss(w + step)) > now and np.abs(step).max() >= 1e-8:
            step /= 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w + step, then
    return w


@dataclass
class Model:
    """Clusters' centres, the pair of each (the last pair being that of all texts), and each pair's weights."""

    centres: np.ndarray
    pair_of: list[int]
    pairs: list[tuple[bytes, bytes]]
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.distances = [Distance(*pair) for pair in model.pairs]

    def scores(self, texts: pd.Series) -> np.ndarray:
        """The probability that each text is toxic."""
        m = self.model
        z = np.zeros(len(texts))
        for i, t in enumerate(texts):
            w = words(t)
            pair = m.pair_of[int((m.centres @ letters(w)).argmax())]
            z[i] = m.weights[pair] @ features(self.distances[pair].of(w))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learned(toxic: list[str], ordinary: list[str], times: tuple[float, float] = (1.0, 1.0)) -> Model:
    """The model of sample texts of both classes, each of which stands for `times` labelled ones of its class."""
    one: dict[bytes, bytes] = {}  # each word is held once, however often it comes
    samples = [[[one.setdefault(w, w) for w in words(t)] for t in texts] for texts in (toxic, ordinary)]
    del one
    x = [np.array([letters(w) for w in ws]) for ws in samples]
    c = centres(np.concatenate(x))
    mine = [(part @ c.T).argmax(axis=1) for part in x]
    own = [i for i in range(len(c)) if (mine[0] == i).sum() >= LEAST_TOXIC and (mine[1] == i).sum() >= LEAST_TOXIC]
    pair_of = [own.index(i) if i in own else len(own) for i in range(len(c))]
    pairs, rows, labels, pair = [], [], [], []
    for p in range(len(own) + 1):
        here = [np.ones(len(m), bool) if p == len(own) else m == own[p] for m in mine]
        learner = Learner(*([w for w, h in zip(ws, hs) if h] for ws, hs in zip(samples, here)))
        fold = np.concatenate([np.arange(int(h.sum())) % FOLDS for h in here])
        # Texts calibrate the pair that scores them.
        scored = np.concatenate([np.array([pair_of[i] for i in m[h]], int) == p for m, h in zip(mine, here)])
        for f in range(FOLDS):
            at = np.flatnonzero((fold == f) & scored)
            if len(at):
                distance = Distance(*learner.dictionaries(fold != f))
                rows += [features(distance.of(learner.texts[i])) for i in at]
                labels += learner.y[at].tolist()
                pair += [p] * len(at)
        pairs.append(learner.dictionaries(np.ones(len(learner.texts), bool)))
        del learner  # before the next one is made
    rows, pair = np.array(rows), np.array(pair)
    own_rows = [rows * (pair == p)[:, None] for p in range(len(pairs))]
    ridge = np.r_[1e-6, np.full(FEATURES - 1, 0.3), np.full(FEATURES * len(pairs), 1.0)]
    y = np.array(labels, float)
    w = logistic(np.hstack([rows, *own_rows]), y, np.where(y > 0, *times), ridge).reshape(-1, FEATURES)
    return Model(c, pair_of, pairs, w[0] + w[1:])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held: int = 5, sample: int = SAMPLE) -> Model | None:
    """The model of labelled rows that aren't held out; None without both classes."""
    doc = F.col(id_col).cast("long").alias("doc")
    label = labels.select(doc, F.col(label_col).alias("y")).where("doc is not null and y in (0, 1)").groupBy("doc").agg(F.max("y").alias("y"))
    label = label.where(common.remainder("doc", held) != 0).join(docs.select(doc).distinct(), "doc", "left_semi")
    chosen = None
    for y in (0, 1):
        part = label.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(doc, F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc").select("y", "text", F.xxhash64("doc").alias("h"), "doc")
    got = {y: [r["text"] or "" for r in rows.where(F.col("y") == y).orderBy("h", "doc", "text").limit(sample).select("text").collect()] for y in (0, 1)}
    if not got[0] or not got[1]:
        return None
    # Both classes count as often as they are labelled, not as they are sampled.
    n = {r["y"]: r["n"] for r in label.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # The driver's heap is as large as these jobs made it; learning comes on top.
    common.cleaned(docs.sparkSession)
    return learned(got[1], got[0], tuple(max(1.0, n[y] / len(got[y])) for y in (1, 0)))


def score(text: Column | str, model: Model | None) -> Column:
    """The probability that a text is toxic, in (0, 1)."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.given_back()
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series(scorer.scores(texts))
        del scorer
        common.given_back()

    return scored(text)
