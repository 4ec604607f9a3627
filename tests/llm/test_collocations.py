"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pytest

from quillmark.llm import collocations


def brute(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: c for key, c in f.items() if c >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        if any(la == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), b in found.items()):
            continue
        s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
    ranked = collections.defaultdict(list)
    for row in sorted(out, key=lambda x: (-x[6], -x[2], x[1].encode())):
        ranked[row[0]].append(row)
    return {(row[0], i + 1, *row[1:]) for rows in ranked.values() for i, row in enumerate(rows[:top])}


def got(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def test_mined_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["the", "of", "New", "york", "city", "ünd", "É", "a-b", "日本", "x"] + [f"w{i}" for i in range(30)]
    weights = [20, 15, 9, 9, 5, 4, 4, 3, 3, 3] + [1] * 30
    rows = []
    for _ in range(300):
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " ;", "!"]) for w in rnd.choices(words, weights, k=rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "de", None]), text))
    rows += [("en", "The same line again, word for word in all."), ("en", None), ("en", ""), ("en", " . ,\t")] * 40
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, f int")
    want = brute(rows, 12, 30)
    assert len(want) > 40
    assert got(collocations.mined(df, least=12, top=30)) == want


def test_a_full_filter_and_shared_hashes_change_nothing(spark, monkeypatch):
    rows = [("en", "a b c d e f g a b c d")] * 9 + [("en", "b a d c")] * 4
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 4, 50)
    monkeypatch.setattr(collocations.PairFilter, "holds", lambda self, keys: np.ones(len(keys), bool))
    assert got(collocations.mined(df, least=4, top=50)) == want
    first = collocations.Words.keys
    monkeypatch.setattr(collocations.Words, "keys", lambda self, at, n, second=False: first(self, at, n, second) if second else np.zeros(len(at), np.uint64))
    import pyarrow as pa

    words = collocations.Words(pa.table({"lang": ["en", "de"], "piece": ["a b a b", "a b"], "weight": [2, 5]}))
    counted = words.counted(words.starts_of(2), 2).to_pylist()
    assert {(r["lang"], r["phrase"], r["f"]) for r in counted} == {("en", "a b", 4), ("en", "b a", 2), ("de", "a b", 5)}


def test_empty_and_long_texts(spark):
    df = spark.createDataFrame([("en", "again and " * 30_000), (None, "again and " * 3)], "lang string, text string")
    assert got(collocations.mined(df, least=1000)) == brute([("en", "again and " * 30_000)], 1000, 2000)
    assert collocations.mined(df.limit(0)).count() == 0


@pytest.mark.parametrize("count", [0, 1, 5000])
def test_filter_has_no_false_negatives(count):
    keys = collocations._STEPS[0] * np.arange(1, count + 1, dtype=np.uint64)
    made = collocations.PairFilter(1 << 17)
    for at in made.places(keys):
        np.bitwise_or.at(made.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    assert made.holds(keys).all()
