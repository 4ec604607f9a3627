"""First-fit decreasing in random groups: encoder, tree, placing and whole packings against plain versions."""

import random
import zlib

import numpy as np
import pytest

from quillmark.llm import queries, tournament

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_tokenizer(tokenizer):
    rnd = random.Random(1)
    parts = list("ab zA9 .,!?'  \t\n\r\x0b\x1c 　\x85\xa0éÉß×÷日本́-_\"<|>") + ["'s", "'ll", " the", ". ", ", ", "<|endoftext|>", "\n\n", "😀"]
    encoder = tournament.ByteEncoder()
    for _ in range(200):
        texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(40)] + ["", ""]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_first_fit_equals_a_plain_scan():
    rnd = random.Random(2)
    for _ in range(100):
        lengths = np.array([rnd.randint(1, 100) for _ in range(rnd.randint(1, 80))])
        free, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            free[b] -= lengths[i]
            want[i] = b
        assert tournament.first_fit_decreasing(lengths, 100).tolist() == [want[i] for i in range(len(lengths))]


def check(rows, texts, tokenizer, capacity=2048):
    """Every id of every document is in one piece, and no sequence is longer, gapped or padded."""
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    assert pieces.keys() == ids.keys()
    for d, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            part = np.array(ids[d][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[d]), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids[d])


def test_query_packs_every_id_without_padding(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(queries.op13_tournament_packing(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


def test_few_items_a_group_and_edge_cases(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (4, "a b"), (None, "no id, here")] + [(10 + i, "same text again") for i in range(40)]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in texts], "doc_id long, text string, uid int, length string")
    rows = tournament.packed(tournament.cut(docs, capacity=64), 64, group_items=5, with_ids=True)
    got = rows.collect()
    check(got, texts, tokenizer, 64)
    assert all(r["ids"] is None or len(r["ids"]) == 2 * r["length"] for r in got)
    twice = spark.createDataFrame([(7, "a b c d")] * 3, "doc_id long, text string")
    out = tournament.pack_documents(twice).collect()
    assert sum(r["length"] for r in out) == 3 * 5
    assert tournament.pack_documents(docs.limit(0)).count() == 0
