"""One JSON document read by many tasks equals the document parsed whole."""

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.sources import files, json_scan

NASTY = ['plain', 'a "quoted" }{][ text', "back\\slash\\\\", '\\"', "tab\tline\nend", "日本 é", "}", "{", '"}', "\\", "},{", "", '": {', "😀"]


def value(rnd, deep=0):
    kind = rnd.random()
    if kind < 0.5 or deep > 2:
        return rnd.choice(NASTY) + rnd.choice(NASTY)
    if kind < 0.6:
        return rnd.choice([None, True, 1.5, -3])
    if kind < 0.8:
        return [value(rnd, deep + 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(NASTY) + str(i): value(rnd, deep + 1) for i in range(rnd.randint(0, 3))}


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    out = [(r["pos"], json.loads(r["raw"])) for r in df.orderBy("pos").collect()]
    assert [p for p, _ in out] == list(range(len(out)))
    return [x for _, x in out]


@pytest.mark.parametrize("seed", range(6))
def test_arrays_and_keys_equal_the_whole_document(small_blocks, tmp_path, seed):
    rnd = random.Random(seed)
    items = [{"i": i, "v": value(rnd), "long": "x}" * rnd.choice([0, 1, 150])} for i in range(rnd.choice([1, 2, 60]))]
    layout = {"indent": rnd.choice([None, 1]), "ensure_ascii": rnd.random() < 0.5}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(items, **layout) + rnd.choice(["", "\n", " \n\t"]), encoding="utf-8")
    found, rest = json_scan.scan(small_blocks, str(path))
    assert rest == [] and rows(found) == items and found.rdd.getNumPartitions() >= 1
    doc = {"a": value(rnd), "m": {"deep": {"er": "}" * 120, "x": [{"not": "one"}]}, "s": ["x", "y"]}, "none": [], "wanted": items, "other": [{"z": 1}, {"z": 2}], "n": 3}
    names = list(doc)
    rnd.shuffle(names)
    doc = {k: doc[k] for k in names}
    path.write_text(json.dumps(doc, **layout), encoding="utf-8")
    found, rest = json_scan.scan(small_blocks, str(path), "wanted")
    assert rows(found) == items
    assert rest == {k: [x for x in v if not isinstance(x, dict)] if isinstance(v, list) else v for k, v in doc.items()}


def test_what_is_no_array_of_objects_is_an_error(small_blocks, tmp_path):
    path = tmp_path / "bad.json"
    for text, key, kind in (("[{]", None, "invalid"), ('[{"a": "}]', None, "invalid"), ('{"a": 1}', None, "type"), ("[]", "k", "type"), ('{"k": {"a": {}}}', "k", "type"), ("[1]", None, "items"), ('[{}, "x", {}]', None, "items"), ('{"k": [null]}', "k", "items"), ("", None, "invalid"), ('[{"a": 1}] x', None, "invalid")):
        path.write_text(text)
        with pytest.raises(json_scan.ScanError) as e:
            json_scan.scan(small_blocks, str(path), key)
        assert e.value.kind == kind, text
    path.write_text("[]")
    assert json_scan.scan(small_blocks, str(path))[0].count() == 0


def test_index_file_in_many_tasks(spark, tmp_path):
    rng = np.random.RandomState(1)
    vectors = rng.standard_normal((3000, 64)).astype("<f4")
    entries = [{"repo_id": f"o/{i}", "embedding_input_fingerprint": str(i), "metadata": {"name": f"n {i}", "topics": ["{", "}"]}, "vector": base64.b64encode(v.tobytes()).decode()} for i, v in enumerate(vectors)]
    path = tmp_path / "index.json"
    path.write_text(json.dumps({"index_version": 3, "skipped": ["a/b"], "dimension": 64, "vectors": entries, "record_count": 3000}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got, meta = files.index(spark, str(path))
        assert got.rdd.getNumPartitions() >= path.stat().st_size // 100000
        found = {r["pos"]: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 3000 and all(found[i]["repo_id"] == f"o/{i}" and np.array_equal(found[i]["vector"], vectors[i]) and found[i]["metadata"]["topics"] == ["{", "}"] for i in range(3000))
    row = meta.first()
    assert (row["index_version"], row["skipped"], row["dimension"], row["record_count"], row["built_at"]) == (3, ["a/b"], 64, 3000, None)


def test_readers_name_the_role(spark, tmp_path):
    path = tmp_path / "r.json"
    for text, why in (("{", "no valid JSON"), ("{}", "must be a JSON array"), ("[1]", "must hold objects only")):
        path.write_text(text)
        with pytest.raises(files.SourceError, match="the records file.*" + why):
            files.records(spark, str(path))
    path.write_text('[{"repo_id": "a/b", "name": 5}, {"repo_id": ]')
    with pytest.raises(Exception, match="no valid JSON"):
        files.records(spark, str(path)).collect()
    path.write_text(json.dumps([{"repo_id": "a/b", "github": {"stars": 3}}, {"repo_id": "c/d", "extra": {"x": [{}]}}]))
    assert [(r["pos"], r["repo_id"], r["github"] and r["github"]["stars"]) for r in files.records(spark, str(path)).orderBy("pos").collect()] == [(0, "a/b", 3), (1, "c/d", None)]
    assert files.records(spark, str(path)).where(F.col("name").isNotNull()).count() == 0
