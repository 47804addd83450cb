"""File readers on small folders."""

import json
import zlib

import pytest

from spanframe.sources import annotations, dumps, tables


def test_binary_samples(spark, tmp_path):
    (tmp_path / "a.zlib").write_bytes(zlib.compress(b"hello"))
    (tmp_path / "b.zlib").write_bytes(b"not compressed")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    rows = {r.sample_id: r for r in dumps.read_binary_samples(spark, str(tmp_path), ids).collect()}
    assert bytes(rows["a"].content) == b"hello" and rows["a"].chunk == 0
    assert rows["b"].exclusion_reason.startswith("decompress_error:")
    assert rows["c"].exclusion_reason == "missing:c"


def test_hex_dump_and_listing_files(spark, tmp_path):
    (tmp_path / "s1.bytes").write_text("00401000 4d ?? 5A\nnoise\n00401010 01 02\n00401000 FF\n00400000 11\n")
    lines = dumps.read_hex_dumps(spark, str(tmp_path))
    valid, facts, bad = dumps.assemble_dump(lines)
    assert {(r.off, r.byte) for r in valid.collect()} == {(0, 255), (2, 90), (16, 1), (17, 2)}
    assert facts.first().size == 18 and bad.count() == 0


def test_scores_and_rois_files(spark, tmp_path):
    (tmp_path / "scores.json").write_text(json.dumps({"d1": {"att": [0.1, 0.9]}}))
    s = tables.read_scores(spark, str(tmp_path / "scores.json"))
    assert [(r.tile, r.score) for r in s.orderBy("tile").collect()] == [(0, 0.1), (1, 0.9)]
    (tmp_path / "roi.json").write_text(json.dumps([{"bbox": [1, 2, 3, 4], "category_name": "a", "score": 2}, {"bbox_xywh": [1, 2, 3, 4], "class_id": 4, "confidence": 0.5}]))
    r = annotations.read_roi_annotations(spark, [str(tmp_path / "roi.json")]).orderBy("pos").collect()
    assert (r[0].label, r[0].violation) == ("a", "score out of range") and (r[1].label, r[1].score, r[1].violation) == ("id:4", 0.5, None)
    (tmp_path / "truth.json").write_text(json.dumps({"annotations": [{"bbox": [0, 0, 1, 1], "category_id": 1}], "categories": [{"id": 1, "name": "n"}], "images": [{"id": None, "file_name": "a"}, {"id": 2, "file_name": "b"}]}))
    assert annotations.read_roi_annotations(spark, [str(tmp_path / "truth.json")], truth=True).first().violation == "no unique image"
    (tmp_path / "m.csv").write_text("role,split\nprimary,train\n")
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "m.csv"))


def test_detection_dataset_written(spark, tmp_path):
    im = spark.createDataFrame([(5, "train", 1, 10, 10), (6, "val", 2, 10, 10)], "sample_id bigint, split string, pos bigint, width int, height int")
    an = spark.createDataFrame([(5, 0, 1, 1, 1, 2, 2)], "sample_id bigint, ann_pos bigint, class_id int, x int, y int, w int, h int")
    annotations.write_detection_dataset(im, an, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "annotations")).first().area == 4
    assert spark.read.json(str(tmp_path / "out" / "labels")).first().value == "0 0.20000000 0.20000000 0.20000000 0.20000000"


def test_detection_documents_parse(spark, tmp_path):
    import json

    im = spark.createDataFrame([(k, "val" if k % 3 == 0 else "train", k, 64, 32, f"f{k}") for k in range(1, 41)] + [(99, "empty", 1, 8, 8, None)],
                               "sample_id long, split string, pos long, width int, height int, family string").repartition(5)
    an = spark.createDataFrame([(k, j, 1 + j % 2, float(j), 1.0, 4.0, 2.0, "tool \"x\"") for k in range(1, 41) if k % 4 for j in range(k % 5)],
                               "sample_id long, ann_pos int, class_id int, x double, y double, w double, h double, source string").repartition(5)
    out = str(tmp_path / "set")
    annotations.write_detection_dataset(im, an, out, ["one", "two"])
    n = 0
    for split, size in (("train", 27), ("val", 13), ("empty", 1)):
        parts = sorted((tmp_path / "set" / "documents" / f"split={split}").glob("part-*"))
        doc = json.loads("".join(p.read_text() for p in parts))
        assert [i["id"] for i in doc["images"]] == list(range(1, size + 1))
        assert [a["id"] for a in doc["annotations"]] == list(range(1, len(doc["annotations"]) + 1))
        assert [c["name"] for c in doc["categories"]] == ["one", "two"]
        assert all(a["bbox"][2] * a["bbox"][3] == a["area"] and a["iscrowd"] == 0 for a in doc["annotations"])
        assert [int(i["file_name"]) for i in doc["images"]] == ([99] if split == "empty" else [k for k in range(1, 41) if (k % 3 == 0) == (split == "val")])
        n += len(doc["annotations"])
    assert n == an.count()
    provenance = spark.read.json(f"{out}/provenance")
    assert provenance.count() == n and provenance.filter("source = 'tool \"x\"'").count() == n
    prepared = spark.read.json(f"{out}/prepared")
    assert prepared.count() == 41 and prepared.agg({"n_annotations": "sum"}).first()[0] == n


def test_detection_ids_come_back_without_a_shuffle(spark):
    """Ranked annotations lie in the order of their ids; only the cells of few groups are sent round."""
    im = spark.createDataFrame([(k, "val" if k % 3 == 0 else "train", k, 64, 32) for k in range(1, 60)], "sample_id long, split string, pos long, width int, height int").repartition(5)
    an = spark.createDataFrame([(k, j, 1, 1.0, 1.0, 4.0, 2.0) for k in range(1, 60) for j in range(k % 5)], "sample_id long, ann_pos int, class_id int, x double, y double, w double, h double").repartition(5)
    rows = annotations.detection_tables(im, an)[1]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    ids = [(r.split, r.annotation_id) for r in rows.select("split", "annotation_id").collect()]
    assert ids == sorted(ids) and len(ids) == an.count()
