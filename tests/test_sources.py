"""Files as users write them: no row ids, indented records, own class names; worker functions; shared folder."""
import json

import numpy as np
import pytest

from textlab.api import load_data
from textlab.operators import corpus as C
from textlab.operators import metrics as M
from textlab.operators.scoring import score_batches
from textlab.sources import readers as SR


def write(path, rows):
    path.write_text("text,label\n" + "".join(f"{t},{y}\n" for t, y in rows))
    return str(path)


def test_plain_files_are_deduplicated_within_their_split(spark, tmp_path):
    train = write(tmp_path / "train.csv", [("a", 0), ("b", 1), ("a", 0), ("c", 1)])
    val = write(tmp_path / "val.csv", [("a", 0), ("x", 1), ("y", 0), ("x", 1)])
    test = write(tmp_path / "test.csv", [("t", 1), ("t", 1)])
    corpus, weights = load_data(spark, train, val, test)
    rows = corpus.collect()
    assert sorted((r.split, r.text) for r in rows) == [("test", "t"), ("test", "t"), ("train", "a"), ("train", "b"), ("train", "c"),
                                                       ("validation", "a"), ("validation", "x"), ("validation", "y")]
    assert len({r.row_id for r in rows}) == len(rows)
    assert {r["label"]: r["weight"] for r in weights.collect()} == {0: 1.5, 1: 0.75}


def test_ids_that_repeat_across_splits(spark):
    df = spark.createDataFrame([("train", 0, "a"), ("train", 1, "b"), ("train", 2, "a"), ("validation", 2, "z"), ("test", 0, "a")],
                               "split string, row_id long, text string")
    assert sorted(tuple(r) for r in C.dedup_keep_first(df).collect()) == [
        ("test", 0, "a"), ("train", 0, "a"), ("train", 1, "b"), ("validation", 2, "z")]


def test_json_array_and_malformed_input(spark, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps([{"row_id": 1, "text": "a", "label": 0}, {"row_id": 2, "text": "b", "label": 1}], indent=2))
    got = SR.read_json_corpus(spark, str(path), 2, multi_line=True).collect()
    assert [(r.split, r.row_id, r.text, r.label) for r in got] == [("validation", 1, "a", 0), ("validation", 2, "b", 1)]
    with pytest.raises(Exception, match="(?i)malformed"):
        SR.read_json_corpus(spark, str(path)).collect()


def test_indented_records_with_their_own_class_names(spark, tmp_path):
    for run, f1 in (("m1", 0.5), ("m2", 0.7)):
        folder = tmp_path / "en" / run
        folder.mkdir(parents=True)
        (folder / "x_results.json").write_text(json.dumps(
            {"macro_f1": f1, "accuracy": 0.9, "f1_per_class": {"hate": f1, "normal": 0.8}, "precision_per_class": {"hate": 0.1, "normal": 0.2},
             "recall_per_class": {"hate": 0.3, "normal": 0.4}, "confusion_matrix": [[1, 2], [3, 4]]}, indent=2))
    got = SR.scan_result_records(spark, str(tmp_path / "*" / "*" / "*_results.json"))
    rows = got.collect()
    assert [(r.experiment, r.group, r.f1_hate, r.recall_normal) for r in rows] == [("m2", "en", 0.7, 0.4), ("m1", "en", 0.5, 0.4)]


def test_every_closure_runs_its_own_model(spark):
    df = spark.createDataFrame([(i, "x") for i in range(8)], "row_id long, text string")
    for k in range(12):
        scored = score_batches(df, lambda k=k: lambda texts: np.array([[float(k), 0.0]] * len(texts)), materialize=False)
        assert {tuple(r.logits) for r in scored.collect()} == {(float(k), 0.0)}


def test_a_label_without_a_weight_fails(spark):
    rows = spark.createDataFrame([("r", 0, [0.1, 0.2]), ("r", 1, [0.3, 0.1])], "run string, label int, logits array<double>")
    weights = spark.createDataFrame([(0, 1.0)], "label int, weight double")
    with pytest.raises(Exception, match="no class weight for label 1"):
        M.weighted_cross_entropy(rows, ["run"], weights).collect()


def test_rows_without_a_label_go_to_train(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(12)], "row_id long, label int")
    got = {r.row_id: r.split for r in C.stratified_split(df).collect()}
    assert len(got) == 12 and got[3] == "train" and sum(s == "test" for s in got.values()) == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    from textlab.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    """A large later file is packed first by the scan; keep-first must still keep the first file's line."""
    train = tmp_path / "train.csv"
    train.mkdir()
    write(train / "a.csv", [("small first", 0)])
    write(train / "b.csv", [("small first", 1)] + [(f"t{i}", i % 2) for i in range(50_000)])
    write(train / "c.csv", [("last", 1)])
    val, test = write(tmp_path / "val.csv", [("v", 0)]), write(tmp_path / "test.csv", [("w", 1)])
    for multi_line in (True, False):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")  # the large file in several splits where lines allow it
        try:
            rows = sorted(SR.read_corpus_csv(spark, str(train), val, test, multi_line=multi_line).collect(), key=lambda r: r.row_id)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.row_id for r in rows] == list(range(50_005))
        assert [r.text for r in rows] == ["small first", "small first", *[f"t{i}" for i in range(50_000)], "last", "v", "w"]
    kept = C.dedup_keep_first(SR.read_corpus_csv(spark, str(train), val, test)).where("text = 'small first'").collect()
    assert [(r.row_id, r.label) for r in kept] == [(0, 0)]


def test_broken_records_are_reported_and_skipped(spark, tmp_path):
    good = {"macro_f1": 0.5, "accuracy": 0.9, "f1_per_class": {"hate": 0.5}}
    texts = {"good": json.dumps(good, indent=1), "cut": json.dumps(good)[:20], "empty": " ", "list": "[1, 2]", "other": json.dumps({"note": "x"}),
             "kind": json.dumps({"macro_f1": {"a": 1}})}
    for run, text in texts.items():
        (tmp_path / "en" / run).mkdir(parents=True)
        (tmp_path / "en" / run / "a_results.json").write_text(text)
    (tmp_path / "en" / "good" / "b_results.json").write_text("later files play no part {")
    pattern = str(tmp_path / "*" / "*" / "*_results.json")
    assert {r.experiment: (r.macro_f1, r.f1_hate) for r in SR.scan_result_records(spark, pattern).collect()} == {"good": (0.5, 0.5), "other": (None, None)}
    bad = {r.experiment: (r.group, r.error) for r in SR.broken_result_records(spark, pattern).collect()}
    assert bad == {"cut": ("en", "malformed record"), "empty": ("en", "empty file"), "list": ("en", "no record"), "kind": ("en", "malformed record")}
