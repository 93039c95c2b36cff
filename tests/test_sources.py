import json

import pytest

from weftmine.plans import experiments
from weftmine.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_wide_tables(spark, tmp_path):
    path = write(tmp_path / "a.csv", "prescription_id,x,y z\n7,1,0\n9,1,1\n")
    assert sorted(map(tuple, files.presence(spark, path).collect())) == [(7, "x", 0, 1.0), (9, "x", 0, 1.0), (9, "y z", 1, 1.0)]
    with pytest.raises(ValueError):
        files.presence(spark, write(tmp_path / "b.csv", "prescription_id,x\n1,2\n"))
    with pytest.raises(ValueError):
        files.dosage(spark, write(tmp_path / "c.csv", "prescription_id,x\n1,-2\n"))
    assert files.dosage(spark, write(tmp_path / "d.csv", "prescription_id,x\n1,2.5\n")).first().dose == 2.5
    assert files.presence(spark, write(tmp_path / "e.csv", "x,y\n1,0\n")).count() == 1


def test_attributes_and_pairs(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,name,p,q\n0,n,1,2\n")
    assert files.attributes(spark, path, ("q", "p")).first().attr == [2.0, 1.0]
    for wrong in ({"columns": ("z",)}, {"width": 3}):
        with pytest.raises(ValueError):
            files.attributes(spark, path, **wrong)
    path = write(tmp_path / "p.csv", "0,1\n2,3\n4,5\n")
    assert (files.pairs(spark, path).count(), files.pairs(spark, path, has_header=False).count()) == (2, 3)
    with pytest.raises(ValueError):
        files.pairs(spark, write(tmp_path / "n.csv", "a,b\n-1,2\n"))


def test_knowledge_in_either_order(spark):
    rows = lambda *p: spark.createDataFrame(list(p), "i int, j int")
    assert files.knowledge_pairs(rows((1, 50)), 100, 10).first() == (50, 1)
    assert files.knowledge_pairs(rows((50, 1)), 100, 10).first() == (50, 1)
    assert files.knowledge_pairs(rows((3, 4)), 100, 10).first() == (4, 3)
    with pytest.raises(ValueError):
        files.knowledge_pairs(rows((50, 60)), 100, 10)


def test_names_by_alias(spark, tmp_path):
    alias = files.aliases(files.numbered_lines(spark, write(tmp_path / "a.csv", "root,r1, r2\n\nleaf,l1,r2\n,\n")))
    assert sorted(map(tuple, alias.collect())) == [("l1", "leaf"), ("leaf", "leaf"), ("r1", "root"), ("r2", "leaf"), ("root", "root")]
    tokens = files.knowledge_tokens(files.numbered_lines(spark, write(tmp_path / "k.txt", "cough\troot r2 what\nfever\t\n\nunknown\troot\nchill\tr1  leaf what\n")))
    names = spark.createDataFrame([(0, "root"), (1, "leaf")], "item int, name string")
    symptoms = spark.createDataFrame([("cough",), ("chill",), ("fever",)], "symptom string")
    assert sorted(map(tuple, files.knowledge(tokens, names, alias, symptoms).collect())) == [("chill", 0), ("chill", 1), ("cough", 0), ("cough", 1)]
    assert files.unmatched(tokens, names, alias).collect() == [("what", 2)]


def test_alignment(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "item int, name string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "item int, name string")
    assert sorted(r.item for r in files.misplaced_names(a, b).collect()) == [1, 2]
    ids = lambda *p: spark.createDataFrame([(i,) for i in p], "pid long")
    assert files.same_entities(ids(1, 2), ids(2, 1)) == 0 and files.same_entities(ids(1), ids(2)) == 2


def test_results_and_settings(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "r.csv", "﻿K,variant,seed,MAP\n10,a,1,0.5\n10,b,1,\n")
    rows = files.results(spark, path).collect()
    assert [(r.K, r.variant, r.MAP) for r in rows] == [(10.0, "a", 0.5), (10.0, "b", None)]
    files.write_json(spark, {"b": 1, "a": [2]}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": [2], "b": 1}
    write(tmp_path / "s.json", '{"test_metrics": {"map": 0.25}, "seed": 3}')
    assert files.summaries(spark, str(tmp_path / "s.json")).first().map == 0.25
    assert files.optional(spark, str(tmp_path / "no.csv"), "i int, j int", files.pairs).count() == 0
    monkeypatch.setenv("WEFTMINE_DATA_ROOT", "/there")
    assert files.root() == "/there" and files.root({"data_root": "here"}) == "here"
    for kind in ("csv", "json"):
        files.write_results(spark.range(2), str(tmp_path / kind), kind)
    files.write_factors(spark.range(3), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3


def test_experiment_families(tmp_path):
    base = {"weight": {"ph": 1.0, "ps": 1.0, "pair": 1.0}, "graph": {"ph": 0.1, "ps": 0.1}, "l1": {"g": 0.1}, "knowledge": 1.0}
    runs = list(experiments.ablation(base, (1, 2), (5, 10)))
    assert len(runs) == 24 and runs[-1]["graph"] == {"ph": 0.0, "ps": 0.0} and runs[4]["knowledge"] == 0.0 and runs[0]["knowledge"] == 1.0
    runs = list(experiments.sweep(base, "l1.g", (0.1, 1.0), (1,), along={"l1.pd": 0.1}))
    assert [r["l1"]["pd"] for r in runs] == [pytest.approx(0.01), pytest.approx(0.1)]
    assert len(list(experiments.weighting_variants(base, range(5)))) == 15
    for wrong in ({"weight": {"ph": -1}}, {"weight": {"ph": 0}}):
        with pytest.raises(ValueError):
            experiments.checked(wrong)
    assert experiments.checked(base) is base
    folder = tmp_path / "run"
    folder.mkdir()
    for f in ("metrics.json", "summary.json"):
        write(folder / f, "{}")
    assert not experiments.done(str(folder))
    write(folder / "config.json", json.dumps(base))
    assert experiments.done(str(folder)) and experiments.done(str(folder), base) and not experiments.done(str(folder), {})
    assert experiments.left([base, {}], lambda c: str(folder)) == [{}]


def test_cells_that_are_not_numbers(spark, tmp_path):
    with pytest.raises(ValueError, match="not numbers"):
        files.presence(spark, write(tmp_path / "t.csv", 'prescription_id,"x, y",z\n1,1,yes\n'))
    path = write(tmp_path / "q.csv", '﻿prescription_id,"x, y",z\n1,1,\n2, ,1\n')
    assert sorted(map(tuple, files.presence(spark, path).collect())) == [(1, "x, y", 0, 1.0), (2, "z", 1, 1.0)]
    rows = "".join(f"{i % 2},1\n" for i in range(50))
    assert sorted(r.pid for r in files.wide(spark, write(tmp_path / "n.csv", f"x,y\n{rows}")).filter("item = 1").collect()) == list(range(50))


def views(tmp_path, **changed):
    texts = {
        "presence.csv": "prescription_id,rice,salt,oil\n1,1,0,1\n2,0,1,1\n",
        "dosage.csv": "prescription_id,rice,salt,oil\n1,2.5,0,1\n2,0,3,4\n",
        "symptoms.csv": "prescription_id,cold,hot\n1,1,0\n2,1,1\n",
        "knowledge.txt": "cold\trice grain\toil\nhot\tsalt unknown\nwarm\trice\n",
        "aliases.csv": "rice,grain\nstone,grain\n",
        **changed,
    }
    for name, text in texts.items():
        write(tmp_path / name, text)
    return {"data_root": str(tmp_path)}


def test_all_views(spark, tmp_path):
    got = files.load_views(spark, views(tmp_path))
    assert set(got) == {"presence", "dosage", "symptoms", "knowledge"}
    assert sorted((r.symptom, r.item) for r in got["knowledge"].collect()) == [(0, 0), (0, 2), (1, 1)]
    assert got["dosage"].filter("item = 2").count() == 2
    with pytest.raises(ValueError, match="entities"):
        files.load_views(spark, views(tmp_path, **{"symptoms.csv": "prescription_id,cold\n1,1\n"}))
    with pytest.raises(ValueError, match="items differ"):
        files.load_views(spark, views(tmp_path, **{"dosage.csv": "prescription_id,salt,rice,oil\n1,2,0,1\n2,0,1,3\n"}))
    with pytest.raises(FileNotFoundError, match="other.csv"):
        files.load_views(spark, {**views(tmp_path), "files": {"presence": "other.csv"}})


def test_knowledge_counts(spark):
    lines = spark.createDataFrame([(0, "cold\trice"), (1, "warm\trice oil"), (2, "warm\tsalt"), (3, "none")], "no int, value string")
    tokens = files.knowledge_tokens(lines)
    symptoms = spark.createDataFrame([("cold",)], "symptom string")
    assert list(map(tuple, files.unmatched_symptoms(tokens, symptoms).collect())) == [("warm", 2)]
    alias = spark.createDataFrame([], "alias string, canonical string")
    names = spark.createDataFrame([(0, "rice"), (1, "oil")], "item int, name string")
    assert tuple(files.covered(files.knowledge(tokens, names, alias, symptoms)).first()) == (1, 1)


def test_factors_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.5), ("b", 1, 0.0)], "item string, k int, v double")
    files.write_factors(rows, str(tmp_path / "f"))
    assert sorted(map(tuple, files.read_factors(spark, str(tmp_path / "f")).collect())) == sorted(map(tuple, rows.collect()))
