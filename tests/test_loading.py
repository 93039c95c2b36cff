"""All inputs of a configuration, and a refusal of each kind."""

import pytest

from weftmine.sources import files, loading

GOOD = {
    "presence.csv": "﻿prescription_id,a,b,c\n1,1,0,1\n2,0,1,1\n3,1,,1\n4,0,0,0\n",
    "symptoms.csv": "prescription_id,s,t\n1,1,0\n2,1,1\n3,0,1\n4,1,0\n",
    "dosage.csv": "prescription_id,a,b,c\n1,2.5,0,1\n2,0,3,1\n3,1,0,4\n4,0,0,0\n",
    "categories.csv": "herb_index,herb_name,x,y\n0,a,1,0\n1,b,0,1\n2,c,1,1\n",
    "features.csv": "herb_index,herb_name,p,q\n0,a,-1,0.5\n1,b,0,2\n2,c,1,1\n",
    "symptom_features.csv": "symptom_id,symptom_name,u\n0,s,1\n1,t,0.5\n",
    "pairs.csv": "i,j\n0,1\n2,0\n",
    "symptom_pairs.csv": "i,j\n0,1\n",
    "conflicts.csv": "i,j\n1,2\n",
    "knowledge.txt": "s\ta other\nt\tbee\nunknown\ta\n",
    "aliases.csv": "b,bee\nnone,other\n",
}
CONFIG = {"widths": {"categories": 2, "features": 2, "symptom_features": 1}, "pair_support": 2}


def folder(path, change=None):
    (path / "in").mkdir()
    for name, text in {**GOOD, **(change or {})}.items():
        if text is not None:
            (path / "in" / name).write_text(text, encoding="utf-8")
    return {**CONFIG, "data_root": str(path / "in")}, str(path / "out")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_every_view(spark, tmp_path):
    config, out = folder(tmp_path)
    views = loading.load_all(spark, {**config, "dosage": True}, out)
    assert rows(views["presence"]) == [(1, "a", 0, 1.0), (1, "c", 2, 1.0), (2, "b", 1, 1.0), (2, "c", 2, 1.0), (3, "a", 0, 1.0), (3, "c", 2, 1.0)]
    assert (1, "a", 0, 2.5) in rows(views["dosage"]) and views["symptoms"].count() == 5
    assert rows(views["herb_attributes"])[2] == (2, "c", [1.0, 1.0, 1.0, 1.0])
    assert [rows(views[k]) for k in ("pairs", "symptom_pairs", "conflicts")] == [[(0, 1), (2, 0)], [(0, 1)], [(1, 2)]]
    assert rows(views["knowledge"]) == [(0, 0), (1, 1)]
    assert rows(views["pair_index"]) == [(0, 2, 2, 0)] and rows(views["pair_view"]) == [(1, 0, 1.0), (3, 0, 1.0)]


def test_dosage_and_knowledge_are_only_needed_where_asked_for(spark, tmp_path):
    config, out = folder(tmp_path, {"dosage.csv": None, "knowledge.txt": None, "aliases.csv": None})
    views = loading.load_all(spark, config, out)
    assert "dosage" not in views and views["knowledge"].count() == 0
    with pytest.raises(FileNotFoundError, match="dosage"):
        loading.load_all(spark, {**config, "dosage": True}, out)


@pytest.mark.parametrize(
    ("change", "text"),
    [
        ({"presence.csv": GOOD["presence.csv"].replace("2,0,1,1", "2,0,5,1")}, "1 cells that are neither 0 nor 1"),
        ({"presence.csv": GOOD["presence.csv"].replace("2,0,1,1", "2,no,1,x")}, "2 cells that aren't numbers"),
        ({"presence.csv": GOOD["presence.csv"].replace("\n2,", "\ntwo,")}, "ids that aren't whole numbers"),
        ({"symptoms.csv": GOOD["symptoms.csv"].replace("\n4,", "\n5,")}, "2 entities are only in one of presence and symptoms"),
        ({"dosage.csv": GOOD["dosage.csv"].replace("2.5", "-2.5")}, "1 negative doses"),
        ({"dosage.csv": GOOD["dosage.csv"].replace("id,a,b", "id,b,a")}, "first differ at 0"),
        ({"categories.csv": GOOD["categories.csv"].replace("0,a,1,0", "0,a,2,0")}, "neither 0 nor 1"),
        ({"categories.csv": GOOD["categories.csv"].replace("1,b", "1,d")}, "presence and categories: 3 and 3 names, which first differ at 1"),
        ({"features.csv": GOOD["features.csv"].replace("0,a,-1,0.5", "0,a,-1,?")}, "1 cells that aren't numbers"),
        ({"features.csv": "herb_index,herb_name,p\n0,a,1\n1,b,1\n2,c,1\n"}, "1 columns, not 2"),
        ({"symptom_features.csv": GOOD["symptom_features.csv"].replace("1,t", "7,t")}, "indices up to 7"),
        ({"pairs.csv": "i,j\n0,3\n"}, "1 indices from 3 on"),
        ({"symptom_pairs.csv": "i,j\n0,-1\nx,1\n"}, "2 pairs that aren't whole numbers from 0"),
        ({"conflicts.csv": None}, "conflicts"),
    ],
)
def test_refusals(spark, tmp_path, change, text):
    config, out = folder(tmp_path, change)
    with pytest.raises((ValueError, FileNotFoundError), match=text) as e:
        loading.load_all(spark, {**config, "dosage": True}, out)
    if isinstance(e.value, loading.Refused):
        found = spark.read.parquet(e.value.rows)
        assert found.count() == sum(e.value.reasons.values()) and {r["__reason"] for r in found.collect()} == set(e.value.reasons)


def test_a_tree_of_runs(spark, tmp_path):
    import json

    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(value))

    put("t/00_full/seed_1/K_5/summary.json", {"K": 5, "test_metrics": {"map": 0.5, "ppl": 3.0}, "config": {"k": 5}})
    put("t/00_full/seed_1/K_10/summary.json", {"map": 0.25})
    put("t/01_less/seed_2/K_5/metrics.json", [{"total": 3.0}, {"total": 2.0, "map": 0.125}])
    put("t/01_less/seed_2/K_10/metrics.json", {"map": 0.75})
    put("t/01_less/seed_2/K_10/summary.json", {"test_metrics": {"map": 0.875}})
    got = sorted((r.stage, r.seed, r.k, r.metric, r.value) for r in files.run_tree(spark, f"{tmp_path}/t").collect())
    assert got == sorted([("00_full", 1, 5, "K", 5.0), ("00_full", 1, 5, "map", 0.5), ("00_full", 1, 5, "ppl", 3.0), ("00_full", 1, 10, "map", 0.25), ("01_less", 2, 5, "map", 0.125), ("01_less", 2, 5, "total", 2.0), ("01_less", 2, 10, "map", 0.875)])
    config = files.read_config(spark, f"{tmp_path}/t/00_full/seed_1/K_10/summary.json", {"map": 1.0, "k": 3})
    assert config == {"map": 0.25, "k": 3}
    (tmp_path / "c.yaml").write_text("seed: 3\ntraining:\n  rate: 1.0e-3\n  names: [a, b]\n  stop: false\n# note\nfiles:\n  presence: \"x.csv\"\n")
    assert files.read_config(spark, f"{tmp_path}/c.yaml", {"seed": 1, "training": {"every": 5}}) == {"seed": 3, "training": {"every": 5, "rate": 0.001, "names": ["a", "b"], "stop": False}, "files": {"presence": "x.csv"}}
