import pytest

from weftmine.operators import constraints, hypergraph, mining
from weftmine.plans.evaluate import compare_inference, evaluate_all


def test_all_metrics_of_one_split(spark):
    herbs = spark.createDataFrame([(p, (p + i) % 6, 1.0) for p in range(12) for i in range(3)], "pid long, item int, val double")
    symptoms = spark.createDataFrame([(p, (p + i) % 4, 1.0) for p in range(12) for i in range(2)], "pid long, item int, val double")
    h = spark.createDataFrame([(i, k, float(1 + (i * 3 + k) % 5)) for i in range(6) for k in range(2)], "item int, k int, v double")
    s = spark.createDataFrame([(i, k, float(1 + (i + 2 * k) % 3)) for i in range(4) for k in range(2)], "item int, k int, v double")
    bad = constraints.conflicts(spark.createDataFrame([(0, 3)], "i int, j int"))
    edges = hypergraph.by_entity(herbs, least=2, most=5)
    motifs = mining.motifs(herbs, 12, 2)
    out = evaluate_all(herbs, symptoms, h, s, n=12, conflict=bad, edges=edges, motifs=motifs, length_ratio=1.5, frequency=spark.createDataFrame([(i, 0.5) for i in range(6)], "item int, f double"), ks=(2, 3), top=3, doses=herbs.withColumnRenamed("val", "dose"), d=h, held=(0.2, 0.5), seeds=(1, 2), em={"h": h, "s": s})
    assert {"sym2herb_map", "herb2sym_p_3", "sym2herb_ppl", "herb2sym_smoothed_ppl", "sym2herb_calibrated_recall", "herb_nre", "symptom_coherence_mean", "tgc", "motif_hit", "violation", "compatible", "dose_mae", "dose_rmse", "dose_smape", "herb_held_0.2_ppl", "symptom_held_0.5_ppl", "herb2sym_em_ppl", "sym2herb_em_ppl"} <= set(out)
    assert all(1 <= out[k] <= 12 for k in out if k.endswith(("held_0.2_ppl", "held_0.5_ppl", "em_ppl")))
    assert all(0 <= v <= 1 for k, v in out.items() if "map" in k or "_p_" in k or k in ("tgc", "motif_hit", "violation", "compatible"))
    assert out["sym2herb_ppl"] == pytest.approx(6, rel=0.5)
    both = compare_inference(herbs, symptoms, h, s, ("dot", "ols"))
    assert set(both) == {"dot", "ols"} and both["ols"]["herb_nre"] <= both["dot"]["herb_nre"]
