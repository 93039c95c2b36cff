"""All metrics of a fitted model on one split, each mixture inferred once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.operators import constraints, heldout, infer, linalg, metrics, weighting
from weftmine.session import cut


def evaluate_all(herbs: DataFrame, symptoms: DataFrame, h: DataFrame, s: DataFrame, *, n: int, conflict: DataFrame | None = None, edges: DataFrame | None = None, motifs: DataFrame | None = None, frequency: DataFrame | None = None, length_ratio: float | None = None, method: str = "nnls", alpha: float = 0.1, ks: tuple[int, ...] = (5, 10), top: int = 10, doses: DataFrame | None = None, d: DataFrame | None = None, held: tuple[float, ...] = (), seeds: tuple[int, ...] = (42,), em: dict[str, DataFrame] | None = None) -> dict[str, float]:
    """Ranking in both directions, perplexities, coherence, and, where given what they need, compactness, motif and safety rates,
    errors of doses, perplexities of held-out items, and those by other loadings.

    herbs, symptoms: pid, item, val of the split's entities; h, s: item, k, v. n: entities in the split. doses: pid, item, dose, with loadings d of doses; held: parts of each entity's items that are held out, each
    by all of ``seeds``; em: loadings of both views (h, s) whose shares predict items by mixtures from h and s, such as those that em_fit gives.
    """
    out: dict[str, float] = {}

    def put(prefix: str, row: DataFrame) -> None:
        out.update({f"{prefix}{k}": float(v) for k, v in row.first().asDict().items() if v is not None})

    both = {"sym2herb": (symptoms, herbs, s, h), "herb2sym": (herbs, symptoms, h, s)}
    for name, (source, truth, by, to) in both.items():
        z = cut(infer.infer(source, by, method))
        found = cut(infer.scores(z, to))
        put(f"{name}_", metrics.recommendation(found, truth, ks))
        put(f"{name}_binary_", metrics.predictive(found, truth, source, max(ks)))
        if length_ratio is not None:
            put(f"{name}_calibrated_", metrics.predictive(found, truth, source, max(ks), length_ratio=length_ratio, frequency=frequency if name == "sym2herb" else None))
        n_items = to.select("item").distinct().count()
        put(f"{name}_", metrics.perplexity(found, truth, n_items))
        smooth = cut(infer.scores(infer.smoothed(z, by, alpha), to))
        put(f"{name}_smoothed_", metrics.perplexity(smooth, truth, n_items))
        if conflict is not None and name == "sym2herb":
            out["violation"] = float(metrics.violations_at_k(found, conflict, top).agg(F.coalesce(F.avg("rate"), F.lit(0.0))).first()[0])
            best = infer.ranked(found, top).select(F.col("pid").alias("set_id"), "item")
            out["compatible"] = float(constraints.compatible_rate(truth.select(F.col("pid").alias("set_id"), "item"), best, conflict).first()[0])
    for name, x, by in (("herb", herbs, h), ("symptom", symptoms, s)):
        z = cut(infer.infer(x, by, method))
        put(f"{name}_", linalg.nre(x, z, by))
        put(f"{name}_coherence_", metrics.coherence(by, x, n, top).agg(F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("mean")))
    for part in held:
        for name, x, by in (("herb", herbs, h), ("symptom", symptoms, s)):
            found = heldout.heldout_perplexity(x, by, by.select("item").distinct().count(), ratio=part, seeds=seeds, method=method)
            put(f"{name}_held_{part:g}_", found.agg(F.avg("ppl").alias("ppl")))
    if em:
        for name, source, truth, by, to in (("herb2sym", herbs, symptoms, h, em["s"]), ("sym2herb", symptoms, herbs, s, em["h"])):
            put(f"{name}_em_", heldout.predictive_perplexity(source, truth, by, to, to.select("item").distinct().count(), method=method, alpha=alpha))
    if doses is not None and d is not None:
        put("dose_", metrics.dose_errors(doses, infer.scores(infer.infer(symptoms, s, method), d)))
    if edges is not None:
        put("", metrics.compactness(h, edges, top).agg(F.coalesce(F.avg("tgc"), F.lit(0.0)).alias("tgc")))
    if motifs is not None:
        put("", metrics.motif_hits(h, motifs, top).agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias("motif_hit")))
    return out


def compare_inference(herbs: DataFrame, symptoms: DataFrame, h: DataFrame, s: DataFrame, methods: tuple[str, ...] = ("nnls", "dot", "ols")) -> dict[str, dict[str, float]]:
    """The same factors under each way to infer mixtures."""
    n = weighting.entities(herbs)
    return {m: evaluate_all(herbs, symptoms, h, s, n=n, method=m) for m in methods}
