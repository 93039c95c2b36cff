"""Configurations of experiment families, what of them is done, and their summaries."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from weftmine.sources.files import merged

#: Parts of the full model in the order in which an ablation takes them away, each with the settings that do.
CHAIN = (
    ("full", {}),
    ("no_knowledge", {"knowledge": 0.0}),
    ("no_pair", {"weight": {"pair": 0.0}}),
    ("no_sparsity", {"l1": {"g": 0.0, "ph": 0.0, "ps": 0.0}}),
    ("herb_graph_only", {"graph": {"ps": 0.0}}),
    ("views_only", {"graph": {"ph": 0.0}}),
)


def ablation(base: dict, seeds: Iterable[int], ks: Iterable[int]) -> Iterator[dict]:
    """Every stage of the chain (each keeps what the ones before took away), seed and number of topics."""
    seeds, ks, config = list(seeds), list(ks), base
    for stage, change in CHAIN:
        config = merged(config, change)
        for seed in seeds:
            for k in ks:
                yield merged(config, {"stage": stage, "seed": seed, "k": k})


def sweep(base: dict, name: str, values: Iterable, seeds: Iterable[int], *, along: dict[str, float] | None = None) -> Iterator[dict]:
    """One setting (a dotted name) over values; settings in ``along`` follow it at a fixed ratio."""
    seeds = list(seeds)

    def put(path: str, value) -> dict:
        out = value
        for part in reversed(path.split(".")):
            out = {part: out}
        return out

    for value in values:
        config = merged(base, put(name, value))
        for other, ratio in (along or {}).items():
            config = merged(config, put(other, value * ratio))
        for seed in seeds:
            yield merged(config, {"param": name, "value": value, "seed": seed})


def weighting_variants(base: dict, seeds: Iterable[int]) -> Iterator[dict]:
    """TF-IDF, plain counts scaled by row, and 0/1."""
    seeds = list(seeds)
    for name, change in (("tfidf", {"idf": True, "norm": "l2"}), ("tf", {"idf": False, "norm": "l2"}), ("binary", {"idf": False, "norm": "none"})):
        for seed in seeds:
            yield merged(base, {"input": change, "variant": name, "seed": seed})


def key(config: dict) -> str:
    return json.dumps(config, sort_keys=True)


def checked(config: dict) -> dict:
    """The configuration, if no weight is negative, a view is on, and numbers of topics and rounds are whole and positive."""
    for part in ("weight", "graph", "l1"):
        for name, value in config.get(part, {}).items():
            if value < 0:
                raise ValueError(f"{part} {name} must not be negative")
    for name in ("contra", "knowledge", "hyper"):
        if config.get(name, 0) < 0:
            raise ValueError(f"{name} must not be negative")
    if not any(config.get("weight", {}).values()):
        raise ValueError("no view is on")
    for name, value in (("k", config.get("k", 1)), ("iterations", config.get("training", {}).get("iterations", 1))):
        if not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be a whole number from 1")
    return config


def done(folder: str, config: dict | None = None, files: tuple[str, ...] = ("config.json", "metrics.json", "summary.json")) -> bool:
    """Whether a run's files are all there, and, if asked, whether it was this configuration."""
    if not all(os.path.exists(os.path.join(folder, f)) for f in files):
        return False
    if config is None:
        return True
    with open(os.path.join(folder, "config.json")) as f:
        return key(json.load(f)) == key(config)


def left(configs: Iterable[dict], folder_of) -> list[dict]:
    """Runs that are still to do."""
    return [c for c in configs if not done(folder_of(c), c)]
