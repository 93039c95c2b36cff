"""Non-negative factor models of several views of the same entities.

Entities' rows stay on executors: each is an array of items and values for each view, and its mixture g. Items' loadings are
small by the model (items times topics) and live on the driver; a step broadcasts them, gives every row a new
g, and brings back only sums over all rows: X'G of each view, G'G, and for masked doses each item's own G'G. From these the
loadings' steps and the loss follow without a table of entities by items:
|X - G H'|^2 = |X|^2 - 2 <X'G, H> + <G'G, H'H>.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.operators.gather import gathered
from weftmine.operators.infer import dense, numbered
from weftmine.operators.linalg import CELLS, cells_of, gram, held, product
from weftmine.operators.tallskinny import leading, summed
from weftmine.session import cut, drop, stored

EPS = 1e-10
VIEWS = ("ph", "ps", "pd", "pair")


@dataclass
class Terms:
    """Weights of the loss; 0 leaves a term out. Graphs, conflicts and knowledge are item-sized matrices."""

    weight: dict[str, float] = field(default_factory=lambda: {"ph": 1.0, "ps": 1.0})
    laplacian: dict[str, tuple[float, np.ndarray]] = field(default_factory=dict)  # by view, ph with the sum of graphs and hyper-graphs
    l1: dict[str, float] = field(default_factory=dict)  # by view, and "g"
    conflict: tuple[float, np.ndarray] | None = None
    knowledge: tuple[float, np.ndarray] | None = None
    groups: tuple[float, np.ndarray, np.ndarray, bool] | None = None  # weight, edges by items (0/1), edge weights, whether by size
    roles: int = 1
    exclusive: float = 0.0
    normalise: bool = False


Factors = dict[str, np.ndarray]


def rows_of(views: dict[str, DataFrame], n_items: dict[str, int]) -> DataFrame:
    """pid with arrays <view>_i and <view>_v for tables (pid, item from 0, val); entities need one view at least. They are stored, so that every round may read them."""
    lists = gathered({v: x.withColumn("item", F.col("item").cast("int")) for v, x in views.items()})
    return stored(lists.select("pid", *(F.col(v)[field].alias(f"{v}_{c}") for v in views for c, field in (("i", "item"), ("v", "val")))))


def start(rows: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """rows with g drawn by hashes from [0.0001, 0.1]: the same wherever and whenever it is drawn, so that it isn't written."""
    one = lambda k: (F.pmod(F.xxhash64("pid", F.lit(seed), k), F.lit(1_000_003)) / 1_000_003) * 0.1 + 1e-4
    return rows.withColumn("g", F.transform(F.sequence(F.lit(1), F.lit(width)), one))


def drawn(n_items: dict[str, int], k: int, seed: int = 0, roles: int = 1) -> Factors:
    r = np.random.default_rng(seed)
    return {v: np.abs(r.normal(size=(n, k * (roles if v == "ph" else 1)))) * 0.1 + 1e-4 for v, n in n_items.items()}


def _drawn(seed: int, *places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from a seed and places, the same wherever and in whatever order they are drawn."""
    x = np.full(np.broadcast_shapes(*(np.shape(p) for p in places)), seed, np.uint64)
    with np.errstate(over="ignore"):
        for p in places:
            x = (x ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / 2.0**53


def by_roles(state: DataFrame, h: Factors, roles: int, seed: int = 0, noise: float = 0.01) -> tuple[DataFrame, Factors]:
    """A start of k topics dealt out to roles: each role gets an equal share of every number, raised by up to ``noise`` of it, as drawn by hashes of role, row and column.

    g and ph become roles * k wide, role by role; other views stay as they are. g's draws are by pid, so that they don't hang on partitions.
    """
    h, k = dict(h), h["ph"].shape[1]
    item, topic = np.arange(len(h["ph"]))[:, None], np.arange(k)[None]
    h["ph"] = np.hstack([np.maximum(h["ph"] / roles * (1 + noise * _drawn(seed, np.uint64(r), item, topic)), EPS) for r in range(roles)])

    def share(r: int):
        draw = lambda i: F.pmod(F.xxhash64("pid", F.lit(seed), F.lit(r), i), F.lit(1_000_003)) / 1_000_003
        return F.transform("g", lambda x, i: F.greatest(x / roles * (1 + noise * draw(i)), F.lit(EPS)))

    parts = [share(r) for r in range(roles)]
    return cut(state.withColumn("g", F.concat(*parts))), h


def _arrays(batch: pa.RecordBatch, view: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and value of a batch's cells."""
    items, values = batch.column(f"{view}_i"), batch.column(f"{view}_v")
    row = np.repeat(np.arange(batch.num_rows), np.diff(items.offsets.to_numpy()))
    return row, items.flatten().to_numpy(), values.flatten().to_numpy()


def _g(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("g").flatten().to_numpy().reshape(batch.num_rows, -1)


def _wide(h: Factors, roles: int) -> Factors:
    """Every view's loadings as wide as g: views other than ph have the same ones for each role."""
    return {v: m if v == "ph" or roles == 1 else np.tile(m, roles) for v, m in h.items()}


def _by_row(cells: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of cells by row; rows come in order."""
    out = np.zeros((n, cells.shape[1]))
    if len(row):
        begins = np.append(0, np.nonzero(np.diff(row))[0] + 1)
        out[row[begins]] = np.add.reduceat(cells, begins)
    return out


def _by_item(cells: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """Sums of cells by item."""
    return np.stack([np.bincount(item, c, n) for c in cells.T], 1) if cells.shape[1] else np.zeros((n, 0))


def _pull(batch: pa.RecordBatch, g: np.ndarray, h: Factors, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows' part of the loss: what draws g up and what draws it down."""
    up, down = np.zeros_like(g), np.full_like(g, terms.l1.get("g", 0.0) / 2)
    for view, m in h.items():
        w = terms.weight.get(view, 0.0)
        if not w:
            continue
        row, item, value = _arrays(batch, view)
        own = m[item]
        up += _by_row(w * value[:, None] * own, row, len(g))
        if view == "pd":  # only where there is a dose
            down += _by_row(w * (g[row] * own).sum(1)[:, None] * own, row, len(g))
        else:
            down += w * (g @ (m.T @ m))
    return up, down


@dataclass
class Move:
    """What a round does to g, once it is scaled: a step by these loadings (as wide as g) and terms."""

    h: Factors
    terms: Terms
    mode: str
    rate: float = 0.0
    shrink: float = 1.0
    scale: np.ndarray | None = None

    def slope(self, batch: pa.RecordBatch, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = g if self.scale is None else g * self.scale
        return g, *_pull(batch, g, self.h, self.terms)

    def __call__(self, batch: pa.RecordBatch, g: np.ndarray) -> np.ndarray:
        g, up, down = self.slope(batch, g)
        return np.maximum(g - self.rate * self.shrink * 2 * (down - up), 0) if self.mode == "pgd" else g * up / (down + EPS)


#: Rounds that are made again from the rows as they were stored, before the rows are stored anew.
AGAIN = 8


def _moved_g(batch: pa.RecordBatch, moves: list[Move]) -> np.ndarray:
    g = _g(batch)
    for m in moves:
        g = m(batch, g)
    return g


def move(state: DataFrame, moves: list[Move], h: Factors, terms: Terms, mode: str, rate: float = 0.0, scale: np.ndarray | None = None, clip: float = 1e4) -> Move:
    """The next of a state's moves: multiplicative, or along the gradient, whose length is looked up, and back to g >= 0."""
    if mode not in ("mur", "pgd", "hybrid"):
        raise ValueError(f"unknown step {mode}")
    now = Move(_wide(h, terms.roles), Terms(weight=terms.weight, l1=terms.l1), mode, rate, scale=scale)
    if mode == "pgd":

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                _, up, down = now.slope(batch, _moved_g(batch, moves))
                total += 4 * float(((down - up) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["s"])

        norm = np.sqrt(state.mapInArrow(sizes, "s double").agg(F.sum("s")).first()[0] or 0.0)
        return replace(now, shrink=min(1.0, clip / norm) if norm > 0 else 1.0)
    return now


def after(state: DataFrame, moves: list[Move], scale: np.ndarray | None = None) -> DataFrame:
    """state with g as it is after all moves, scaled at last. Nothing is written."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _moved_g(batch, moves) * (1.0 if scale is None else scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * g.shape[1], pa.int32()), pa.array(g.ravel()))
            at = batch.schema.get_field_index("g")
            yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return state.mapInArrow(step, state.schema)


def moved(state: DataFrame, h: Factors, terms: Terms, mode: str, rate: float = 0.0, scale: np.ndarray | None = None, clip: float = 1e4) -> DataFrame:
    """state with g one step on: multiplicative, or along the gradient and back to g >= 0."""
    return cut(after(state, [move(state, [], h, terms, mode, rate, scale, clip)]))


def sums(state: DataFrame, n_items: dict[str, int], width: int | None = None, moves: list[Move] | None = None) -> dict[str, np.ndarray]:
    """Over all rows: X'G and |X|^2 of each view, G'G, sum of g, and for doses each item's G'G. A partition sends each once. width: of g, looked up if not given. moves: what becomes of g first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def add(name: str, value: np.ndarray) -> None:
            total[name] = total[name] + value if name in total else value

        for batch in batches:
            g = _moved_g(batch, moves or [])
            add("gram", g.T @ g)
            add("g", g.sum(0))
            for view, n in n_items.items():
                row, item, value = _arrays(batch, view)
                add(f"xg {view}", _by_item(value[:, None] * g[row], item, n))
                add(f"xx {view}", np.array([float((value * value).sum())]))
                if view == "pd":
                    add("own", _by_item((g[row][:, :, None] * g[row][:, None, :]).reshape(len(row), -1), item, n))
        names = [k for k, v in total.items() for _ in range(v.size)]
        at = [i for v in total.values() for i in range(v.size)]
        values = np.concatenate([np.zeros(0), *(v.ravel() for v in total.values())])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(values)], names=["name", "at", "v"])

    width = width or len(state.select("g").first()[0])
    shapes = {"gram": (width, width), "g": (width,), "own": (n_items.get("pd", 0), width, width)} | {f"xg {v}": (n, width) for v, n in n_items.items()} | {f"xx {v}": (1,) for v in n_items}
    out = {k: np.zeros(int(np.prod(s))) for k, s in shapes.items()}
    for name, at, v in state.mapInArrow(partial, "name string, at int, v double").groupBy("name", "at").agg(F.sum("v")).collect():
        out[name][at] = v
    return {k: v.reshape(shapes[k]) for k, v in out.items()}


def _fold(m: np.ndarray, roles: int, axes: tuple[int, ...]) -> np.ndarray:
    """Sums over roles along axes of roles * k."""
    for a in axes:
        shape = (*m.shape[:a], roles, m.shape[a] // roles, *m.shape[a + 1 :])
        m = m.reshape(shape).sum(a)
    return m


def over_roles(m: np.ndarray, roles: int) -> np.ndarray:
    """Loadings of roles * k topics, summed over roles."""
    return _fold(m, roles, (1,))


def _seen(s: dict[str, np.ndarray], view: str, roles: int) -> tuple[np.ndarray, np.ndarray]:
    """X'G and G'G as a view's loadings see them."""
    if view == "ph" or roles == 1:
        return s[f"xg {view}"], s["gram"]
    return _fold(s[f"xg {view}"], roles, (1,)), _fold(s["gram"], roles, (0, 1))


def _apart(terms: Terms, m: np.ndarray) -> np.ndarray:
    """Of each role's loadings, the others' sum."""
    k = m.shape[1] // terms.roles
    return np.tile(_fold(m, terms.roles, (1,)), terms.roles) - m if k else m


def pulls(view: str, h: Factors, s: dict[str, np.ndarray], terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Half the gradient of the loss by a view's loadings, as what draws up and what draws down; both are >= 0."""
    m, w = h[view], terms.weight.get(view, 0.0)
    xg, gg = _seen(s, view, terms.roles)
    up = w * xg
    if view == "pd":
        own = _fold(s["own"], terms.roles, (1, 2)) if terms.roles > 1 else s["own"]
        down = w * np.einsum("ikl,il->ik", own, m)
    else:
        down = w * (m @ gg)
    down = down + terms.l1.get(view, 0.0) / 2
    if view in terms.laplacian:
        weight, lap = terms.laplacian[view]
        up, down = up + weight * (np.maximum(-lap, 0) @ m), down + weight * (np.maximum(lap, 0) @ m)
    if view == "ph" and terms.conflict:
        down = down + terms.conflict[0] * (terms.conflict[1] @ m)
    if view == "ph" and terms.groups:
        weight, edges, edge_weight, by_size = terms.groups
        size = edges.sum(1)
        each = weight * edge_weight / (size if by_size else 1.0)
        down = down + (edges.T @ each)[:, None] * m
        up = up + edges.T @ ((each / size)[:, None] * (edges @ m))
    if view == "ph" and terms.exclusive and terms.roles > 1:
        down = down + terms.exclusive / 2 * _apart(terms, m)
    if terms.knowledge and view in ("ph", "ps"):
        weight, known = terms.knowledge
        if view == "ph":
            up, down = up + weight * np.tile(known @ h["ps"], terms.roles), down + weight * np.tile(_fold(m, terms.roles, (1,)) @ (h["ps"].T @ h["ps"]), terms.roles)
        else:
            whole = _fold(h["ph"], terms.roles, (1,))
            up, down = up + weight * (known.T @ whole), down + weight * (m @ (whole.T @ whole))
    return up, down


def loss(h: Factors, s: dict[str, np.ndarray], terms: Terms) -> dict[str, float]:
    """Each term's part, and the total."""
    out: dict[str, float] = {}
    for view, w in terms.weight.items():
        if not w or view not in h:
            continue
        xg, gg = _seen(s, view, terms.roles)
        m = h[view]
        own = _fold(s["own"], terms.roles, (1, 2)) if view == "pd" and terms.roles > 1 else s["own"]
        recon = float(np.einsum("ik,ikl,il->", m, own, m)) if view == "pd" else float((gg * (m.T @ m)).sum())
        out[view] = w * max(float(s[f"xx {view}"][0]) - 2 * float((xg * m).sum()) + recon, 0.0)
    for view, (weight, lap) in terms.laplacian.items():
        out[f"graph {view}"] = weight * float((h[view] * (lap @ h[view])).sum())
    for name, weight in terms.l1.items():
        out[f"l1 {name}"] = weight * float(s["g"].sum() if name == "g" else np.abs(h[name]).sum())
    if terms.conflict:
        out["conflict"] = terms.conflict[0] * float((h["ph"] * (terms.conflict[1] @ h["ph"])).sum())
    if terms.groups:
        weight, edges, edge_weight, by_size = terms.groups
        size = edges.sum(1)
        mean = (edges @ h["ph"]) / size[:, None]
        spread = (edges @ h["ph"] ** 2).sum(1) - size * (mean**2).sum(1)
        out["groups"] = weight * float((edge_weight * spread / (size if by_size else 1.0)).sum())
    if terms.knowledge:
        out["knowledge"] = terms.knowledge[0] * float(((terms.knowledge[1] - _fold(h["ph"], terms.roles, (1,)) @ h["ps"].T) ** 2).sum())
    if terms.exclusive and terms.roles > 1:
        out["exclusive"] = terms.exclusive / 2 * float((h["ph"] * _apart(terms, h["ph"])).sum())
    out["total"] = sum(out.values())
    return out


def _descend(m: np.ndarray, up: np.ndarray, down: np.ndarray, rate: float, clip: float) -> np.ndarray:
    slope = 2 * (down - up)
    norm = float(np.linalg.norm(slope))
    return np.maximum(m - rate * slope * min(1.0, clip / norm if norm > 0 else 1.0), 0)


def step(state: DataFrame, h: Factors, terms: Terms, mode: str = "mur", *, rate: float = 1e-3, inner: int = 5, clip: float = 1e4, scale: np.ndarray | None = None) -> tuple[DataFrame, Factors, dict[str, np.ndarray], np.ndarray | None]:
    """One round, blocks in turn: rows' g, then each view's loadings. mode: mur (multiplicative), pgd (gradient), hybrid (multiplicative, ps by ``inner`` gradient steps).

    Gives the new state and loadings, the sums they were made from, and the factors by which g is still to be scaled.
    """
    state = moved(state, h, terms, mode, rate, scale, clip)
    return state, *_loadings(h, _sums_for(state, [], h, terms), terms, mode, rate, inner, clip)


def _sums_for(state: DataFrame, moves: list[Move], h: Factors, terms: Terms) -> dict[str, np.ndarray]:
    return sums(state, {v: len(m) for v, m in h.items()}, max(m.shape[1] for m in _wide(h, terms.roles).values()), moves)


def _loadings(h: Factors, s: dict[str, np.ndarray], terms: Terms, mode: str, rate: float, inner: int = 5, clip: float = 1e4) -> tuple[Factors, dict[str, np.ndarray], np.ndarray | None]:
    """Of a round, what comes after g's sums: the new loadings, the sums, and the factors by which g is still to be scaled."""
    h = dict(h)
    for view in VIEWS:
        if view not in h:
            continue
        if mode == "pgd" or mode == "hybrid" and view == "ps":
            for _ in range(inner if mode == "hybrid" else 1):
                h[view] = _descend(h[view], *pulls(view, h, s, terms), rate, clip)
        else:
            up, down = pulls(view, h, s, terms)
            h[view] = h[view] * up / (down + EPS)
    if not terms.normalise or terms.roles > 1:
        return h, s, None
    size = np.maximum(np.linalg.norm(h["ph"], axis=0), EPS)
    h = {v: m / size for v, m in h.items()}
    for name in list(s):
        s[name] = s[name] * size if name.startswith("xg") or name == "g" else s[name] * np.outer(size, size) if name in ("gram", "own") else s[name]
    return h, s, size


@dataclass
class Fit:
    state: DataFrame
    factors: Factors
    history: list[dict[str, float]]


def fit(state: DataFrame, h: Factors, terms: Terms, mode: str = "mur", *, iterations: int = 30, warm_up: int = 0, pretrain: int = 0, tolerance: float = 1e-5, rate: float = 1e-3, average: int = 0, select: str = "last", evaluate=None, every: int = 10, patience: int = 3, on_step=None) -> Fit:
    """Rounds until the loss changes by less than ``tolerance`` of it, or ``evaluate`` (larger is better) has not gained ``patience`` times.

    The first ``pretrain`` rounds have the views alone; graph and group weights grow over ``warm_up`` rounds after
    them. select: last, best (by evaluate) or average (of the last ``average`` rounds' loadings).

    state is cut or stored, or made of such rows alone. A round writes nothing: its sums are made of the rows as they were stored, with g moved by all rounds since, of which each needs but its loadings. After AGAIN rounds
    the rows are stored with g as it then is.
    """
    history, kept, best, waited, scale = [], [], (-np.inf, h), 0, None
    moves: list[Move] = []
    own: list[DataFrame] = []
    for i in range(iterations):
        now = terms
        if i < pretrain:
            now = Terms(weight=terms.weight, roles=terms.roles, normalise=terms.normalise)
        elif warm_up and i - pretrain < warm_up:
            part = (i - pretrain + 1) / warm_up
            groups = terms.groups and (terms.groups[0] * part, *terms.groups[1:])
            now = Terms(**{**terms.__dict__, "laplacian": {v: (w * part, m) for v, (w, m) in terms.laplacian.items()}, "groups": groups})
        if len(moves) == AGAIN:
            own = [*own, stored(after(state, moves))]
            drop(*own[:-1])
            state, moves, own = own[-1], [], own[-1:]
        moves = [*moves, move(state, moves, h, now, mode, rate, scale)]
        h, s, scale = _loadings(h, _sums_for(state, moves, h, now), now, mode, rate)
        history.append(loss(h, s, now))
        kept = [*kept, h][-average:] if average else []
        if on_step:
            on_step(i, history[-1])
        if evaluate and (i + 1) % every == 0:
            value = evaluate(h)
            best, waited = ((value, h), 0) if value > best[0] else (best, waited + 1)
            if waited >= patience:
                break
        full = i >= pretrain + warm_up
        if full and i and len(history) > 1 and abs(history[-2]["total"] - history[-1]["total"]) <= tolerance * max(history[-2]["total"], EPS):
            break
    state = after(state, moves, scale)
    if select == "best" and evaluate:
        h = best[1]
    elif select == "average" and kept:
        h = {v: np.mean([f[v] for f in kept], axis=0) for v in h}
    elif select not in ("last", "best", "average"):
        raise ValueError(f"unknown selection {select}")
    return Fit(state, h, history)


def refined(view: str, h: Factors, s: dict[str, np.ndarray], terms: Terms, steps: int = 50, rate: float = 1e-3) -> np.ndarray:
    """A view's loadings after more gradient steps with everything else held."""
    h = dict(h)
    for _ in range(steps):
        h[view] = _descend(h[view], *pulls(view, h, s, terms), rate, 1e4)
    return h[view]


def nndsvd(rows: DataFrame, view: str, n_items: int, k: int, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Starting loadings and g (pid, g) from the leading singular vectors, found by random projections, so that no table of items by items is made.

    The first pair are the root of the mean of all cells; of each other pair the half of one sign that weighs more is kept. g's rows sum to 1. Pairs beyond what the table has are at the floor.
    """

    def product(batch: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        row, item, value = _arrays(batch, view)
        out = np.zeros((batch.num_rows, m.shape[1]))
        np.add.at(out, row, value[:, None] * m[item])
        return out

    def back(batch: pa.RecordBatch, y: np.ndarray) -> np.ndarray:
        row, item, value = _arrays(batch, view)
        out = np.zeros((n_items, y.shape[1]))
        np.add.at(out, item, value[:, None] * y[row])
        return out

    found = leading(rows, product, back, n_items, min(k, n_items), seed=seed)
    cells = rows.agg(F.count("*").alias("n"), F.sum(F.aggregate(f"{view}_v", F.lit(0.0), lambda s, v: s + v)).alias("total")).first()
    mean = (cells.total or 0.0) / max(1, cells.n * n_items)
    sigma, v = (np.pad(a, [(0, 0)] * (a.ndim - 1) + [(0, k - a.shape[-1])]) for a in (found.values, found.vectors))
    sigma = np.maximum(sigma, EPS)
    order = np.arange(k)

    def left(batch: pa.RecordBatch) -> np.ndarray:
        row, item, value = _arrays(batch, view)
        u = np.zeros((batch.num_rows, len(order)))
        np.add.at(u, row, value[:, None] * v[item] / sigma)
        return u

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus = minus = np.zeros(len(order))
        for batch in batches:
            u = left(batch)
            plus, minus = plus + (np.maximum(u, 0) ** 2).sum(0), minus + (np.minimum(u, 0) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(order)), pa.int64()), pa.array(plus), pa.array(minus)], names=["at", "p", "m"])

    squares = np.zeros((2, len(order)))
    for at, p, m in rows.mapInArrow(halves, "at long, p double, m double").groupBy("at").agg(F.sum("p"), F.sum("m")).collect():
        squares[:, at] = p, m
    u_plus, u_minus = np.sqrt(squares)
    v_plus, v_minus = np.linalg.norm(np.maximum(v, 0), axis=0), np.linalg.norm(np.minimum(v, 0), axis=0)
    sign = np.where(u_plus * v_plus >= u_minus * v_minus, 1.0, -1.0)
    u_norm, v_norm = np.where(sign > 0, u_plus, u_minus), np.where(sign > 0, v_plus, v_minus)
    root = np.sqrt(sigma * u_norm * v_norm)
    h = np.maximum(root * np.maximum(sign * v, 0) / np.maximum(v_norm, EPS), EPS)
    first = max(float(np.sqrt(max(mean, 0.0))), EPS)
    h[:, 0] = first

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = left(batch)
            g = np.maximum(root * np.maximum(sign * u, 0) / np.maximum(u_norm, EPS), EPS)
            g[:, 0] = first
            g /= g.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * g.shape[1], pa.int32()), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("pid"), lists], names=["pid", "g"])

    kind = dict(rows.dtypes)["pid"]
    return h, rows.mapInArrow(spread, f"pid {kind}, g array<double>")


# Single steps over long tables, for models of any size of items


def mixed(x: DataFrame, g: DataFrame) -> DataFrame:
    """pid, __own (its items, as (item, v)), __cells (its mixture, as (k, v)) of long tables; mixtures whose entity has no items have none."""
    lists = lambda df, key, v, name: df.groupBy("pid").agg(F.collect_list(F.struct(key, F.col(v).cast("double").alias("v"))).alias(name))
    own = lists(x, "item", "val", "__own")
    return lists(g, "k", "v", "__cells").join(own, "pid", "left").select("pid", "__cells", F.coalesce("__own", F.array().cast(dict(own.dtypes)["__own"])).alias("__own"))


def _exploded(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("pid", F.explode(column).alias("__c")).select("pid", "__c.*")


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of which no table as wide is above CELLS."""
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)


def multiplicative_step(x: DataFrame | None, g: DataFrame, h: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New g (pid, k, v) and h (item, k, v) after one multiplicative round for x (pid, item, val).

    Without x, g has whole rows with their items beside them, as ``mixed`` and ``linalg.product_of_rows`` (keep) give them. An h of CELLS cells at most goes to the tasks, which send back sums over their rows; a larger one is joined.
    """
    rows, model = (g if x is None else mixed(x, g)), held(h, "item", "k")
    if model is None:
        return _multiplicative_by_joins(_exploded(rows, "__own").withColumnRenamed("v", "val"), _exploded(rows, "__cells"), h)
    items, topics, m, there = model
    shape, gram_h = m.shape, m.T @ m

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, max(shape)):
            lists = part.column("__cells")
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            now = cells_of(lists, topics)[0]
            new = now * (cells_of(part.column("__own"), items)[0] @ m) / (now @ gram_h + EPS)
            place = pc.fill_null(pc.index_in(flat.field(0), topics), -1).to_numpy(zero_copy_only=False)
            value = np.where(place >= 0, new[np.repeat(np.arange(len(sizes)), sizes), place], 0.0) if len(topics) else np.zeros(len(place))
            begins = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            lists = pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays([flat.field(0), pa.array(value)], names=["k", "v"]))
            yield pa.RecordBatch.from_arrays([part.column("pid"), lists, part.column("__own")], names=["pid", "__cells", "__own"])

    rows = rows.select("pid", "__cells", "__own")
    rows = stored(rows.mapInArrow(step, ", ".join(f"{c} {t}" for c, t in rows.dtypes)))

    def both(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((sum(shape), shape[1]))
        for part in _parts(iter([batch]), max(shape)):
            now = cells_of(part.column("__cells"), topics)[0]
            out += np.vstack([cells_of(part.column("__own"), items)[0].T @ now, now.T @ now])
        return out

    totals = summed(rows, both, (sum(shape), shape[1]))
    new = m * totals[: shape[0]] / (m @ totals[shape[0] :] + EPS)
    at = np.argwhere(there > 0)
    kinds, names, of = dict(h.dtypes), items.to_pylist(), topics.to_pylist()
    return _exploded(rows, "__cells"), h.sparkSession.createDataFrame([(names[i], of[j], float(new[i, j])) for i, j in at.tolist()], f"item {kinds['item']}, k {kinds['k']}, v double")


def _multiplicative_by_joins(x: DataFrame, g: DataFrame, h: DataFrame) -> tuple[DataFrame, DataFrame]:
    xv = x.select("pid", "item", F.col("val").alias("v"))
    ratio = lambda old, up, down, keys: old.join(up.withColumnRenamed("v", "up"), keys, "left").join(down.withColumnRenamed("v", "down"), keys, "left").select(*keys, (F.col("v") * F.coalesce("up", F.lit(0.0)) / (F.coalesce("down", F.lit(0.0)) + EPS)).alias("v"))
    over = lambda old, both, row: product(old, both.withColumnRenamed("l", "__l"), row, "k", "__l").withColumnRenamed("__l", "k")
    g = cut(ratio(g, product(xv, h, "pid", "item", "k"), over(g, gram(h, "item", "k"), "pid"), ["pid", "k"]))
    h = ratio(h, product(xv.select("item", "pid", "v"), g, "item", "pid", "k"), over(h, gram(g, "pid", "k"), "item"), ["item", "k"])
    return g, h


def gradient_step(x: DataFrame | None, g: DataFrame, h: DataFrame, rate: float, l1: float = 0.0) -> DataFrame:
    """New g (pid, k, v) after one step down the gradient of |X - G H'|^2 + l1 |G| and back to g >= 0. Without x, and for larger h, as for ``multiplicative_step``."""
    rows, model = (g if x is None else mixed(x, g)), held(h, "item", "k")
    if model is None:
        return _gradient_by_joins(_exploded(rows, "__own").withColumnRenamed("v", "val"), _exploded(rows, "__cells"), h, rate, l1)
    items, topics, m, there = model
    gram_h, linked = m.T @ m, there.T @ there > 0

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, max(m.shape)):
            now, has = cells_of(part.column("__cells"), topics)
            new = np.maximum(now - rate * (2 * (now @ gram_h - cells_of(part.column("__own"), items)[0] @ m) + l1), 0.0)
            i, j = np.nonzero((has > 0) & (has @ linked > 0))
            yield pa.RecordBatch.from_arrays([part.column("pid").take(pa.array(i)), topics.take(pa.array(j)), pa.array(new[i, j])], names=["pid", "k", "v"])

    return rows.select("pid", "__cells", "__own").mapInArrow(step, f"pid {dict(rows.dtypes)['pid']}, k {dict(h.dtypes)['k']}, v double")


def _gradient_by_joins(x: DataFrame, g: DataFrame, h: DataFrame, rate: float, l1: float) -> DataFrame:
    up = product(x.select("pid", "item", F.col("val").alias("v")), h, "pid", "item", "k").withColumnRenamed("v", "up")
    down = product(g, gram(h, "item", "k").withColumnRenamed("l", "__l"), "pid", "k", "__l").select("pid", F.col("__l").alias("k"), F.col("v").alias("down"))
    rows = g.join(up, ["pid", "k"], "left").join(down, ["pid", "k"])
    return rows.select("pid", "k", F.greatest(F.col("v") - rate * (2 * (F.col("down") - F.coalesce("up", F.lit(0.0))) + l1), F.lit(0.0)).alias("v"))


def em_step(x: DataFrame, theta: DataFrame, p: DataFrame) -> DataFrame:
    """New p (item, k, v), the share of items in topics, for counts x (pid, item, val) with mixtures theta (pid, k, v) held: one round of expectation and maximisation."""
    both = x.join(theta.select("pid", "k", F.col("v").alias("t")), "pid").join(p, ["item", "k"]).withColumn("tv", F.col("t") * F.col("v"))
    seen = both.groupBy("pid", "item").agg(F.sum("tv").alias("q"))
    parts = both.join(seen, ["pid", "item"]).filter(F.col("q") > EPS).groupBy("item", "k").agg(F.sum(F.col("val") * F.col("tv") / F.col("q")).alias("r"))
    total = parts.groupBy("k").agg(F.sum("r").alias("total"))
    return parts.join(total, "k").select("item", "k", (F.col("r") / F.greatest(F.col("total"), F.lit(EPS))).alias("v"))


def em_fit(x: DataFrame, theta: DataFrame, p: DataFrame, iterations: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """Rounds of em_step until no share moves by more than ``tolerance``.

    Shares of CELLS cells at most, such as a model's, go to the tasks, where each entity is a row of its items and mixture; a round brings back items by topics from each task. Larger ones are joined.
    """
    if p.limit(CELLS + 1).count() > CELLS:
        theta = cut(_exploded(theta, "__cells") if "__cells" in theta.columns else theta)
        for _ in range(iterations):
            new = stored(em_step(x, theta, p))
            change = new.join(p.withColumnRenamed("v", "old"), ["item", "k"], "full").agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            p = new
            if (change or 0.0) <= tolerance:
                break
        return p
    kinds = dict(p.dtypes)
    items, topics, m = dense(p)
    spark, width = x.sparkSession, len(topics)
    names, keys = numbered(items, p, "item"), numbered(topics, p, "k")
    rows = (x.groupBy("pid").agg(F.collect_list(F.struct("item", F.col("val").cast("double").alias("v"))).alias("__own")).join(theta, "pid") if "__cells" in theta.columns else mixed(x, theta)).filter(F.size("__own") > 0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, max(m.shape, default=1)):
            lists = part.column("__own")
            flat, t = lists.flatten(), cells_of(part.column("__cells"), keys)[0]
            no = pc.fill_null(pc.index_in(flat.field(0), names), -1).cast(pa.int32())
            begins = pa.array(np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(begins, no), pa.ListArray.from_arrays(begins, flat.field(1)), pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * width, pa.int32()), pa.array(t.ravel()))], names=["x_i", "x_v", "g"])

    rows = stored(rows.select("__own", "__cells").mapInArrow(placed, "x_i array<int>, x_v array<double>, g array<double>"))
    for _ in range(iterations):
        held_p = m

        def shares(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(held_p.shape)  # noqa: B023
            for part in _parts(iter([batch]), max(out.shape)):
                row, item, value = _arrays(part, "x")
                known, t = item >= 0, _g(part)
                x = np.zeros((len(t), len(out)))
                np.add.at(x, (row[known], item[known]), value[known])
                seen = t @ held_p.T  # noqa: B023
                out += np.divide(x, seen, out=np.zeros_like(x), where=seen > EPS).T @ t
            return out * held_p  # noqa: B023

        r = summed(rows, shares, m.shape)
        m = r / np.maximum(r.sum(0), EPS)
        if np.abs(m - held_p).max(initial=0.0) <= tolerance:
            break
    at = np.argwhere(m > 0)
    return spark.createDataFrame([(items[i], topics[j], float(m[i, j])) for i, j in at.tolist()], f"item {kinds['item']}, k {kinds['k']}, v double")
