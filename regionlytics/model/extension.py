"""What a model can be extended by, under names: kinds of rate models, and kinds of observations.

Both sides are checked. A rate model gets targets of a known schema and must give K finite log
rates a row, also after a fit and after a round trip through its own text; observations must lie
in the contexts and alternatives that their kind declares.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import clusters as cl
from ..operators.corpora import unpacked
from ..sources.validate import require_columns
from .boosting import BoostedRate, Tree
from .linear import LinearRate

#: What fit(targets, rate) reads: K numbers in target, eta and logmu, the design in x.
TARGETS = {"x": "array<double>", "target": "array<double>", "eta": "array<double>", "logmu": "array<double>"}


@dataclass(frozen=True)
class RateKind:
    """make(k, width, corpora, groups, options) gives a new rate model, dump and load its text; ordinal: categories reach it as codes, not as dummies.

    A rate model has ``kind``, this kind's name; log_rate(x) from n x width to n x K; fit(targets,
    rate), a new model blended in by rate. It may have grown(x, logmu), the log rate from the one
    before the last fit, and columns(x), log_rate as an array Column, which leaves rates to Spark. by_cell
    says that log_rate is cheap enough for each cell of a sample, so that cells keep x and meet their loci once.
    """

    name: str
    make: Callable[..., Any]
    dump: Callable[[Any], dict]
    load: Callable[[dict], Any]
    ordinal: bool = False


@dataclass(frozen=True)
class ObservationKind:
    """Observations of contexts x mutations; labels(matrix) names the entries of a signature, matrix(signature) is its inverse, featurise(snvs, segs, sequences) makes the rows."""

    name: str
    contexts: int
    mutations: int
    labels: Callable[[np.ndarray], dict[str, float]]
    matrix: Callable[[dict[str, float]], np.ndarray] | None = None
    featurise: Callable[..., DataFrame] | None = None


_rates: dict[str, RateKind] = {}
_observations: dict[str, ObservationKind] = {}


def _register(table: dict, kind, replace: bool) -> None:
    if kind.name in table and not replace:
        raise ValueError(f"{kind.name} is registered already")
    table[kind.name] = kind


def register_rate(kind: RateKind, replace: bool = False) -> None:
    _register(_rates, kind, replace)


def register_observation(kind: ObservationKind, replace: bool = False) -> None:
    if kind.contexts < 1 or kind.mutations < 1:
        raise ValueError("an observation has at least one context and one mutation")
    _register(_observations, kind, replace)


def _named(table: dict, name: str, what: str):
    if name not in table:
        raise ValueError(f"no {what} {name}; there are {sorted(table)}")
    return table[name]


def rate_kind(name: str) -> RateKind:
    return _named(_rates, name, "rate model")


def observation(name: str) -> ObservationKind:
    return _named(_observations, name, "kind of observation")


def checked(model: Any, kind: str, k: int, width: int) -> Any:
    """model, if it is of that kind and gives k finite log rates for rows of that width; else an error."""
    if getattr(model, "kind", None) != kind or not callable(getattr(model, "fit", None)):
        raise ValueError(f"a rate model of kind {kind} must say so and have fit()")
    got = np.asarray(model.log_rate(np.zeros((2, width))))
    if got.shape != (2, k) or not np.isfinite(got).all():
        raise ValueError(f"log rates of {kind} must be {k} finite numbers a row, not of shape {got.shape}")
    return model


def make_rate(name: str, k: int, width: int, corpora: list[str], groups: list[list[int]] | None, options: dict) -> Any:
    return checked(rate_kind(name).make(k, width, corpora, groups, options), name, k, width)


def fit_rate(model: Any, targets: DataFrame, rate: float, width: int) -> Any:
    """model.fit() between the checks of what goes in and of what comes out."""
    kinds = {f.name: f.dataType.simpleString() for f in require_columns(targets, list(TARGETS)).schema}
    if wrong := {c: kinds[c] for c, t in TARGETS.items() if kinds[c] != t}:
        raise ValueError(f"targets have columns of other types: {wrong}")
    k = np.asarray(model.log_rate(np.zeros((1, width)))).shape[1]
    return checked(model.fit(targets, rate), model.kind, k, width)


def dump_rate(model: Any, width: int) -> dict:
    """The rate model as what JSON holds, if it is the same model when read back; else an error."""
    kind = rate_kind(model.kind)
    told = {"kind": kind.name} | kind.dump(model)
    x = np.random.default_rng(0).normal(size=(8, width))
    if not np.allclose(kind.load(json.loads(json.dumps(told))).log_rate(x), model.log_rate(x)):
        raise ValueError(f"a rate model of kind {kind.name} changes when it is stored")
    return told


def load_rate(told: dict) -> Any:
    return rate_kind(told["kind"]).load(told)


def check_observations(kind: ObservationKind, mutations: DataFrame, trinucs: DataFrame) -> None:
    """An error unless context and mutation of all rows are among the kind's, and weights are numbers; one aggregation a table."""
    require_columns(mutations, ["corpus", "sample", "locus", "context", "mutation", "weight"])
    trinucs = unpacked(trinucs)
    require_columns(trinucs, ["corpus", "locus", "context", "n"])

    def outside(df: DataFrame, **sizes: int) -> int:
        ok = F.lit(True)
        for column, size in sizes.items():
            ok = ok & F.coalesce(F.col(column).between(0, size - 1), F.lit(False))
        return df.agg(F.count_if(~ok)).first()[0]

    if n := outside(mutations, context=kind.contexts, mutation=kind.mutations):
        raise ValueError(f"{n} mutations aren't {kind.name}: {kind.contexts} contexts of {kind.mutations} mutations")
    if n := outside(trinucs, context=kind.contexts):
        raise ValueError(f"{n} counts of contexts aren't of the {kind.contexts} of {kind.name}")


def _linear(told: dict) -> LinearRate:
    rate = LinearRate(len(told["beta"]), len(told["beta"][0]))
    rate.beta = np.array(told["beta"])
    return rate


def _boosted_text(r: BoostedRate) -> dict:
    own = ("n_features", "n_corpora", "bins", "depth", "learning_rate", "rounds", "patience", "least", "l2", "groups", "held_out")
    edges = None if r.edges is None else [e.tolist() for e in r.edges]
    return {a: getattr(r, a) for a in own} | {"edges": edges, "bias": r.bias.tolist(), "trees": [[(w, vars(t)) for w, t in trees] for trees in r.trees]}


def _boosted(told: dict) -> BoostedRate:
    settings = ("bins", "depth", "learning_rate", "rounds", "patience", "least", "l2", "groups", "held_out")
    rate = BoostedRate(len(told["trees"]), told["n_features"] + told["n_corpora"], told["n_corpora"], **{a: told[a] for a in settings})
    rate.edges = None if told["edges"] is None else [np.array(e) for e in told["edges"]]
    rate.bias = np.array(told["bias"])
    for trees, kept in zip(rate.trees, told["trees"], strict=True):
        for w, t in kept:
            tree = Tree()
            vars(tree).update(t)
            trees.append((w, tree))
    return rate


def _substitution_labels(matrix: np.ndarray) -> dict[str, float]:
    """The 96 labels of substitutions, both strands added."""
    flip = str.maketrans("ACGT", "TGCA")
    out: dict[str, float] = {}
    for c, context in enumerate(sq.CONTEXTS):
        for a, alt in enumerate(sq.alternatives(context)):
            ctx, b = (context, alt) if context[1] in "CT" else (context.translate(flip)[::-1], alt.translate(flip))
            label = f"{ctx[0]}[{ctx[1]}>{b}]{ctx[2]}"
            out[label] = out.get(label, 0.0) + float(matrix[c, a])
    return out


register_rate(RateKind("linear", lambda k, width, corpora, groups, options: LinearRate(k, width), lambda r: {"beta": r.beta.tolist()}, _linear))
register_rate(RateKind("gbt", lambda k, width, corpora, groups, options: BoostedRate(k, width, len(corpora), **{"groups": groups} | options), _boosted_text, _boosted, ordinal=True))
register_observation(ObservationKind("sbs", 64, 3, _substitution_labels, sq.signature_matrix, cl.featurise))
