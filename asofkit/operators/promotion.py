"""Deciding on a candidate model, freezing the decision, and checking figures against it."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame


def decide(candidate: Mapping[str, float], base: Mapping[str, float], gates: Mapping[str, float]) -> tuple[str, dict[str, bool]]:
    """PROMOTE if every gated metric gains at least its gate, else REJECT; with each gate's outcome. A metric that is missing fails."""
    passed = {m: m in candidate and m in base and candidate[m] - base[m] >= least for m, least in gates.items()}
    return ("PROMOTE" if passed and all(passed.values()) else "REJECT"), passed


def digest(document: Any) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def freeze(document: Mapping[str, Any]) -> dict[str, Any]:
    """The document with the digest of its content."""
    return {**document, "sha256": digest({k: v for k, v in document.items() if k != "sha256"})}


def verify(frozen: Mapping[str, Any]) -> None:
    if frozen.get("sha256") != digest({k: v for k, v in frozen.items() if k != "sha256"}):
        raise ValueError("the document is not what was frozen")


def require_metrics(got: Mapping[str, float], want: Mapping[str, float], tolerance: float) -> None:
    """Whole numbers must be equal, others within tolerance."""
    off = {}
    for k, w in want.items():
        g = got.get(k)
        same = g is not None and (g == w if isinstance(w, int) else math.isclose(g, w, rel_tol=0, abs_tol=tolerance))
        if not same:
            off[k] = (g, w)
    if off:
        raise ValueError(f"metrics that differ: {off}")


def ablation(sets: Mapping[str, list[str]], windows: Mapping[str, tuple[DataFrame, DataFrame]], run: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> DataFrame:
    """run(train, test, columns) for each feature set and window, as one frame with the names of both."""
    from pyspark.sql import functions as F

    parts = [run(train, test, list(dict.fromkeys(cols))).withColumns({"features": F.lit(s), "window": F.lit(w)}) for s, cols in sets.items() for w, (train, test) in windows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
