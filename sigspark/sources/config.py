"""The YAML design: samples, criteria and method."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml


@dataclass(frozen=True)
class Criteria:
    readcount_min: int = 15
    readcount_max: int = 1000


@dataclass(frozen=True)
class Method:
    max_iters: int = 500
    stopping_criteria: float = 1e-5
    pooling: bool = False
    prefilter: str | None = None
    threshold: float = 0.1


@dataclass(frozen=True)
class Design:
    #: {condition: {run label "condition-run": folder}}, in the file's order.
    data: dict[str, dict[str, str]]
    out: str
    prior: str | None = None
    criteria: Criteria = field(default_factory=Criteria)
    method: Method = field(default_factory=Method)

    @property
    def runs(self) -> dict[str, list[str]]:
        return {c: list(r) for c, r in self.data.items()}


def parse(spec: dict) -> Design:
    """A design of the parsed YAML; ValueError where it can't be used."""
    for key in ("data", "out"):
        if not spec.get(key):
            raise ValueError(f"the design needs {key}")
    if len(spec["data"]) < 2:
        raise ValueError("the design needs two conditions or more")
    if "priors" in spec:
        raise ValueError("priors can't be set")
    data = {str(c): {f"{c}-{r}": str(folder) for r, folder in runs.items()} for c, runs in spec["data"].items()}
    method = dict(spec.get("method") or {})
    pre = method.pop("prefiltering", None) or {}
    known = {"max_iters": int, "stopping_criteria": float, "pooling": bool}
    found = {k: kind(method[k]) for k, kind in known.items() if k in method}
    if found.get("max_iters", 500) < 2:
        raise ValueError("max_iters must be 2 or more")
    criteria = {k: int(v) for k, v in (spec.get("criteria") or {}).items() if k in ("readcount_min", "readcount_max")}
    return Design(data, str(spec["out"]), spec.get("prior"), Criteria(**criteria), Method(**found, prefilter=pre.get("method"), threshold=float(pre.get("threshold", 0.1))))


def load(path: str) -> Design:
    with open(path, encoding="utf-8") as file:
        return parse(yaml.safe_load(file))
