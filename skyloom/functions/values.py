"""Attributes as JSON: numbers and arrays of numpy, complex numbers and cosmologies come back as they were."""

from __future__ import annotations

import dataclasses
import json

import numpy as np

from skyloom.functions.cosmology import Cosmology


def _plain(v):
    if isinstance(v, complex) and not isinstance(v, np.generic):
        return {"complex": [v.real, v.imag]}
    if isinstance(v, np.generic):
        return _plain(v.item())
    if isinstance(v, np.ndarray):
        flat = v.ravel()
        return {"array": [[x.real, x.imag] for x in flat.tolist()] if v.dtype.kind == "c" else flat.tolist(), "kind": v.dtype.str, "shape": list(v.shape)}
    if isinstance(v, Cosmology):
        return {"cosmology": dataclasses.asdict(v) if dataclasses.is_dataclass(v) else vars(v)}
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _back(d: dict):
    if d.keys() == {"complex"}:
        return complex(*d["complex"])
    if d.keys() == {"array", "kind", "shape"}:
        values = [complex(*x) for x in d["array"]] if np.dtype(d["kind"]).kind == "c" else d["array"]
        return np.array(values, d["kind"]).reshape(d["shape"])
    return Cosmology(**d["cosmology"]) if d.keys() == {"cosmology"} else d


def dumps(value) -> str:
    return json.dumps(_plain(value))


def loads(text: str):
    return json.loads(text, object_hook=_back)
