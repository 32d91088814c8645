"""Filters of many requests checked at once against the metadata of a batch of chunks."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The predicate of a request without filters.
ANY = "[]"


@dataclass(frozen=True)
class _Key:
    """The predicates that name a key: ``owner[starts[i]:starts[i + 1]]`` allow ``values[i]``."""

    name: str
    bound: np.ndarray
    values: pa.Array
    starts: np.ndarray
    owner: np.ndarray


@dataclass(frozen=True)
class Masks:
    """Predicates as in ``requests.predicates_of``: values of a key are alternatives, keys must all be met."""

    size: int
    never: np.ndarray
    keys: list[_Key]

    def met(self, metadata: pa.Array) -> np.ndarray:
        """Predicates by rows of ``metadata`` (maps of strings)."""
        out = np.ones((self.size, len(metadata)), dtype=bool)
        out[self.never] = False
        for key in self.keys:
            at = pc.fill_null(pc.index_in(pc.map_lookup(metadata, key.name, "first"), key.values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.flatnonzero(at >= 0)
            low, many = key.starts[at[known]], np.diff(key.starts)[at[known]]
            places = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            fits = np.zeros_like(out)
            fits[key.owner[places], np.repeat(known, many)] = True
            out[key.bound] &= fits[key.bound]
        return out


def compile_masks(predicates: list[str]) -> Masks:
    """One mask for each of the different ``predicates``; a filter without key or value is met by nothing."""
    allowed: dict[str, set[tuple[str, int]]] = {}
    bound: dict[str, set[int]] = {}
    never = []
    for number, predicate in enumerate(predicates):
        rows = json.loads(predicate)
        named = [r for r in rows if r.get("key") is not None]
        if predicate != ANY and not named:
            never.append(number)
        for row in named:
            bound.setdefault(row["key"], set()).add(number)
            if row.get("value") is not None:
                allowed.setdefault(row["key"], set()).add((row["value"], number))
    keys = []
    for name, owners in bound.items():
        pairs = sorted(allowed.get(name, ()))
        values = sorted({v for v, _ in pairs})
        place = {v: i for i, v in enumerate(values)}
        starts = np.searchsorted([place[v] for v, _ in pairs], np.arange(len(values) + 1))
        keys.append(_Key(name, np.array(sorted(owners)), pa.array(values, pa.string()), starts, np.array([n for _, n in pairs], dtype=np.int64)))
    return Masks(len(predicates), np.array(never, dtype=np.int64), keys)
