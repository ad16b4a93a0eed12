"""Seeds: combining them, and one that holds for a whole process."""

from __future__ import annotations

import hashlib
import random
import tomllib
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np

_held: list[int] = []


def _words(key) -> list[int]:
    if isinstance(key, bool) or key is None:
        raise TypeError("seeds are integers, texts, UUIDs or sequences of them")
    if isinstance(key, int | np.integer):
        return [int(key)]
    if isinstance(key, uuid.UUID):
        return [key.int]
    if isinstance(key, str | bytes):
        return [int.from_bytes(hashlib.md5(key.encode() if isinstance(key, str) else key).digest(), "big")]
    if isinstance(key, np.random.SeedSequence):
        return np.atleast_1d(key.entropy).tolist()
    if isinstance(key, Sequence | np.ndarray):
        return [w for k in key for w in _words(k)]
    raise TypeError(f"no seed: {key!r}")


def make_seed(*keys) -> np.random.SeedSequence:
    """One seed from integers, texts (by md5), UUIDs and sequences of them."""
    return np.random.SeedSequence([w & (2**128 - 1) for k in keys for w in _words(k)])


def seed_number(*keys) -> int:
    """A 63-bit integer of :func:`make_seed`, for expressions."""
    return int(make_seed(*keys).generate_state(1, np.uint64)[0] >> np.uint64(1))


def init_global_seed(seed, seed_stdlib: bool = True, seed_numpy: bool = True) -> int:
    """Set the seed that everything uses which is not given one."""
    n = seed_number(seed)
    _held[:] = [n]
    if seed_stdlib:
        random.seed(n)
    if seed_numpy:
        np.random.seed(n % 2**32)
    return n


def global_seed(given=None) -> int:
    """``given`` as a number, else the global seed, else 0."""
    return seed_number(given) if given is not None else _held[0] if _held else 0


def query_seeds(spec) -> Callable[[object], str]:
    """From a seed, "user" or (seed, "user"): the seed of a query. With "user" the same user always draws the same."""
    fixed, by_user = (spec[0], True) if isinstance(spec, tuple | list) and len(spec) == 2 and spec[1] == "user" else (None, True) if spec == "user" else (spec, False)
    base = str(global_seed(fixed))
    return (lambda user: f"{base}|{user}") if by_user else (lambda user: base)


def load_seed(file: str, key: str = "random.seed") -> np.random.SeedSequence:
    """The seed under a dotted key of a TOML file."""
    value = tomllib.loads(Path(file).read_text())
    for part in key.split("."):
        value = value[part]
    return make_seed(value)
