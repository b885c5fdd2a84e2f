"""Choice of a backend: hint, then environment, then what the program needs, then the configured default."""

from __future__ import annotations

import os
from types import ModuleType

from .. import reasons as R
from ..config import ENV_QUERY_BACKEND, config
from . import relational_backend, sparql_backend

BACKENDS: dict[str, ModuleType] = {"sparql": sparql_backend, "relational": relational_backend}


def register(name: str, backend: ModuleType) -> None:
    BACKENDS[name] = backend


def pick(ir: list, hint=None, needs: dict | tuple | None = None):
    """A backend, or a refusal. hint: a name or a backend; needs: capabilities that must be there (or have the value given)."""
    if hint is not None and not isinstance(hint, str):
        return hint
    name = hint or os.environ.get(ENV_QUERY_BACKEND)
    wanted = needs if isinstance(needs, dict) else dict.fromkeys(needs or (), True)

    def lacking(backend) -> list[str]:
        have = backend.CAPABILITIES
        return [k for k, v in wanted.items() if not have.get(k) or v is not True and have.get(k) != v]

    if name:
        if name not in BACKENDS:
            return R.refused(R.UNKNOWN_BACKEND, f"unknown backend {name!r}; known: {sorted(BACKENDS)}")
        if missing := lacking(BACKENDS[name]):
            return R.refused(R.BACKEND_MISSING_CAPABILITY, f"{name} lacks {missing}", missing=missing, available_backends=[n for n, b in BACKENDS.items() if not lacking(b)])
        return BACKENDS[name]
    default = config.query_backend
    for name in dict.fromkeys([default, *BACKENDS]):
        backend = BACKENDS.get(name)
        if backend is not None and not lacking(backend) and backend.supports(ir):
            return backend
    return R.refused(R.BACKEND_MISSING_CAPABILITY, f"no backend has {sorted(wanted)}", missing=sorted(wanted), available_backends=[])
