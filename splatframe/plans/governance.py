"""Limits, budgets, checked arithmetic, errors and backends: driver-side admission before a plan is made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

GIB, MIB = 1 << 30, 1 << 20

# Exit codes by class of error, and limits by profile.
EXIT_CODES = {"ok": 0, "argument": 2, "data": 3, "unsupported": 4, "io": 5, "resource": 6, "backend": 7, "internal": 8, "cancelled": 130}  # fmt: skip # noqa: E501
PROFILES = {
    "web": {"splats": 8_000_000, "triangles": 16_000_000, "input_bytes": 2 * GIB, "decoded_bytes": 2 * GIB, "memory_bytes": 1 * GIB, "temp_bytes": 2 * GIB, "ratio": 100, "nodes": 100_000, "header_bytes": 1 * MIB, "depth": 64, "deadline_s": 60},  # fmt: skip # noqa: E501
    "desktop": {"splats": 25_000_000, "triangles": 50_000_000, "input_bytes": 4 * GIB, "decoded_bytes": 8 * GIB, "memory_bytes": 4 * GIB, "temp_bytes": 16 * GIB, "ratio": 1000, "nodes": 1_000_000, "header_bytes": 4 * MIB, "depth": 64, "deadline_s": None},  # fmt: skip # noqa: E501
    "server": {"splats": 150_000_000, "triangles": 300_000_000, "input_bytes": 32 * GIB, "decoded_bytes": 64 * GIB, "memory_bytes": 16 * GIB, "temp_bytes": 128 * GIB, "ratio": 1000, "nodes": 5_000_000, "header_bytes": 16 * MIB, "depth": 256, "deadline_s": None},  # fmt: skip # noqa: E501
}


class SplatError(ValueError):
    """An error with a stable code, its class and context."""

    def __init__(self, code: str, message: str = "", kind: str = "data", **context):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.kind, self.context = code, kind, context

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.kind]


U64 = (1 << 64) - 1
#: Beyond these, sums over rows could leave 64 bits, or a plan could no longer be walked.
CEILINGS = {"splats": 1 << 40, "triangles": 1 << 40, "depth": 4096, "ratio": 1 << 20}


def limits(profile: str = "server", **changes) -> dict:
    """A profile's limits with changes, checked: known, positive (0 is not unlimited), under their ceilings, and decoded
    bytes not below input bytes."""
    if profile not in PROFILES:
        raise SplatError("MK0101", f"unknown profile {profile}", "argument")
    out = PROFILES[profile] | changes
    for name, value in out.items():
        if name not in PROFILES[profile] or value is None and PROFILES[profile][name] is not None or value is not None and value <= 0:
            raise SplatError("MK0102", name, "argument")
        if value is not None and value > CEILINGS.get(name, U64):
            raise SplatError("MK0203", name, "argument", requested=value, ceiling=CEILINGS.get(name, U64))
    if out["decoded_bytes"] < out["input_bytes"]:
        raise SplatError("MK0103", "decoded_bytes", "argument")
    return out


def checked_add(a: int, b: int, what: str = "") -> int:
    if a + b > U64:
        raise SplatError("MK0104", what, "resource")
    return a + b


def checked_mul(a: int, b: int, what: str = "") -> int:
    if a * b > U64:
        raise SplatError("MK0104", what, "resource")
    return a * b


def checked_sub(a: int, b: int, what: str = "") -> int:
    if b > a:
        raise SplatError("MK0104", what, "resource")
    return a - b


def checked_range(offset: int, length: int, total: int, what: str = "") -> tuple[int, int]:
    """(first, end) of a byte range that lies within total."""
    end = checked_add(offset, length, what)
    if end > total:
        raise SplatError("MK0105", what, "data")
    return offset, end


@dataclass
class Budget:
    """A ledger of resource kinds against limits; a limit of 0 is none at this layer."""

    limits: dict[str, int]
    used: dict[str, int] = field(default_factory=dict)

    def consume(self, kind: str, amount: int, operation: str = "") -> None:
        total = checked_add(self.used.get(kind, 0), amount, operation)
        most = self.limits.get(kind, 0)
        if most and total > most:
            raise SplatError("MK0601", f"{operation}: {kind}", "resource", used=total, limit=most)
        self.used[kind] = total

    def release(self, kind: str, amount: int) -> None:
        self.used[kind] = checked_sub(self.used.get(kind, 0), amount, kind)

    def remaining(self, kind: str) -> int | None:
        most = self.limits.get(kind, 0)
        return most - self.used.get(kind, 0) if most else None

    def check_ratio(self, compressed: int, declared: int, operation: str = "") -> None:
        """Declared decoded bytes against compressed ones, without a division."""
        ratio = self.limits.get("ratio", 0)
        if ratio and declared > checked_mul(compressed, ratio, operation):
            raise SplatError("MK0602", operation, "resource")


#: What each format can do.
CAPABILITIES = {
    "ply": {"read": True, "write": True, "max_degree": 3, "compressed": False},
    "glb": {"read": True, "write": True, "max_degree": 3, "compressed": False},
    "gltf": {"read": True, "write": False, "max_degree": 3, "compressed": False},
    "spz": {"read": True, "write": True, "max_degree": 3, "compressed": True},
    "splat": {"read": True, "write": True, "max_degree": 0, "compressed": False},
}

_BACKENDS: dict[str, tuple[int, Callable]] = {}


def register_backend(name: str, make: Callable, rank: int = 0) -> None:
    _BACKENDS[name] = (rank, make)


def has_backend(name: str) -> bool:
    return name in _BACKENDS


def create_backend(name: str | None = None):
    """The backend of that name, or the best registered one."""
    if name is None:
        if not _BACKENDS:
            raise SplatError("MK0701", "no backend", "backend")
        name = max(_BACKENDS, key=lambda n: (_BACKENDS[n][0], n))
    if name not in _BACKENDS:
        raise SplatError("MK0702", name, "backend")
    return _BACKENDS[name][1]()


register_backend("expressions", lambda: __import__("splatframe.functions", fromlist=["functions"]), 1)
