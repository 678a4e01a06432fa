"""The registry of analyzers: functions from files to facts, gated by profile, each with an order that decides first-wins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tracewright.operators import extract
from tracewright.operators.graph import kept

PROFILES = ("quick", "deep", "security", "maximum")


@dataclass(frozen=True)
class Provider:
    """An engine's name, the profiles it runs in, and its function of a files table."""

    engine: str
    profiles: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self):
        self.known: dict[str, Provider] = {}

    def add(self, provider: Provider) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9-]{1,63}", provider.engine) or provider.engine in self.known:
            raise ValueError(f"engine name {provider.engine!r} is malformed or taken")
        if not set(provider.profiles) <= set(PROFILES):
            raise ValueError(f"profiles are {PROFILES}")
        self.known[provider.engine] = provider

    def facts(self, files: DataFrame, profile: str) -> DataFrame | None:
        """All facts of the profile's engines with engine, engine_ord, fact_ord (by path and line) and status."""
        out = None
        for ordinal, p in enumerate(self.known.values()):
            if profile not in p.profiles:
                continue
            found = p.run(files).withColumns({"engine": F.lit(p.engine), "engine_ord": F.lit(ordinal), "status": F.lit("success"), "fact_ord": F.xxhash64("path", "start_line", "name")})
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        return out


def default_registry(mentioned: bool = True) -> Registry:
    """The engine of this library; without ``mentioned`` it gives what files declare only, and looks for no relationships."""
    find = extract.symbols if mentioned else extract.declared
    registry = Registry()
    registry.add(Provider("native", PROFILES, lambda files: find(kept(extract.numbered(files))).withColumns({"documentation": F.lit(False)})))
    return registry
