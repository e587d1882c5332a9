"""A stage runner: named stages in order, dry runs, stop on error, and a report (V7-V9)."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Config:
    """Settings; layers and the environment (KGLOOM_<NAME>) override, the later the stronger."""

    seed: int = 42
    shuffle_partitions: int = 0
    min_score: float = 0.0
    strict: bool = True

    def layered(self, *layers: dict[str, Any], environ: dict[str, str] | None = None) -> Config:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        env = os.environ if environ is None else environ
        own = {n: env[f"KGLOOM_{n.upper()}"] for n in kinds if f"KGLOOM_{n.upper()}" in env}
        merged: dict[str, Any] = {}
        for layer in (*layers, own):
            unknown = set(layer) - set(kinds)
            if unknown:
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            merged |= layer

        def cast(name, v):
            if kinds[name] is bool and isinstance(v, str):
                return v.strip().lower() in ("1", "true", "yes")
            return kinds[name](v)

        return replace(self, **{n: cast(n, v) for n, v in merged.items()})


@dataclass
class Run:
    """What a run did: (stage, status, seconds, detail) of each stage that was reached."""

    rows: list[tuple[str, str, float, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(r[1] != "failed" for r in self.rows)

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, status string, seconds double, detail string")


def run_stages(stages: list[tuple[str, Callable[[], Any]]], only: list[str] | None = None, dry: bool = False, go_on: bool = False) -> Run:
    """Runs the named stages in their order; a failure stops the run unless go_on."""
    unknown = set(only or ()) - {n for n, _ in stages}
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    run = Run()
    for name, stage in stages:
        if only and name not in only:
            continue
        if dry:
            run.rows.append((name, "planned", 0.0, ""))
            continue
        began = time.time()
        try:
            detail = stage()
            run.rows.append((name, "done", time.time() - began, "" if detail is None else str(detail)))
        except Exception as e:  # the report says what failed
            run.rows.append((name, "failed", time.time() - began, f"{type(e).__name__}: {e}"))
            if not go_on:
                break
    return run
