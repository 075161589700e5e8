"""Pipelines: a list of steps from DataFrame to DataFrame, declared once and run on tables or, where all steps allow it, on streams.

Neighbouring column steps add up to one projection in Catalyst.  Neighbouring kernels with the same key run in one pass: `Chain` is a kernel made of kernels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..operators.kernels import Kernel
from ..operators.runtime import run_batch
from ..streaming.runner import run_stream
from .stream import StreamSpec


class Chain(Kernel):
    """The score of each kernel is the next one's row; the last score comes out."""

    def __init__(self, kernels: Sequence[Kernel]):
        self.kernels = list(kernels)

    def fresh(self, key_hash: int = 0) -> "Chain":
        out = super().fresh(key_hash)
        out.kernels = [k.fresh(key_hash) for k in self.kernels]
        return out

    def step(self, x, y=None):
        for k in self.kernels:
            score = k.next(x, y)
            x = np.array([np.nan if score is None else score])
        return score


@dataclass
class Columns:
    """A step of column expressions or windows."""

    apply: Callable[[DataFrame], DataFrame]


@dataclass
class Sequential:
    """A kernel step on a column."""

    kernel: Kernel
    value: str | None = None
    features: str | None = None
    out: str = "score"


@dataclass
class Pipeline:
    spec: StreamSpec
    steps: list = field(default_factory=list)

    def fused(self) -> list:
        """Kernels that read what the kernel before them writes become one step."""
        out: list = []
        for s in self.steps:
            last = out[-1] if out else None
            if isinstance(s, Sequential) and isinstance(last, Sequential) and s.value == last.out and s.out == last.out:
                kernels = [*(last.kernel.kernels if isinstance(last.kernel, Chain) else [last.kernel]), s.kernel]
                out[-1] = Sequential(Chain(kernels), last.value, last.features, s.out)
            else:
                out.append(s)
        return out

    def run(self, df: DataFrame, event_time: str | None = None) -> DataFrame:
        for s in self.fused():
            if isinstance(s, Columns):
                df = s.apply(df)
            elif df.isStreaming:
                df = run_stream(df, self.spec, s.kernel, s.value, s.features, s.out, event_time)
            else:
                df = run_batch(df, self.spec, s.kernel, s.value, s.features, out=s.out)
        return df
