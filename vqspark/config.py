"""Settings of a product quantizer."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PQConfig:
    """M sub-spaces of K centroids each over vectors of ``dim`` numbers.

    ``domain`` is ``"float"`` or ``"int"``; the latter maps each number to a
    whole one first, so that distances are exact in any engine.
    """

    m: int = 8
    k: int = 256
    dim: int = 64
    domain: str = "float"
    seed: int = 0
    iterations: int = 20

    def __post_init__(self):
        if self.m < 1 or self.k < 1 or self.dim < 1:
            raise ValueError("m, k and dim must be positive")
        if self.domain not in ("float", "int"):
            raise ValueError("domain is float or int")

    @property
    def padded(self) -> int:
        return -(-self.dim // self.m) * self.m

    @property
    def sub(self) -> int:
        return self.padded // self.m
