"""Run parameters, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults that results depend on."""

    min_overlap: int = 1000
    allele_frequency: float = 0.2
    split_allele_frequency: float = 0.3
    min_alt: int = 3
    cluster_divergence: float = 0.0
    min_mapq: int = 20
    max_divergence: float = 0.05
    max_clipping: int = 100
    end_gap: int = 500
    tip_reads: int = 2
    min_community: int = 3
    min_final_size: int = 6
    depth_ratio: float = 1.6
    max_hops: int = 10
    min_depth: int = 20
    max_depth: int = 500
    min_length: int = 1000
    split_length: int = 50_000
    gap_limit: int = 1500
    report_window: int = 100
    min_divergence: float = 1e-5
    min_parent_depth: int = 6
    min_cluster_share: float = 0.05
    min_consensus_depth: int = 5

    @classmethod
    def of_mode(cls, mode: str) -> Config:
        """Defaults for accurate ("hifi") or noisy ("nano") reads."""
        if mode not in _MODES:
            raise ValueError(f"no such mode: {mode}")
        divergence, depth = _MODES[mode]
        return cls(max_divergence=divergence, min_consensus_depth=depth)


#: Highest divergence of an alignment and lowest depth of a consensus, by kind of read.
_MODES = {"hifi": (0.05, 3), "nano": (0.10, 5)}
