"""Parameters of the scaffolding engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScaffoldConfig:
    # Command-line parameters.
    mcs: int = 2000  # contigs below are short nodes
    mcr: int = 2000  # least contig length in the matching
    rcn: float = 1.5  # repeat factor over the mean coverage, for nodes
    rct: float = 1.5  # the same, in the matching
    lme: int = 100_000  # edges at least this long collect at most `few_paths` paths
    mit: int = 1_000_000  # path-search iterations for an edge
    nlm: int = 5  # distinct reads that save a suspicious edge
    mlp: int = 20_000  # least path length that makes a physical fragment
    k: int = 17  # minimizers: k-mer length, k-mers in a window, most postings of one
    w: int = 5
    f: int = 1000
    # Fixed constants of the semantics.
    read_length: int = 200
    link_sigmas: float = 2.5
    bundle_sigmas: int = 3
    min_bundle: int = 5
    reducible: int = 2000
    max_path_nodes: int = 80
    few_paths: int = 100
    many_paths: int = 1000
    tolerance: int = 4
    read_hits: int = 2
    min_gap: int = 20
    lqi_merge: int = 10
    consensus_reads: int = 20
    tile: int = 500
    end_bases: int = 500
    window_identity: float = 0.65
    min_window_query: int = 50
    poa: tuple[int, int, int] = (5, -4, -8)
    min_hit_identity: int = 75
    low_identity: int = 70
    trim_window: int = 30
    polish_overlap: int = 300
    chain_gap: int = 1000
    chain_anchors: int = 4
    chain_span: int = 200
    contig_fraction: float = 0.5
    novelty: int = 200
    singleton: int = 5000
    fasta_width: int = 60


DEFAULT = ScaffoldConfig()
