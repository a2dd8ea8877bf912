"""Options of a run, with the defaults that the pipeline's users know."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    min_length: int = 500
    min_bundle: int = 3
    repeats: bool = True
    centrality_min: int = 50
    centrality_rounds: int = 3
    strategy: str = "bsize"
    text_compat: bool = False
    keep: bool = False
    tables: str | None = None  # a folder that keeps each stage's table: a run begins after the stages found whole there
