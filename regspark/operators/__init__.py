from regspark.operators import (
    aggregates,
    joins,
    merge,
    ranking,
    running,
    sampling,
    scan,
    stats,
    windows,
)

__all__ = ["aggregates", "joins", "merge", "ranking", "running", "sampling", "scan",
           "stats", "windows"]
