"""SQL spelling of the truncated-Poisson draw (shared by the oracle)."""

from __future__ import annotations


def poisson_size_sql(u: str, npara: int) -> str:
    from sparkpairs.operators.chunking import poisson_cdf
    terms = " + ".join(f"({u} >= {c!r}::DOUBLE)::INTEGER" for c in poisson_cdf(npara))
    return f"(1 + {terms})" if terms else "1"
