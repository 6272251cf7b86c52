"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, katz, licenses, mixing, mjpeg, near_dedup, packing, secrets, tokens, toxicity

MODULES = [katz, exact_dedup, mixing, tokens, toxicity, mjpeg, near_dedup, packing, secrets, licenses]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: f for m in MODULES for k, f in m.ORACLE.items()}
