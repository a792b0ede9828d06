"""Corpus pipeline: documents in, token ids of the kept and mixed documents out.

The stages are functions of :mod:`tarnfell.llm.pipeline`; see there.
"""

from tarnfell.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
