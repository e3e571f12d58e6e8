"""The corpus pipeline's stages, their SQL and the whole run; see tessera/llm/pipeline.py."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
