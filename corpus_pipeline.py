"""The corpus pipeline: language, near duplicates, decontamination, secrets, mixing. The stages are in pointloom.llm.pipeline."""

from pointloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
