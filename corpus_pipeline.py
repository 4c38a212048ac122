"""The corpus pipeline by its public name; the stages are in keelstone/llm/pipeline.py."""

from keelstone.llm.pipeline import ORACLE_SQL, STAGES, THRESHOLD, dedup_stage, packing_stage, pii_stage, quality_stage, run

__all__ = ["ORACLE_SQL", "STAGES", "THRESHOLD", "dedup_stage", "packing_stage", "pii_stage", "quality_stage", "run"]
