"""The corpus pipeline: five stages from raw documents to packed sequences.

The stages themselves are in plumbline.llm.pipeline.
"""

from plumbline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
