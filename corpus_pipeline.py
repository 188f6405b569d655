"""The corpus pipeline: documents to packed training sequences, a stage at a time."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
