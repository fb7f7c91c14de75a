"""Pipeline stages over documents."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
