"""The corpus pipeline over the table of documents: language ID, near-duplicates, suffixes, decontamination, tokens."""

from vidcohort.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
