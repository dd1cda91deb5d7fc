"""evidentia: Spark-first analytics for document retrieval, evidence checking and corpus preparation.

The public surface: `session` (sessions, the shared folder, tables), `functions` (text, passages, html,
register), `operators`, `sources`, `streaming` and `plans`; `llm` is a package of its own.
"""

from .session import cut_lineage, local_session, shared_folder, table

__version__ = "0.1.0"
__all__ = ["cut_lineage", "local_session", "shared_folder", "table"]
