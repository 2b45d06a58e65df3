"""Marlstone: a PySpark-native corpus analytics engine."""

from importlib import import_module
from typing import Any

__version__ = "0.1.0"

#: What a user of the library works with, by the module that has it; loaded when first asked for.
_EXPORTS = {
    "marlstone.build": ("BuildError", "Outcome", "drift", "import_bundle"),
    "marlstone.explorer": ("Explorer", "Refused"),
    "marlstone.index": ("Index",),
    "marlstone.operators.ask": ("Policy", "answer", "answer_rag", "policy_for", "rag_answer"),
    "marlstone.operators.bundle": ("diff_revisions", "diff_trees", "manifest", "revision_id", "tree_diff", "trust_tier", "trust_warnings"),
    "marlstone.operators.chunks": ("chunks", "hashed_bow", "sparse_topk", "vector_topk"),
    "marlstone.operators.compile": ("compile_bundle",),
    "marlstone.operators.conversation": ("answers", "qa_pairs", "questions_of"),
    "marlstone.operators.graph": ("adjacency", "broken_links", "link_edges", "neighbours", "orphans", "related"),
    "marlstone.operators.lint": ("lint", "verdict"),
    "marlstone.operators.navigate": ("call_log", "candidates"),
    "marlstone.operators.search": ("block_rank", "bm25", "overlap_rank", "postings_blocks"),
    "marlstone.session": ("get_session", "table"),
    "marlstone.sources.connectors": ("Connector", "ConnectorError", "connect", "register"),
    "marlstone.sources.markdown": ("normalize", "parse_files"),
    "marlstone.store": ("Store",),
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = ["__version__", *sorted(_HOME)]


def __getattr__(name: str) -> Any:
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
