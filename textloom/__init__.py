"""Full-text search on Spark. The names of __all__ are loaded when first used, so that workers import no more than they need."""

from importlib import import_module

_HOMES = {
    "SearchIndex": "sources.index", "IndexFailure": "sources.index", "parse": "plans.query", "search": "operators.match", "search_many": "operators.match",
    "scores": "operators.score", "top": "operators.score", "explain": "operators.score", "highlight": "functions.highlight", "snippet": "functions.highlight", "register": "functions.registry", "ingest": "streaming.ingest",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOMES[name]}", __name__), name)
