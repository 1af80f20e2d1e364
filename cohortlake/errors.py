"""Errors of the front end; each carries a class and a code for API callers."""

from __future__ import annotations


class EngineError(Exception):
    kind = "run_time"

    def __init__(self, message: str, code: str = "general_error"):
        super().__init__(message)
        self.code = code

    def to_dict(self) -> dict:
        return {"error": {"class": self.kind, "code": self.code, "message": str(self)}}


class ParseError(EngineError):
    kind = "parse"


class AnalysisError(EngineError):
    kind = "analysis"


class ConfigError(EngineError):
    kind = "config"


class InsertError(EngineError):
    kind = "insert"


class QueryError(EngineError):
    kind = "query"
