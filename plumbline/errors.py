"""The error tree: every error has a message, details, suggestions and the error it wraps."""

from __future__ import annotations

import traceback


class EDAError(Exception):
    def __init__(self, message: str, details: dict | None = None, suggestions: list[str] | None = None, original: BaseException | None = None):
        super().__init__(message)
        self.message, self.details, self.suggestions, self.original = message, details or {}, suggestions or [], original

    def __str__(self) -> str:
        parts = [self.message]
        if self.details:
            parts.append("; ".join(f"{k}: {v}" for k, v in self.details.items()))
        parts += [f"try: {s}" for s in self.suggestions]
        return "\n".join(parts)


class DataError(EDAError):
    pass

class DataLoadingError(DataError):
    pass

class DataValidationError(DataError):
    pass

class InsufficientDataError(DataError):
    pass

class AnalysisError(EDAError):
    pass

class ConfigurationError(EDAError):
    pass

class InvalidConfigurationError(ConfigurationError):
    pass

class ReportGenerationError(EDAError):
    pass

class ResourceError(EDAError):
    pass

class DependencyError(ResourceError):
    pass



def format_error(error: BaseException, context: str | None = None, show_traceback: bool = False) -> str:
    text = f"{context}: {error}" if context else str(error)
    return text + ("\n" + "".join(traceback.format_exception(error)) if show_traceback else "")


def wrap_error(original: BaseException, kind: type[EDAError], message: str, **options) -> EDAError:
    return kind(message, original=original, **options)
