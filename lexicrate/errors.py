"""Errors of the engine; all are ValueErrors."""


class EngineError(ValueError):
    pass


class TokenizerError(EngineError):
    """An analyzer that can't be built, such as one with an invalid pattern."""


class InvalidArgument(EngineError):
    pass


class DocumentNotFound(EngineError):
    """No document has this internal id."""


class ExternalIdNotFound(EngineError):
    """No document has this external id."""


class BadSnapshot(EngineError):
    """A folder that isn't a saved index."""


class UnsupportedVersion(EngineError):
    """A saved index of a format that this release doesn't read."""


class CorruptLog(EngineError):
    """An operation log with a damaged line that isn't its unfinished last one."""
