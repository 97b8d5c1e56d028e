"""Errors of the engine, told apart by whose fault they are."""


class EngineError(Exception):
    """Base of all errors that the engine raises itself."""


class NotFound(EngineError):
    """A dataset, variant, version or file that does not exist."""


class BadRequest(EngineError, ValueError):
    """A request that makes no sense for the table it names."""
