"""Errors of the engine, one for each kind of refusal."""


class SearchError(Exception):
    """Base of all."""


class ValidationError(SearchError):
    """A schema, point or request that isn't well formed."""


class NotFound(SearchError):
    """No such collection."""


class AlreadyExists(SearchError):
    """A collection or point of that name is there already."""


class QuotaReached(SearchError):
    """A plan's limit would be exceeded."""
