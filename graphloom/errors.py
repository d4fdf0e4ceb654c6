"""What the engine raises."""


class EngineError(Exception):
    """Base of all of them."""


class StoreError(EngineError):
    """A table breaks its keys, or a store is used out of order."""


class StoreNotFoundError(StoreError):
    """No complete snapshot is there."""


class InvalidContextError(EngineError):
    """An unknown mode of rendering."""


class ArtifactError(EngineError):
    """An artifact is missing, unreadable or of a newer format."""


class InvalidNameError(EngineError, ValueError):
    """A qualified name is asked for with an empty path, name or parent."""
