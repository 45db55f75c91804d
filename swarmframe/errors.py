"""Errors by the part of a model they concern."""


class SwarmError(Exception):
    """Any error of this package."""


class ModelError(SwarmError):
    """A definition that cannot stand: names, types, states, mappings."""


class LayerError(ModelError):
    """Functions that must not share a layer."""


class MessageError(ModelError):
    """Bounds, radius, dimensions or index of a message list."""


class EnvironmentError_(SwarmError):
    """A property that is unknown, constant or of another length."""


class GraphError(SwarmError):
    """Vertices or edges that do not form a graph."""


class IdCollision(SwarmError):
    """Two agents with one id."""


class EnsembleError(SwarmError):
    """Runs that failed."""


class StateIOError(SwarmError):
    """A file that cannot be read or written as asked."""


class TranslationError(SwarmError):
    """Python source that has no column expression."""
