"""Errors that a caller may expect."""


class ConfigError(ValueError):
    """A setting is unknown or has a value that isn't allowed."""


class DatasetError(ValueError):
    """A table doesn't have the columns or values that are needed."""


class DesignMatrixError(ValueError):
    """The design has no unique least-squares solution."""


class ModelFileError(ValueError):
    """A file isn't a saved model."""


class MissingDependencyError(ImportError):
    """An optional library isn't installed."""
