"""Errors with actionable messages."""


class DataValidationError(ValueError):
    """Input tables cannot be found or brought into the expected schema."""


class ModelNotFoundError(FileNotFoundError):
    """A saved model table is missing."""


class EmptyInputError(ValueError):
    """There is nothing to classify."""


class SharedFolderError(ValueError):
    """The session names no folder that all executors share."""
