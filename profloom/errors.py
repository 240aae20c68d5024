"""Errors of the engine."""


class ProfileException(Exception):
    """Base of all errors raised by this package."""


class NoInputDataException(ProfileException):
    """No input data was found."""


class DatatypeException(ProfileException):
    """A data type or format is unknown, missing or ambiguous."""


class SchemaException(ProfileException):
    """Schemas that must agree do not."""
