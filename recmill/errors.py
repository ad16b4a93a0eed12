"""Errors and warnings of the engine."""


class DataError(ValueError):
    """Data break a rule of their dataset."""


class FieldError(KeyError):
    """A class has no such attribute or field."""


class ConfigError(ValueError):
    """A setting is missing or cannot be used."""


class DataWarning(UserWarning):
    """Data look unusual but can be used."""


class ConfigWarning(UserWarning):
    """A configuration is unusual but can be used."""
