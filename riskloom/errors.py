"""Exceptions."""


class RiskError(Exception):
    """Base of all errors raised here."""


class NotFittedError(RiskError):
    pass


class DataTypeError(RiskError, TypeError):
    pass


class ValidationError(RiskError, ValueError):
    pass


class ConfigurationError(RiskError, ValueError):
    pass


class FeatureError(RiskError, KeyError):
    pass
