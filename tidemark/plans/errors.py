"""Errors of configuration."""


class ConfigError(ValueError):
    """A configuration that can't be read or is wrong."""


class DecisionRequired(ConfigError):
    """A business rule that someone has to decide; there is no default."""
