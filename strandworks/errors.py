"""Driver-side errors; failures of single rows are values in an ``error`` column."""


class InitError(ValueError):
    """An object cannot be made from its input."""


class ConfigError(ValueError):
    """A setting is missing or malformed."""


class MissingData(ValueError):
    """Something that must be there is not."""


class AmbiguousData(ValueError):
    """Something that must be unique is not."""


class AmbiguousMapping(AmbiguousData):
    """A mapping has several targets."""


class NoOverlap(ValueError):
    """Two segments share no position."""


class OverlapError(ValueError):
    """Two segments share a position and must not."""


class FormatError(ValueError):
    """A text is not in its format."""


class ParsingError(FormatError):
    """A text cannot be parsed."""


class FailedCalculation(RuntimeError):
    """A variable cannot be computed for an object."""


class LengthMismatch(ValueError):
    """Lengths that must agree do not."""
