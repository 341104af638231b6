"""Errors that callers can branch on. None of them carries a personal value in its text."""


class InvalidPlaceCode(ValueError):
    """A code that has not 5 to 7 characters besides white space."""


class CodeError(KeyError):
    """A KeyError whose text is its message, without the quotes that KeyError puts around keys."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class UnknownPlaceCode(CodeError):
    """A code that the graph does not have."""


class LargeUserCode(CodeError):
    """A code of a single organisation: never an input, never an output."""


class MissingSubject(ValueError):
    """A row without a subject to key the draw by."""


class PriorError(ValueError):
    """Weights that the sampler cannot take."""


class GraphIntegrityError(ValueError):
    """A graph with isolated nodes or several components."""


class DirectorySchemaError(ValueError):
    """A directory file without the expected columns, or whose grid contradicts its coordinates."""


class ArtefactVersionError(ValueError):
    """A stored graph of another schema version."""


class UnknownTarget(ValueError):
    """A calibration target that does not exist."""


class NoRelease(LookupError):
    """A portal answer without a usable release."""


class RadiusTooSmall(UserWarning):
    """A radius that lets outputs land anywhere more often than asked for."""
