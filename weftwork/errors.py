"""The errors that users meet."""


class WeftError(ValueError):
    """Anything wrong with what a user gave."""


class SchemaError(WeftError):
    """A schema that can't be generated or checked."""


class FormulaError(SchemaError):
    """A formula that isn't allowed or has no type."""


class LoadError(WeftError):
    """Files that can't be read as tables."""


class ExportError(WeftError):
    """Tables that can't be written as asked."""


class ReplayMiss(WeftError):
    """A request that the cassette has no answer for."""


class MissingKey(WeftError):
    """A live client without its key or address."""
