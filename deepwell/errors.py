"""What the library raises."""


class DeepwellError(Exception):
    pass


class InvalidInputError(DeepwellError, ValueError):
    pass


class InvalidFilterError(InvalidInputError):
    pass


class DimensionMismatchError(InvalidInputError):
    pass


class NotFoundError(DeepwellError, KeyError):
    pass


class IngestionError(DeepwellError):
    pass


class EvaluationError(DeepwellError, ValueError):
    pass


class ConfigurationError(DeepwellError, ValueError):
    pass


class LockedError(DeepwellError):
    pass


class VerificationError(DeepwellError):
    pass


class MissingDependencyError(DeepwellError, ImportError):
    pass


class CorruptStoreError(DeepwellError):
    pass
