"""What can go wrong, by kind."""


class EngineError(Exception):
    """Any refusal of the engine."""


class ParseError(EngineError):
    pass


class Unsupported(EngineError):
    pass


class CatalogError(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class ConstraintError(EngineError):
    pass


class BindError(EngineError):
    pass


class StaleError(EngineError):
    pass


class StorageError(EngineError):
    pass


class ConflictError(EngineError):
    pass


class TransactionError(EngineError):
    pass


class IndexRequired(EngineError):
    pass
