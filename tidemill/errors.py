"""What can go wrong, by class."""


class EngineError(Exception):
    """Any error of this engine."""

    sqlstate = "XX000"


class SqlError(EngineError):
    """A statement that can't be parsed, resolved or evaluated."""

    sqlstate = "42601"


class ConstraintError(EngineError):
    """NOT NULL, CHECK, UNIQUE, a primary key, a vector's dimension or a policy's check was violated."""

    sqlstate = "23000"


class ConflictError(EngineError):
    """Another commit changed what this one writes. Run the transaction again."""

    sqlstate = "40001"


class BusyError(ConflictError):
    """A version that can't be written, however often it is tried."""


class TransactionError(EngineError):
    """A statement that the state of the transaction doesn't allow."""

    sqlstate = "25000"


class StorageError(EngineError):
    """A store that can't be opened, read or written."""

    sqlstate = "58000"


class MisuseError(EngineError):
    """A call that the interface doesn't allow."""

    sqlstate = "HY000"
