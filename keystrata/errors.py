"""Errors that callers see."""


class SqlError(Exception):
    """Anything wrong with a statement: lexing, grammar, binding, or execution."""


class TransactionError(Exception):
    """A transaction that is unknown or has ended."""


class ConflictError(TransactionError):
    """A commit lost against another transaction; nothing of it was kept."""
