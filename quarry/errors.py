"""One hierarchy of errors."""


class QuarryError(Exception):
    """Base of every error that the engine raises on purpose."""


class ParseError(QuarryError):
    """A statement that cannot be read or names what does not exist."""


class ConstraintError(QuarryError):
    """Rows that break a type, NOT NULL, key or vector rule."""


class TransactionConflict(QuarryError):
    """Another commit came first."""


class MemoryValidationError(QuarryError):
    """A memory request outside its bounds."""


class PromptPlanningError(QuarryError):
    """A request that cannot become safe SQL, or an approval that does not fit."""


class IdentityError(QuarryError):
    """A credential or role that is not valid."""
