"""What a caller may be refused with."""


class EngineError(Exception):
    pass


class Forbidden(EngineError):
    pass


class NotFound(EngineError):
    pass


class UnknownType(NotFound):
    pass


class UnknownLink(NotFound):
    pass


class AmbiguousLink(EngineError):
    pass


class BadFilter(EngineError):
    pass


class BadPagination(EngineError):
    pass


class BadChain(EngineError):
    pass


class BadGraphPath(EngineError):
    pass


class NotCyclicPath(BadGraphPath):
    pass


class NoIdentity(EngineError):
    pass


class AsOfNotFound(NotFound):
    pass


class Gone(EngineError):
    pass


class Conflict(EngineError):
    pass


class Validation(EngineError):
    """Carries all violations found."""

    def __init__(self, *violations: str):
        super().__init__("; ".join(violations))
        self.violations = list(violations)


class ResourceExhausted(EngineError):
    pass


class NoIndex(NotFound):
    pass


class DimensionMismatch(EngineError):
    pass
