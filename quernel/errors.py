"""What the engine raises."""


class EngineError(Exception):
    """Any error of the engine; the message says what was wrong with the statement or call."""


class ParseError(EngineError):
    pass


class SchemaError(EngineError):
    pass


class ConflictError(EngineError):
    pass
