"""Errors by phase: syntax, type (while compiling), run time (raised in the job)."""


class PathError(Exception):
    phase = "error"

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} (at {at})")
        self.message, self.at = message, at


class PathSyntaxError(PathError):
    phase = "syntax"


class PathTypeError(PathError):
    phase = "type"


class PathRuntimeError(PathError):
    phase = "runtime"


#: Begins the message of errors that a running job raises.
RUNTIME = "PATH-RUNTIME: "
