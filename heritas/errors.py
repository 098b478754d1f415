"""Errors of the engine: one base class and its thirteen kinds."""


class EngineError(Exception):
    """Base of all errors that users can act on."""


def _kind(name: str, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"__doc__": doc, "__module__": __name__})


FileNotFound = _kind("FileNotFound", "A file or folder doesn't exist.")
FileOpenError = _kind("FileOpenError", "A path can't be opened, or is a folder.")
FileFormatError = _kind("FileFormatError", "A file's layout, size or magic bytes are wrong.")
FileWriteError = _kind("FileWriteError", "A file can't be written.")
EmptyFile = _kind("EmptyFile", "A file has no content.")
HeaderError = _kind("HeaderError", "A table's header isn't the expected one.")
ColumnCountError = _kind("ColumnCountError", "A row has too few or too many columns.")
ParseError = _kind("ParseError", "A token isn't a value of its column's type.")
DataError = _kind("DataError", "Values contradict each other, or ids repeat.")
SampleMismatch = _kind("SampleMismatch", "Tables share no samples, or a sample is missing.")
InvalidArgument = _kind("InvalidArgument", "An argument is out of range or unknown.")
InvalidState = _kind("InvalidState", "A step was called at the wrong time.")
NumericalError = _kind("NumericalError", "A matrix isn't positive definite or a fit diverged.")

KINDS = [x for x in list(vars().values()) if isinstance(x, type) and issubclass(x, EngineError) and x is not EngineError]
