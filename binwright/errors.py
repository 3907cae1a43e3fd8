"""Errors raised before or after a job; row-level faults are reported as DataFrames instead."""


class FilterError(ValueError):
    """A filter map is malformed or does not fit the schema of the table it is applied to."""


class DataValidationError(ValueError):
    """Input rows break the declared schema.

    ``errors`` lists the faults, the first of them if there are very many; ``faults`` is then the DataFrame of all.
    """

    def __init__(self, errors, faults=None):
        self.faults = faults
        self.errors = [errors] if isinstance(errors, str) else list(errors)
        super().__init__("; ".join(self.errors))


class EmptySelectionError(ValueError):
    """No cell matches the filters of an extract."""


class IngestError(RuntimeError):
    """Some staged inputs were not committed. ``faults`` is the DataFrame that says why."""

    def __init__(self, message, faults=None):
        self.faults = faults
        super().__init__(message)
