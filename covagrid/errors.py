"""What can go wrong, by kind."""


class PileupError(Exception):
    """Base of all errors of this package."""


class SourceNotFound(PileupError, FileNotFoundError):
    pass


class BadRegion(PileupError, ValueError):
    """A region string that can't be read, or that names no reference."""


class BadParameter(PileupError, ValueError):
    pass


class UnsortedInput(PileupError):
    pass


class BadRecord(PileupError, ValueError):
    """An alignment record or header that breaks its format."""
