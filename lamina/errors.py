"""Errors of stripe tables."""


class StripeError(Exception):
    """Base of them all."""


class NotAStripeTable(StripeError):
    pass


class UnsupportedType(StripeError):
    pass


class CommitConflict(StripeError):
    """Another writer published the version that this one wanted, more often than was retried."""


class DuplicateKey(StripeError):
    pass


class MultipleMatches(StripeError):
    """An UPDATE ... FROM has several source rows for one target row."""


class UnsafeStore(StripeError):
    """The store can't publish a file under a name that must be free, so that two writers could lose a commit."""
