"""Typed errors of the archive."""


class ArchiveError(Exception):
    """Base of all errors raised on purpose."""


class StoreFormatError(ArchiveError):
    """The store is corrupt, incompatible, edited by hand, or not a store."""


class StoreLockedError(ArchiveError):
    """The store lock could not be had in time."""


class ValidationError(ArchiveError, ValueError):
    """A bad argument, frame or column mapping."""


class IngestConflictError(ArchiveError):
    """A run that is already stored was given with other values."""


class OfficialConflictError(ArchiveError):
    """A target already has another official value."""


class PartialCommitError(ArchiveError):
    """The commit is visible, its bookkeeping is not finished; the next writer finishes it."""


class AuditLogError(ArchiveError):
    """The commit is visible, its audit lines are not written; the same call again writes them."""


class UnknownMetricError(ArchiveError, KeyError):
    """No metric of this name is registered."""


class SummaryMismatchError(ArchiveError):
    """The stored summary differs from its recomputation."""


class ReconcileUnsettledError(ArchiveError):
    """The store kept changing during reconciliation; try again."""
