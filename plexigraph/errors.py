"""What a client can be told; the codes are part of the query interface."""

from __future__ import annotations


class GraphError(Exception):
    """Base of all errors; ``code`` names the return code."""

    code = "FAILED"


class AbortedError(GraphError):
    """A transaction broke a rule; nothing of it was applied."""

    code = "ABORT"


class TakenError(AbortedError):
    """Another writer was first with this commit number; the same transactions may be tried again."""


class ActiveTxError(GraphError):
    """A transaction is open already."""

    code = "ACTIVETX"


class NoActiveTxError(GraphError):
    """There is no open transaction."""

    code = "NOACTIVETX"


class NotFoundError(GraphError):
    """A start node, or a node or edge that was asked for, is not there."""

    code = "NOTFOUND"


class NoAuxIndexError(GraphError):
    """Aliases are switched off."""

    code = "NOAUXINDEX"


class WouldLoopError(GraphError):
    """An event order that was asked for contradicts an earlier one."""

    code = "WOULDLOOP"


class UnfinishedError(GraphError):
    """A loop reached the bound that its caller set, with work left."""


class LogicalError(GraphError):
    """The call itself makes no sense."""

    code = "LOGICALERROR"
