"""Error codes of a build, as status values and as exceptions."""

from __future__ import annotations

import socket

#: Status values in order of declaration (fixed values of the public behaviour); the last one is for
#: strategies in Python that raise something else than a ``ContextError``.
CODES = (
    "BUDGET_EXCEEDED", "INVALID_CONFIG", "TOKEN_COUNT_FAILED", "INVALID_CHARS_PER_TOKEN", "NIL_STRATEGY",
    "STRATEGY_EXCEEDED_BUDGET", "FORMATTER_EXCEEDED_BUDGET", "BLOCK_TOO_LARGE", "BLOCK_NOT_FOUND",
    "INVALID_THREAD_CONFIG", "HISTORY_VERSION_CONFLICT", "UNAVAILABLE",
    "STRATEGY_FAILED",
)


class ContextError(Exception):
    """Raised with one of ``CODES``; ``block`` names the block concerned, if any."""

    def __init__(self, code: str, message: str = "", block: str | None = None):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        self.code, self.block = code, block
        where = f'block "{block}": ' if block else ""
        super().__init__(f"{where}{code}{': ' + message if message else ''}")


class Cancelled(Exception):
    """The caller gave up; never classified as a failure of the store."""


def classify(error: BaseException | None) -> BaseException | None:
    """What a store's failure means to a caller that may retry.

    Conflicts and cancellations stay as they are; deadlines, timeouts and network failures become
    ``UNAVAILABLE``; anything else stays plain.
    """
    if error is None or isinstance(error, (ContextError, Cancelled)):
        return error
    if isinstance(error, (TimeoutError, ConnectionError, socket.timeout, socket.gaierror)):
        wrapped = ContextError("UNAVAILABLE", str(error))
        wrapped.__cause__ = error
        return wrapped
    return error
