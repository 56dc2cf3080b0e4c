"""Errors with a code."""

from __future__ import annotations

from enum import Enum


class ErrorCode(Enum):
    NOT_FOUND = "not found"
    ALREADY_EXISTS = "already exists"
    INVALID_ARGUMENT = "invalid argument"
    INTERNAL_ERROR = "internal error"
    STORE_NOT_OPEN = "store is not open"
    RATE_LIMITED = "rate limited"
    TIMEOUT = "timeout"
    NETWORK_ERROR = "network error"
    MODEL_NOT_FOUND = "model not found"
    AUTH_ERROR = "authentication failed"


class StoreError(Exception):
    def __init__(self, code: ErrorCode, message: str = ""):
        super().__init__(message or code.value)
        self.code = code
