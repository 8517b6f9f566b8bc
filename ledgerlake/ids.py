"""Identifiers. A transaction's id says nothing about order: sequences do."""

from __future__ import annotations

import os
import time
import uuid


def new_uuid() -> str:
    return str(uuid.uuid4())


def new_transaction_id() -> str:
    """A version 7 UUID: milliseconds since the epoch, then random bits."""
    value = (time.time_ns() // 1_000_000) << 80 | int.from_bytes(os.urandom(10), "big")
    value = value & ~(0xF << 76) | 0x7 << 76
    return str(uuid.UUID(int=value & ~(0x3 << 62) | 0x2 << 62))
