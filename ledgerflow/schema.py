"""Fixed values of the log engine. Zero means unset in ids, terms and indexes; it is never null."""

from __future__ import annotations

# Entries of one stored batch, sessions a shard keeps, bytes of a snapshot chunk.
BATCH_SIZE = 48
MAX_SESSIONS = 4096
CHUNK_BYTES = 2 * 1024 * 1024
