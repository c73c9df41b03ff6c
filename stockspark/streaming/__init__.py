"""Structured Streaming jobs: snapshot file feed (STM-1), lifecycle commands (STM-2), stock ledger (STM-3)."""
