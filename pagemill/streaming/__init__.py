"""Incremental work: pages as they arrive, event logs, and windows over events (an extension)."""
