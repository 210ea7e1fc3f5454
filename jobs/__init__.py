"""Runnable jobs: plain path arguments, a small JSON configuration, Spark's readers and writers."""
