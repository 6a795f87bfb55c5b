"""Runnable jobs over the library: each module has a ``run`` that takes a session, a command line and a small configuration."""
