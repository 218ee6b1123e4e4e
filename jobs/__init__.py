"""Runnable jobs over the library: each has a function taking a session, a command line and a small configuration file."""
