"""Runnable jobs over the library's operators, each with a command line and a small settings file."""
