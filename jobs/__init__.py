"""Runnable jobs over the library: python -m jobs.<name> --help."""
