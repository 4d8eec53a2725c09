from . import catalog, reads  # noqa: F401  (reads adds its queries to the catalogue)
