"""quillspark: a PySpark-native engine for mirrored document workspaces."""

__version__ = "0.1.0"
