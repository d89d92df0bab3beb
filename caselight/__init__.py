"""Account-document analytics on PySpark: sources, text and retrieval operators, sections, history and timestamps."""

__version__ = "0.1.0"
