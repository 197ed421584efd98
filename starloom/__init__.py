"""PySpark engine for astronomical source catalogues."""
