"""Reading and writing tables."""

from mnemora.sources.tables import append_log, cut, logged, read_table, read_version, shared_folder, write_version

__all__ = ["append_log", "cut", "logged", "read_table", "read_version", "shared_folder", "write_version"]
