from murmur.sources.schema import first_present, require_columns, select_present
from murmur.sources.tables import read_table

__all__ = ["first_present", "require_columns", "select_present", "read_table"]
