from gridstrata.sources.tables import SCHEMAS, table

__all__ = ["SCHEMAS", "table"]
