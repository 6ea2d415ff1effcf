"""Privacy and utility evaluation of published tables as Spark DataFrame jobs."""

from veilgauge.meta import ColumnMeta, TableMeta

__all__ = ["ColumnMeta", "TableMeta"]
