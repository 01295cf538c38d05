from seqlens.sources.testdata import laps, read_table

__all__ = ["laps", "read_table"]
