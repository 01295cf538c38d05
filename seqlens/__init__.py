"""seqlens: rare-event analytics over ordered event sequences, on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions; columns are passed by name through a
:class:`~seqlens.spec.SequenceSpec`.
"""

from seqlens.spec import LAPS, SequenceSpec

__all__ = ["LAPS", "SequenceSpec"]
__version__ = "0.1.0"
