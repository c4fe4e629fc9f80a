"""tabloom: a table workbench expressed as Spark jobs.

Every operator takes and returns DataFrames.  Only metadata (schemas, plans,
verdicts of a few rows) ever lives on the driver.
"""

from tabloom.model import (  # noqa: F401
    Canon,
    ColumnMeta,
    Filter,
    ForeignKey,
    Sort,
    TableMeta,
    kind_of,
)

__version__ = "0.1.0"
