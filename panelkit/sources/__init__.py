"""Reading survey files and writing results."""

from .readers import (  # noqa: F401
    decode_columns, decode_labels, read_codes, read_decisions, read_decimal_comma_csv, read_tsv, snapshot_read,
)
from .writers import (  # noqa: F401
    write_candidates, write_decimal_comma_csv, write_snapshot, write_tsv,
)
