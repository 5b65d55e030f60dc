from unitcal.sources.tables import (
    SchemaError,
    build_series,
    coerce_types,
    file_manifest,
    label_columns,
    load_series,
    read_messages,
    require_columns,
    require_manifest,
    stamp,
    write_report,
    write_series,
)

__all__ = [
    "SchemaError",
    "build_series",
    "coerce_types",
    "file_manifest",
    "label_columns",
    "load_series",
    "read_messages",
    "require_columns",
    "require_manifest",
    "stamp",
    "write_report",
    "write_series",
]
