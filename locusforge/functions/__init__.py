from locusforge.functions.paths import (
    format_of,
    partition_key,
    scheme_of,
    study_id,
    uri_segments,
)
from locusforge.functions.register import register_functions
from locusforge.functions.stats import (
    erf,
    erfc,
    log_abf,
    neg_log10,
    normal_two_sided,
)
from locusforge.functions.text import (
    clean_label,
    clean_name,
    create_name,
    duration_seconds,
    exit_status,
    map_to_pairs,
    strhash,
)

__all__ = [
    "clean_label",
    "clean_name",
    "create_name",
    "duration_seconds",
    "erf",
    "erfc",
    "exit_status",
    "format_of",
    "log_abf",
    "map_to_pairs",
    "neg_log10",
    "normal_two_sided",
    "partition_key",
    "register_functions",
    "scheme_of",
    "strhash",
    "study_id",
    "uri_segments",
]
