from furrow.sources.tables import read_table, scan_csv, RAW_SCHEMA
from furrow.sources.adapters import obs_long, obs_raw, SERIES_KEYS

__all__ = ["read_table", "scan_csv", "RAW_SCHEMA", "obs_long", "obs_raw", "SERIES_KEYS"]
