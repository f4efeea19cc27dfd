from .files import load_csv, load_parquet, register_views, write_extract, write_parquet
from .schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS
from .session import build_session

__all__ = [
    "FOREIGN_KEYS",
    "PRIMARY_KEYS",
    "SCHEMAS",
    "build_session",
    "load_csv",
    "load_parquet",
    "register_views",
    "write_extract",
    "write_parquet",
]
