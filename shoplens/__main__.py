"""Run all analyses: ``python -m shoplens <table folder> <result folder> [csv|parquet]``."""

from __future__ import annotations

import sys

from .analysis import ORDER_BY, analyse
from .plans import stored
from .sources import build_session, load_csv, load_parquet, write_extract


def main(argv: list[str]) -> int:
    if len(argv) not in (2, 3) or (argv[2:] and argv[2] not in ("csv", "parquet")):
        print(__doc__, file=sys.stderr)
        return 2
    spark = build_session()
    load = load_parquet if argv[2:] == ["parquet"] else load_csv
    write_extract(analyse(load(spark, argv[0]), stored(spark, f"{argv[1]}/_shared")), argv[1], order=ORDER_BY)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
