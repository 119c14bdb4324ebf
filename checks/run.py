"""Run queries and print their row counts: python -m checks.run [sf] [name ...]"""

from __future__ import annotations

import sys
import time

from checks.catalog import QUERIES
from checks.session import local_session


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    for name in names:
        start = time.time()
        rows = QUERIES[name](spark, f"/root/testdata/sf{sf}").collect()
        print(f"{name:24} {len(rows):7} rows {time.time() - start:7.2f} s", flush=True)


if __name__ == "__main__":
    main()
