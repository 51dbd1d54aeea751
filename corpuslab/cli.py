"""python -m corpuslab.cli QUERY SF_DIR OUT: run a query of the catalogue and write its result as Parquet."""

from __future__ import annotations

import sys

from corpuslab.plans import catalogue
from corpuslab.session import session


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in catalogue.queries():
        print(__doc__, "Queries:", *sorted(catalogue.queries()), sep="\n")
        return 2
    spark = session("corpuslab")
    catalogue.queries()[args[0]](spark, args[1]).write.parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
