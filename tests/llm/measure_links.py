"""Components of op10_near_dedup against every pair that shares a shingle: ``python -m tests.llm.measure_links [FOLDER]``."""

import sys
import time

from tests.llm.conftest import duck
from tidemill.llm import near_dedup as nd
from tidemill.session import get_session, ship_package


def main(folder: str = "/root/testdata/sf0.1") -> None:
    con, began = duck(folder), time.time()
    want = {r[0]: r[2] for r in con.execute(nd.OP10_SQL).fetchall()}
    said = time.time()
    spark = get_session("links", cores=8, shuffle_partitions=8, spark__driver__memory="8g")
    ship_package(spark)
    got = {r.doc_id: r.component_id for r in nd.op10_near_dedup(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    grouped = sum(c != d for d, c in want.items())
    print(f"{folder}: {len(want)} documents, {grouped} beside their group's first; {sum(got[d] != c for d, c in want.items())} in another component than by brute force; SQL {said - began:.0f} s, operator {time.time() - said:.0f} s")


if __name__ == "__main__":
    main(*sys.argv[1:])
