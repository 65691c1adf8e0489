"""Compare every registered query with its SQL: ``python tests/check_oracle.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import differences, duck

from impactrec.plans.oracle import oracle_queries
from impactrec.plans.queries import all_queries
from impactrec.session import local_session


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, oracle, bad = local_session(), duck(folder), oracle_queries(), 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            problem = differences(frame, con, oracle[name]) if name in oracle else f"rows only: {len(frame.collect())}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s  {problem or ''}", flush=True)
    missing = set(oracle) - set(all_queries())
    print("failed:", bad, "oracle without query:", sorted(missing))
    return bad


if __name__ == "__main__":
    sys.exit(main())
