"""Print one line per query: matches its SQL, or how it differs. Arguments: folder, names."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.compare import difference, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from stepwright.session import local_session  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                built = time.time()
                problem = difference(df, con, oracles[name])
                print(f"{'ok  ' if problem is None else 'DIFF'} {name} {built - start:.1f}+{time.time() - built:.1f}s"
                      f" {problem or ''}", flush=True)
            else:
                print(f"rows {name} {df.count()} {time.time() - start:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            text = str(e) if "-v" in sys.argv else str(e)[:700]
            print(f"FAIL {name} {type(e).__name__}: {text}", flush=True)
            if not hasattr(e, "getErrorClass"):
                print(traceback.format_exc()[-800:])
    spark.stop()


if __name__ == "__main__":
    main()
