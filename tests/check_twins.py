"""Compare every registered query with its twin: python tests/check_twins.py [folder] [name part ...]."""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from tests.compare import connect, difference  # noqa: E402
from wattsift.plans import catalog  # noqa: E402
from wattsift.session import local_session  # noqa: E402


def main(sf_dir: str, parts: list[str]) -> int:
    spark, con = local_session(8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    twins, failed = catalog.oracle_sql(), 0
    for name, run in catalog.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toArrow()
            took = time.time() - start
            problem = difference(got, con.execute(twins[name]).to_arrow_table()) if name in twins else None
        except Exception as error:
            took, problem, got = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}", None
        failed += problem is not None
        note = problem or ("ok" if name in twins else "rows only")
        print(f"{name:32} {took:6.2f}s {got.num_rows if got is not None else '-':>8} {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
