"""python -m loomwright.cli list | run NAME --tables DIR [--out PATH] [--rows N] | explain NAME --tables DIR"""

from __future__ import annotations

import argparse

from loomwright.plans import registry
from loomwright.session import get_session
from loomwright.sources.files import markdown


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("action", choices=["list", "run", "explain"])
    p.add_argument("name", nargs="?")
    p.add_argument("--tables")
    p.add_argument("--out")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(args)
    if a.action == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    df = registry.QUERIES[a.name](get_session("cli"), a.tables)
    if a.action == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        print(markdown(df, a.rows))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
