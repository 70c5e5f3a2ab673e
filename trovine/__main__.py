"""python -m trovine list | query NAME FOLDER [OUT] | answer FOLDER OUT [--scheme hybrid|meta|ltr]"""

from __future__ import annotations

import argparse

from .session import session


def main() -> None:
    parser = argparse.ArgumentParser(prog="trovine", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("out", nargs="?")
    a = sub.add_parser("answer")
    a.add_argument("folder")
    a.add_argument("out")
    a.add_argument("--scheme", default="meta", choices=("hybrid", "meta", "ltr"))
    args = parser.parse_args()
    from .plans import registry

    if args.command == "list":
        print(*sorted(registry.queries()), sep="\n")
        return
    spark = session()
    if args.command == "query":
        df = registry.queries()[args.name](spark, args.folder)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, truncate=False)
        return
    from .pipeline import Pipeline, load
    from .sources.io import write_answer

    data = load(spark, args.folder)
    for row in write_answer(Pipeline(data).run(args.scheme), data.queries, args.out, items=data.items):
        print(*row)


if __name__ == "__main__":
    main()
