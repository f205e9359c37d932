"""Command line: run registered queries, or a folder of page images, and write the results.

    python -m pagemill list
    python -m pagemill query NAME TABLES OUT
    python -m pagemill spot IMAGES OUT [--param z=3.0 ...]
    python -m pagemill segment IMAGES OUT
    python -m pagemill marks IMAGES OUT
    python -m pagemill annotate FOLDER ACTION [ARGUMENTS ...]
"""

from __future__ import annotations

import argparse
import json

from pagemill.operators.annotations import Store
from pagemill.plans import pages, registry
from pagemill.plans.spotting import Params
from pagemill.session import session
from pagemill.sources import readers, writers

#: Actions of the annotation store that the command line offers, with how its text arguments are read.
ACTIONS = {
    "assign": ("cluster_id:int", "concept", "annotator", "value"), "name": ("cluster_id:int", "value", "annotator"), "remove": ("cluster_id:int", "annotator"),
    "restore": ("cluster_id:int", "annotator"), "unlabel": ("cluster_id:int", "annotator"), "reset": ("annotator",), "merge": ("cluster_id:int", "into:int", "annotator"),
    "remove_word": ("occ_id:int", "annotator"), "move_word": ("occ_id:int", "into:int", "annotator"), "add_concept": ("name", "annotator"),
    "rename_concept": ("old", "new", "annotator"), "delete_concept": ("name", "annotator"), "carry_over": ("from_run", "to_run", "annotator"),
}


def _arguments(action: str, given: list[str]) -> dict:
    names = ACTIONS[action]
    if len(given) > len(names):
        raise SystemExit(f"{action} takes {', '.join(n.split(':')[0] for n in names)}")
    return {n.split(":")[0]: int(v) if n.endswith(":int") else v for n, v in zip(names, given, strict=False)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagemill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("out")
    for name in ("spot", "segment", "marks"):
        s = sub.add_parser(name)
        s.add_argument("images")
        s.add_argument("out")
        if name == "spot":
            s.add_argument("--param", action="append", default=[])
    a = sub.add_parser("annotate")
    a.add_argument("folder")
    a.add_argument("action", choices=[*ACTIONS, "progress", "list", "export"])
    a.add_argument("arguments", nargs="*")
    args = parser.parse_args(argv)
    if args.what == "list":
        print("\n".join(registry.queries()))
        return
    spark = session()
    if args.what == "query":
        registry.queries()[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    elif args.what == "annotate":
        _annotate(Store(spark, args.folder), args.action, args.arguments)
    else:
        readers.checked_images(readers.images(spark, args.images, content=False))
        images = readers.decoded(spark, args.images)
        if args.what == "segment":
            writers.write_csv(pages.tokens(images).where("error is null"), args.out)
        elif args.what == "marks":
            writers.write_csv(pages.marks(images).where("error is null"), args.out)
        else:
            options = {k: json.loads(v) for k, v in (p.split("=", 1) for p in args.param)}
            for name, df in pages.spotted(images, Params.of(options)).items():
                if name != "candidates":
                    writers.write_csv(df, f"{args.out}/{name}")


def _annotate(store: Store, action: str, given: list[str]) -> None:
    from pagemill.operators.annotations import listed, progress

    if action == "progress":
        progress(store.clusters).show(truncate=False)
    elif action == "list":
        listed(store.clusters, store.occurrences, given[0]).show(100, truncate=False)
    elif action == "export":
        writers.write_csv(writers.decided(store.clusters, store.occurrences, given[0]), given[1])
    else:
        print(getattr(store, action)(**_arguments(action, given)))


if __name__ == "__main__":
    main()
