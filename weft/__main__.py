"""``python -m weft FOLDER --init | --check | --plan | --run [--target FOLDER]``: projects from the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from weft.errors import ProjectError
from weft.sources.project_files import load

SAMPLE = {
    "meta.yaml": 'format: "core1.0"\n',
    "relations.yaml": '- name: "[orders]-custkey-[customer]"\n  expression: "[This].o_custkey = [Related].c_custkey"\n  cardinality: M-1\n',
    "sources/orders.yaml": "source_name: orders\nsource_table: orders\ntarget_table: enriched_orders\nraw_attributes: [o_orderkey long, o_custkey long, o_totalprice double]\nrules:\n- name: c_name\n  expression: '[customer].c_name'\n- name: large\n  expression: '[This].o_totalprice > 100000'\n",
    "sources/customer.yaml": "source_name: customer\nsource_table: customer\ntarget_table: enriched_customer\nraw_attributes: [c_custkey long, c_name string]\n",
    "outputs/large_orders.yaml": "output_name: large_orders\ncolumns: [customer string, orders long]\nchannels:\n- source_name: orders\n  filter: '[This].large'\n  operation_type: Aggregate\n  mappings: [c_name customer, count(o_orderkey) orders]\n",
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weft")
    parser.add_argument("folder")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--init", action="store_true", help="write a sample project")
    what.add_argument("--check", action="store_true", help="all checks that need no tables")
    what.add_argument("--plan", action="store_true", help="write the steps and the query plan of each source and output")
    what.add_argument("--run", action="store_true", help="build all tables, or files under --target")
    parser.add_argument("--target", help="folder for plans or files")
    args = parser.parse_args(argv)
    try:
        if args.init:
            for name, text in SAMPLE.items():
                path = Path(args.folder, name)
                path.parent.mkdir(parents=True, exist_ok=True)
                if path.exists():
                    raise ProjectError("init", "is there already", str(path))
                path.write_text(text, encoding="utf-8")
            return 0
        project = load(args.folder)
        if args.check:
            print(f"{len(project.sources)} sources, {len(project.relations)} relations, {len(project.outputs)} outputs")
            return 0
        from pyspark.sql import SparkSession

        from weft.engine import Engine

        engine = Engine(SparkSession.builder.appName("weft").getOrCreate(), project)
        if args.run:
            print("\n".join(engine.build(args.target)))
            return 0
        target = Path(args.target or Path(args.folder, "target"))
        target.mkdir(parents=True, exist_ok=True)
        for name in engine.order():
            df = engine.source(name)
            (target / f"source_{name}.txt").write_text(f"{engine.explain(name)}\n\n{df._jdf.queryExecution().toString()}", encoding="utf-8")
        for name in project.outputs:
            (target / f"output_{name}.txt").write_text(engine.output(name)._jdf.queryExecution().toString(), encoding="utf-8")
        print(f"plans of {len(project.sources)} sources and {len(project.outputs)} outputs in {target}")
        return 0
    except ProjectError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
