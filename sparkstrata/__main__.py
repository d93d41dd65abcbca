"""Command line: ``python -m sparkstrata analyze PATH --output FOLDER``.

Exit codes: 0 done, 2 wrong arguments, 3 the input or output can't be used, 130 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans import analysis, report, skeletons
from .sources import images


def parse(arguments: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sparkstrata")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="analyse a file, directory or ZIP")
    a.add_argument("path")
    a.add_argument("--output", required=True)
    a.add_argument("--force", action="store_true", help="overwrite existing files")
    a.add_argument("--inventory", action="store_true", help="read no method bodies")
    a.add_argument("--source", action="store_true", help="skip build and tool directories")
    a.add_argument("--skeleton", action="append", default=[], choices=sorted(skeletons.RENDERERS))
    out = parser.parse_args(arguments)
    if out.inventory and out.skeleton:
        parser.error("--inventory reads no types to render")
    return out


def main(arguments: list[str]) -> int:
    options = parse(arguments)
    targets = [os.path.join(options.output, n) for n in ("report.md", "package.json")]
    if not options.force and (existing := [t for t in targets if os.path.exists(t)]):
        print(f"{existing[0]} exists; use --force", file=sys.stderr)
        return 3
    spark = SparkSession.builder.appName("sparkstrata").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.openCostInBytes", str(1 << 18)).getOrCreate()
    try:
        a = analysis.analyze(spark, options.path, analysis.Options(inventory_only=options.inventory, source_mode=options.source))
        name = os.path.basename(options.path.rstrip("/"))
        report.write_text(targets[0], report.markdown(a, name), options.force)
        report.write_text(targets[1], report.document(a, name, "inventory" if options.inventory else "full").first().value, options.force)
        for language in options.skeleton:
            made = skeletons.skeletons(images.skeleton_types(a.images, a.files), language).collect()
            report.write_project([(r.path, r.content) for r in made], os.path.join(options.output, language), options.force)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 3
    print(f"{analysis.summary(a).first().file_count} files; report in {options.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
