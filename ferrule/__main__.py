"""python -m ferrule FOLDER: diagnose the files under a folder; the exit code is the highest level found."""

from __future__ import annotations

import sys

from ferrule.operators import report
from ferrule.operators.diagnose import diagnose
from ferrule.options import parse
from ferrule.session import session


def main(arguments: list[str]) -> int:
    options = parse(arguments)
    spark = session()
    found = diagnose(spark, options)
    lines = report.ordered_lines(found["files"], found["issues"], options.scope)
    if options.out:
        lines.write.mode("overwrite").csv(options.out, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        for row in lines.toLocalIterator():  # a partition at a time
            print(row.line)
    for row in found["rollup"].orderBy("format").collect():  # a row for each format
        print(f"{row.total:8} {row.format or 'unknown'}: {row.header_errors} fatal, {row.data_errors} with errors, {row.misnamed} misnamed")
    return report.exit_code(found["issues"])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
