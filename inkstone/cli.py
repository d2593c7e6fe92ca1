"""The operations from the command line: ``python -m inkstone.cli -mode tokenize -input 'logs/*.sql' -output out``.

Each input file is one statement, unless ``-format`` names another form; many files make one Spark job.
"""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.normalize import NormalizerConfig
from inkstone.functions.obfuscate import ObfuscatorConfig
from inkstone.operators.statements import token_rows, with_normalized, with_obfuscated
from inkstone.sources.statements import read_statements, write_file, write_results

MODES = ("obfuscate_and_normalize", "obfuscate", "normalize", "tokenize")
OBFUSCATOR = {"replace_digits": True, "replace_boolean": True, "replace_null": True, "replace_positional_parameter": False, "replace_bind_parameter": False, "keep_json_path": False, "dollar_quoted_func": False}
NORMALIZER = {"collect_comments": True, "collect_commands": True, "collect_tables": True, "collect_procedures": False, "keep_sql_alias": False, "uppercase_keywords": False, "remove_space_between_parentheses": False, "keep_trailing_semicolon": False, "keep_identifier_quotation": False}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkstone", description="Tokenize, obfuscate and normalize SQL text.")
    p.add_argument("-mode", choices=MODES, default=MODES[0])
    p.add_argument("-input", help="path or pattern; standard input if left out")
    p.add_argument("-format", default="text", help="text (a statement a file), lines, or any format that Spark reads")
    p.add_argument("-output", help="file for the results, or folder for their parts if it ends with a slash; standard output if left out")
    p.add_argument("-dbms", default="")
    for name, default in {"with_metadata": False, **OBFUSCATOR, **NORMALIZER}.items():
        flag = name.replace("_", "-")
        p.add_argument(f"-{flag}", f"--{flag}", nargs="?", type=switch, const=True, default=default, help=f"-{flag} or -{flag}=false; {str(default).lower()} if left out")
        p.add_argument(f"--no-{flag}", dest=name, action="store_false", help=argparse.SUPPRESS)
    return p


def switch(text: str) -> bool:
    """The words that a flag may be set to."""
    if text in ("1", "t", "T", "true", "TRUE", "True"):
        return True
    if text in ("0", "f", "F", "false", "FALSE", "False"):
        return False
    raise argparse.ArgumentTypeError(f"not true or false: {text}")


def results(df: DataFrame, args: argparse.Namespace) -> DataFrame:
    """One text column ``value``: a row for each statement, or for each token."""
    chosen = lambda names: {n: getattr(args, n) for n in names}
    obfuscator, config = ObfuscatorConfig(**chosen(OBFUSCATOR)), NormalizerConfig(**chosen(NORMALIZER))
    if args.mode == "tokenize":
        return token_rows(df, dialect=args.dbms).select("value")
    if args.mode == "obfuscate":
        return with_obfuscated(df, obfuscator, dialect=args.dbms).select(F.col("obfuscated_sql").alias("value"))
    made = with_normalized(df, config, None if args.mode == "normalize" else obfuscator, dialect=args.dbms)
    if args.with_metadata:
        return made.select(F.to_json(F.struct(F.col("normalized_sql").alias("sql"), "metadata")).alias("value"))
    return made.select(F.col("normalized_sql").alias("value"))


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("inkstone").getOrCreate()
    if args.input is None:
        text = re.sub(r"\r?\n\Z", "", sys.stdin.read().replace("\r\n", "\n"))
        show(results(spark.createDataFrame([(text,)], "sql string"), args), args)
    else:
        show(results(read_statements(spark, args.input, args.format), args), args)


def show(out: DataFrame, args: argparse.Namespace) -> None:
    if args.output is not None and args.output.endswith("/"):
        write_results(out, args.output, "text")
    elif args.output is not None:
        write_file(out, args.output)
    else:
        for row in out.toLocalIterator():
            print(row.value)


if __name__ == "__main__":
    main()
