"""python -m veilspark INPUT OUTPUT [--pages 1-6] [--legend none|surrogates|full] [--common-words FILE]

INPUT: Parquet with doc_id and text, or a .docx file. OUTPUT: a folder.
Exit code 1: some document still holds a real value, and its pages were not written."""

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import Settings, words_in
from .plans.engine import run, write
from .plans.office import redact_files

if __name__ == "__main__":
    args = argparse.ArgumentParser(prog="veilspark")
    args.add_argument("input", help="Parquet with doc_id and text, or a .docx file")
    args.add_argument("output")
    args.add_argument("--pages")
    args.add_argument("--legend", choices=["none", "surrogates", "full"], default="none")
    args.add_argument("--common-words", help="text file of everyday words that are names too")
    given = args.parse_args()
    spark = SparkSession.builder.appName("veilspark").getOrCreate()
    settings = Settings(legend=given.legend)
    if given.common_words:
        settings = Settings(legend=given.legend, common_words=words_in(given.common_words))
    if given.input.lower().endswith(".docx"):
        result, files = redact_files(spark, given.input, settings)
        good = write(result, given.output, given.legend)
        for row in files.toLocalIterator():
            Path(given.output, Path(row.path).name).write_bytes(bytes(row.content))
        sys.exit(not good)
    result = run(spark.read.parquet(given.input), settings, pages=given.pages)
    sys.exit(not write(result, given.output, given.legend))
