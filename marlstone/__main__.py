"""python -m marlstone FOLDER: reads statements from standard input and prints results. --create makes the folder first."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from marlstone.session import Session
from marlstone.sources.catalog import Database


def main(arguments: list[str]) -> int:
    folders = [a for a in arguments if not a.startswith("-")]
    if len(folders) != 1:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    if "--create" in arguments:
        Database.create(spark, folders[0])
    session = Session(spark, folders[0])
    for result in session.execute(sys.stdin.read()):
        for line in result.text():
            print(line)
    return session.code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) & 255)
