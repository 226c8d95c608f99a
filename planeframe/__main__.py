"""python -m planeframe probe|inspect|atoms|faststart PATH [OUT]: a line of JSON a movie, packet or atom."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession, functions as F

from planeframe.sources import files, movie, packet


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in ("probe", "inspect", "atoms", "faststart") or (argv[0] == "faststart") != (len(argv) == 3):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found = files.scan(spark, argv[1])
    if argv[0] == "probe":
        out = files.movies(spark, argv[1]).withColumn("sample_count", F.size("samples")).drop("samples", "audio", "movie")
    elif argv[0] == "inspect":
        p = packet.parsed(found.select("path", "content"))
        out = p.select("path", "status", packet.message(F.col("status")).alias("message"), "header", "slices")
    elif argv[0] == "atoms":
        out = movie.atoms_of(found).join(found.select("movie", "path").withColumnRenamed("path", "file"), "movie").drop("movie").orderBy("file", "n")
    else:
        files.register(spark)
        name = F.element_at(F.split("path", "/"), -1)
        made = movie.faststart(found).join(found.select("movie", "path", F.col("content").alias("was")), "movie")
        made.select(name.alias("name"), F.when(F.octet_length("content") > 0, F.col("content")).otherwise(F.col("was")).alias("content")).write.format("planefiles").option("path", argv[2]).mode("append").save()
        return 0
    for line in out.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
