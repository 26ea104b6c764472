"""Answer all questions about a stored catalogue: ``python -m songsift <catalogue> <output> [country]``.

Each answer becomes a Parquet table below the output folder.  ``country`` names
the column with countries, ``artist_country`` if it is left out.  The session takes
its settings from ``spark-submit`` or the Spark configuration.
"""

from __future__ import annotations

import sys
from functools import partial

from pyspark.sql import SparkSession

from songsift.plans.report import (
    artists_report,
    counts_report,
    genres_report,
    playlists_report,
)
from songsift.session import temporary
from songsift.sources.catalogue import read_catalogue


def main(source: str, target: str, country: str | None = None) -> None:
    spark = SparkSession.builder.appName("songsift").getOrCreate()
    # Lists stay text until the operators have merged equal ones.
    songs = read_catalogue(spark, source, lists=False)
    counts = partial(counts_report, country=country)
    for report in (counts, genres_report, playlists_report, artists_report):
        with temporary(spark):
            for name, answer in report(songs).items():
                answer.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")


if __name__ == "__main__":
    if len(sys.argv) not in (3, 4):
        sys.exit(__doc__)
    main(*sys.argv[1:])
