"""cropstats: country-by-year statistics as Spark DataFrame operators and jobs.

Every operator takes and returns a ``DataFrame`` with column names as
parameters. Subpackages:

- ``sources``   readers for landed files and the catalog (tables, sinks)
- ``functions`` column-level cleaning expressions (ANSI-safe casts, rounding)
- ``operators`` reshaping, joins, aggregates, statistics and ML stages
- ``plans``     jobs that wire operators into loaders / feature builds, and
                the star-schema queries used by the driver checks
- ``streaming`` incremental ingest of landed station files
"""

from cropstats.session import build, scratch_path

__all__ = ["build", "scratch_path"]
