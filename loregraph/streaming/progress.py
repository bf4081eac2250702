"""How far a running import is: metrics that Spark observes while rows pass, handed to a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: ``callback(pages_done, pages_failed, pages_total)``; the total is None where nobody knows it.
Callback = Callable[[int, int, int | None], None]

NAME = "import_progress"


def watched(pages: DataFrame, name: str | Observation = NAME) -> DataFrame:
    """``pages`` (page, error, ...) with their counts observed: pages, failed."""
    return pages.observe(name, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"))


class ImportProgress(StreamingQueryListener):
    """Adds up what the micro-batches of a streaming import report, and tells the callback after each."""

    def __init__(self, callback: Callback, total: int | None = None, name: str = NAME):
        self.callback, self.total, self.name = callback, total, name
        self.done = self.failed = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["pages"]:
            self.done += row["pages"]
            self.failed += row["failed"]
            self.callback(self.done, self.failed, self.total)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def reported(pages: DataFrame, write: Callable[[DataFrame], None], callback: Callback, total: int | None = None) -> tuple[int, int]:
    """A batch import: ``write`` is given the watched pages; (pages, failed) as they were written, told to the callback."""
    seen = Observation(NAME)
    write(watched(pages, seen))
    found = seen.get
    callback(found["pages"], found["failed"], total)
    return found["pages"], found["failed"]
