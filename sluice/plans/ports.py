"""Ports of feed data, with sources that read what was published.

What shows lists depends on the two protocols only; a source may be a stored table, another service, or a test's fake.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans import publish


@dataclass
class Skeleton:
    """(place, group_id) of a feed, each group once, and when its list was published."""

    groups: DataFrame
    refreshed_at: object


@dataclass
class PublishedImages:
    """The rows of a list in order, not deduped by group, when it was published, and its statistics (None if never written)."""

    images: DataFrame
    refreshed_at: object
    statistics: DataFrame | None


class FeedSource(Protocol):
    def skeleton(self, force_refresh: bool = False) -> Skeleton:
        """The feed; ``force_refresh`` goes past any cache."""


class ImagesSource(Protocol):
    def published_images(self) -> PublishedImages:
        """The whole list."""


class StoredLists:
    """Both ports over lists that ``publish.write_lists`` wrote; ``requested`` as ``<order>-<limit>``, else the default list.

    A feed whose list is empty falls back to the next wider one of the same order.
    """

    def __init__(self, spark: SparkSession, path: str, requested: str | None = None) -> None:
        self.spark, self.path, self.requested = spark, path, requested

    def _chosen(self):
        return publish.resolve_list(publish.published_catalog(self.spark, self.path), self.requested).first()  # one row

    def skeleton(self, force_refresh: bool = False) -> Skeleton:
        chosen = self._chosen()
        lists, at = publish.read_all(self.spark, self.path)
        rows = publish.serve(lists, publish.published_catalog(self.spark, self.path), chosen["order"], chosen["seconds"])
        return Skeleton(rows.select("place", "group_id").orderBy("place"), at)

    def published_images(self) -> PublishedImages:
        name = self._chosen()["list"]
        rows = publish.read_list(self.spark, self.path, name)
        return PublishedImages(rows.drop("refreshed_at"), publish.read_all(self.spark, self.path)[1], publish.read_statistics(self.spark, self.path, name))


class Cached:
    """A feed that is read again only when it is older than ``seconds``, or by force; rows that are few enough to keep are kept."""

    def __init__(self, source: FeedSource, seconds: float = 300, clock: Callable[[], float] = time.monotonic) -> None:
        self.source, self.seconds, self.clock = source, seconds, clock
        self.held: Skeleton | None = None
        self.since = 0.0

    def skeleton(self, force_refresh: bool = False) -> Skeleton:
        if self.held is None or force_refresh or self.clock() - self.since > self.seconds:
            fresh = self.source.skeleton(force_refresh)
            fresh.groups.persist()
            if self.held is not None:
                self.held.groups.unpersist()
            self.held, self.since = fresh, self.clock()
        return self.held


class Retried:
    """A feed whose source is asked again after a passing fault, ``tries`` times in all; other errors go through at once."""

    def __init__(self, source: FeedSource, tries: int = 2, passing: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> None:
        self.source, self.tries, self.passing = source, tries, passing

    def skeleton(self, force_refresh: bool = False) -> Skeleton:
        for k in range(self.tries):
            try:
                return self.source.skeleton(force_refresh)
            except self.passing:
                if k + 1 == self.tries:
                    raise
        raise AssertionError("no try was made")


def feed_ids(source: FeedSource, first: int | None = None) -> DataFrame:
    """The groups of a feed in order, ``first`` of them at most."""
    rows = source.skeleton().groups
    return rows if first is None else rows.where(F.col("place") <= first)
