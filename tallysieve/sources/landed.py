"""Landed search pages, board pages and commit feeds as Spark data sources of their own.

``register(spark)`` makes the formats known:

* ``landed_search`` and ``landed_boards`` read a folder ``path`` of
  ``source=<name>/page=<number>/*.json``.  Each line of a page's files is one attempt to
  fetch it: ``{"attempt": 0, "status": 200, "body": "..."}``.  A source is one input
  partition, or several are where the option ``numPartitions`` asks for fewer; its pages are opened one after the other by the executor and only as far as
  the paging rules go.  What goes wrong in a source is told in its rows and stops no other.
  With the option ``packed`` the folder has files ``*.json`` of many sources instead, each
  line an attempt with its ``source`` and ``page`` (of a board also the ``platform`` and
  ``token`` that it is registered with).  A source is whole in one file and its lines are
  in order; a file is one input partition and is read as a stream.  That takes as many
  files as tasks, not one or more for each source and page.
* ``commit_feeds`` reads a folder ``path`` of ``source=<name>/*``, each list's commit feed,
  as a stream.  Its offset is the newest commit of each list, so a list is delivered when
  its commit changes, once, and a restarted query goes on from the offsets it has recorded.

Folders are opened through ``pyarrow.fs``, so any shared file system that Arrow knows will do.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tallysieve.sources.boards import MAX_PAGES, PAGE_ROWS
from tallysieve.sources.pages import cards

#: Listings of a full search page, and how often a refused request is tried again.
SEARCH_ROWS, RETRIES = 10, 2
REFUSED = 429
RATE_LIMITED = "rate_limited"

_HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a url or a plain path, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _below(system: fs.FileSystem, folder: str, name: str) -> list[tuple[str, str]]:
    """(value, folder) of the folders ``name=value`` in a folder, by value."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    parts = [(i.base_name[len(name) + 1 :], i.path) for i in found if i.type == fs.FileType.Directory and i.base_name.startswith(f"{name}=")]
    return sorted((unquote(value), path) for value, path in parts if value != _HIVE_NULL)


def _contents(system: fs.FileSystem, folder: str) -> Iterator[bytes]:
    """What the files of a folder hold, by name; hidden ones are left out."""
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if info.type == fs.FileType.File and info.base_name[:1] not in "._":
            with system.open_input_stream(info.path) as stream:
                yield stream.read()


def _attempts(system: fs.FileSystem, folder: str) -> list[dict]:
    """The landed attempts of a page, in the order in which they were made."""
    rows = [json.loads(line) for content in _contents(system, folder) for line in content.splitlines() if line.strip()]
    return sorted(rows, key=lambda r: r.get("attempt") or 0)


def fetched(attempts: Iterator[dict]) -> tuple[str | None, str | None]:
    """(body, error) of a request: refused ones are tried again, twice; other errors are texts."""
    for _ in range(RETRIES + 1):
        got = next(attempts, None)
        if got is None:
            return None, "not landed"
        status = got.get("status", 200)
        if status != REFUSED:
            return (got.get("body") or "", None) if 200 <= status < 300 else (None, f"HTTP {status}")
    return None, RATE_LIMITED


def pages_of(system: fs.FileSystem, folder: str) -> Iterator[tuple[int, list[dict]]]:
    """(number, attempts) of the pages from 0 on, up to the first that has not landed."""
    at = {int(value): path for value, path in _below(system, folder, "page") if value.isdigit()}
    number = 0
    while number in at:
        yield number, _attempts(system, at[number])
        number += 1


def packed_lines(system: fs.FileSystem, file: str) -> Iterator[dict]:
    """The attempts of a packed file; a line that can't be read has no source to be told of, so it ends the task."""
    with system.open_input_stream(file) as stream:
        for line in io.TextIOWrapper(stream, encoding="utf-8", newline="\n"):
            try:
                yield json.loads(line)
            except ValueError as e:
                raise RuntimeError(f"{file}: no attempt: {line[:80]!r}") from e


def packed_pages(rows: Iterator[dict]) -> Iterator[tuple[int, list[dict]]]:
    """(number, attempts) of one source's lines, page by page, up to the first page that has not landed."""
    for number, (page, attempts) in enumerate(groupby(rows, key=lambda r: r.get("page"))):
        if page != number:
            return
        yield number, sorted(attempts, key=lambda r: r.get("attempt") or 0)


def search_pages(pages: Iterator[tuple[int, list[dict]]], most: int) -> Iterator[tuple[int, list[dict], str | None]]:
    """(page, listings, why the search ends here or None) of the pages that a search reads."""
    for number, attempts in pages:
        if number >= most:
            return
        tries = iter(attempts)
        body, error = fetched(tries)
        found = cards(body) if error is None else []
        if error is None and not found:
            # An empty page is asked for once more.
            body, again = fetched(tries)
            found = cards(body) if again is None else []
            error = None if found else "empty"
        stop = error if error in (None, RATE_LIMITED, "empty") else "error"
        if stop is None and len(found) < SEARCH_ROWS:
            stop = "short"
        yield number, found, stop
        if stop:
            return


def board_pages(pages: Iterator[tuple[int, list[dict]]], paged: bool) -> Iterator[tuple[int, str | None, str | None]]:
    """(page, payload, why the board ends here or None) of the pages that a board's sweep reads.

    A paged board ends with the total that its first page names, with a page that is not
    full or has only paths that came before, and after ``MAX_PAGES``; pages before a
    failure count.
    """
    seen: set[str] = set()
    total = None
    for number, attempts in pages:
        body, error = fetched(iter(attempts))
        if error is not None:
            yield number, None, RATE_LIMITED if error == RATE_LIMITED else "error"
            return
        if not paged:
            yield number, body, None
            return
        try:
            payload = json.loads(body)
            postings = payload.get("jobPostings") or []
            paths = [p.get("externalPath") for p in postings]
        except (ValueError, AttributeError):
            yield number, None, "error"
            return
        if not postings:
            yield number, None, "empty"
            return
        if number == 0:
            total = payload.get("total") if isinstance(payload.get("total"), int) and payload["total"] > 0 else None
        fresh = {p for p in paths if p} - seen
        seen |= fresh
        done = (number + 1) * PAGE_ROWS
        stop = "wrapped" if not fresh else "short" if len(postings) < PAGE_ROWS else "total" if total is not None and done >= total else "cap" if number + 1 >= MAX_PAGES else None
        yield number, body, stop
        if stop:
            return


@dataclass
class SourceFolders(InputPartition):
    """(name, folder) of searches or boards, or packed files under no name."""

    sources: list[tuple[str, str]]


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.options = options
        self.packed = options.get("packed", "false").lower() == "true"

    def files(self) -> list[tuple[str, str]]:
        system, folder = opened(self.path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(("", i.path) for i in found if i.type == fs.FileType.File and i.size and i.base_name[:1] not in "._")

    def sources(self) -> list[tuple[str, str]]:
        system, folder = opened(self.path)
        return _below(system, folder, "source")

    def partitions(self) -> list[SourceFolders]:
        sources = self.files() if self.packed else self.sources()
        parts = max(1, min(len(sources), int(self.options.get("numpartitions", len(sources)))))
        return [SourceFolders(sources[k::parts]) for k in range(parts)]

    def read(self, partition: SourceFolders) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for source, folder in partition.sources:
            if self.packed:
                for source, rows in groupby(packed_lines(system, folder), key=lambda r: r.get("source")):
                    if source is not None and (kept := self.registered(source, rows)) is not None:
                        yield from self.source_rows(source, packed_pages(kept))
            else:
                yield from self.source_rows(source, pages_of(system, folder))

    def source_rows(self, source: str, pages: Iterator[tuple[int, list[dict]]]) -> Iterator[tuple]:
        page = 0
        try:
            for page, *rest in self.pages(source, pages):
                yield from self.rows(source, page, *rest)
        except (OSError, ValueError):
            yield from self.failed(source, page)

    def registered(self, source: str, rows: Iterator[dict]) -> Iterator[dict] | None:
        """A packed source's lines; none if it has no fetcher."""
        return rows


class SearchReader(_FolderReader):
    def pages(self, source: str, pages: Iterator) -> Iterator:
        return search_pages(pages, int(self.options.get("maxpages", 1 << 31)))

    def rows(self, source: str, page: int, found: list[dict], stop: str | None) -> Iterator[tuple]:
        for at, c in enumerate(found):
            yield source, page, at, len(found), stop, c["id"], c["title"], c["company"], c["location"], c["url"], c["posted_at"], c["is_easy_apply"]
        if not found:
            yield source, page, None, 0, stop, None, None, None, None, None, None, None

    def failed(self, source: str, page: int) -> Iterator[tuple]:
        yield from self.rows(source, page, [], "error")


class LandedSearch(DataSource):
    """Listings of searches; a page without listings is a row without an id.  Option ``maxPages``: pages a search reads at most."""

    @classmethod
    def name(cls) -> str:
        return "landed_search"

    def schema(self) -> str:
        return "search_term string, page int, pos int, n_listings int, stopped string, id string, title string, company string, location string, url string, posted_at string, is_easy_apply boolean"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


class BoardReader(_FolderReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.registry = json.loads(options.get("registry", "{}"))

    def sources(self) -> list[tuple[str, str]]:
        # A board that is not registered has no fetcher.
        return [(name, folder) for name, folder in super().sources() if name in self.registry]

    def registered(self, source: str, rows: Iterator[dict]) -> Iterator[dict] | None:
        first = next(rows)
        if first.get("platform") is None:
            return None
        # One board's entry at a time: the registry may be as long as the boards are many.
        self.registry = {source: {"platform": first["platform"], "token": first.get("token")}}
        return chain((first,), rows)

    def pages(self, source: str, pages: Iterator) -> Iterator:
        return board_pages(pages, self.registry[source]["platform"] == "workday")

    def rows(self, source: str, page: int, payload: str | None, stop: str | None) -> Iterator[tuple]:
        own = self.registry[source]
        yield source, own["platform"], own["token"], page, payload, stop

    def failed(self, source: str, page: int) -> Iterator[tuple]:
        yield from self.rows(source, page, None, "error")


class LandedBoards(DataSource):
    """Payloads of registered boards.  Option ``registry``: JSON of ``{company: {"platform": ..., "token": ...}}``."""

    @classmethod
    def name(cls) -> str:
        return "landed_boards"

    def schema(self) -> str:
        return "company string, platform string, token string, page int, payload string, stopped string"

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options)


def newest_commit(feed: str) -> str | None:
    """The second id of a commit feed; the first is the feed's own."""
    ids = re.findall(r"<id>(.*?)</id>", feed)
    return ids[1] if len(ids) > 1 else None


class CommitReader(SimpleDataSourceStreamReader):
    """Rows between two offsets are the lists whose commits differ, so a batch that runs again gives the same rows."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def _newest(self) -> dict[str, str]:
        system, folder = opened(self.path)
        out = {}
        for name, feed in _below(system, folder, "source"):
            try:
                commit = newest_commit(b"".join(_contents(system, feed)).decode("utf-8", "replace"))
            except OSError:
                continue
            if commit is not None:
                out[name] = commit
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        # A feed that can't be read now keeps its commit.
        end = {**start, **self._newest()}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(name, commit, start.get(name)) for name, commit in sorted(end.items()) if start.get(name) != commit])

    def commit(self, end: dict) -> None:
        pass


class CommitFeeds(DataSource):
    """Lists with a new commit: its name, the commit and the one before."""

    @classmethod
    def name(cls) -> str:
        return "commit_feeds"

    def schema(self) -> str:
        return "source_name string, commit string, previous string"

    def simpleStreamReader(self, schema) -> CommitReader:
        return CommitReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (LandedSearch, LandedBoards, CommitFeeds):
        spark.dataSource.register(source)
