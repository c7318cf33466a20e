"""Sources of files: the contract of a connector, folders and remote drives by it, and the Spark data source that reads any of them.

A connector lists items and fetches their contents. ``shares()`` cuts its
listing into parts that executors read side by side; a cursor of what was
visited lets a listing go on where it ended.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from fnmatch import fnmatchcase
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.sources.files import SYSTEM_FOLDERS
from quillspark.sources.http import Client, Failed

ITEM = """source_id string, external_id string, name string, path string, extension string, size long, modified_at timestamp, etag string, author string,
library string, web_url string, skip string, note string, content binary, content_hash string"""
BUDGET = 15.0  # fixed value: seconds for counting


@dataclass(frozen=True)
class Item:
    external_id: str
    name: str
    path: str
    size: int | None = None
    modified_at: datetime | None = None
    etag: str | None = None
    author: str | None = None
    library: str | None = None
    web_url: str | None = None
    content_hash: str | None = None
    skip: str | None = None  # why it isn't read

    @property
    def extension(self) -> str:
        return os.path.splitext(self.name)[1].lower()


@dataclass
class Choice:
    """Which items are read. Excluded extensions count before included ones (none: all); patterns see path and name."""

    extensions: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    hidden: bool = False
    most_bytes: int | None = None

    def reason(self, item: Item, lower: bool = False) -> str | None:
        """Why an item is left out."""
        own = {e if e.startswith(".") else "." + e for e in map(str.lower, self.extensions)}
        out = {e if e.startswith(".") else "." + e for e in map(str.lower, self.excluded)}
        if item.extension in out:
            return "excluded extension"
        if own and item.extension not in own:
            return "extension not included"
        names = [item.path, item.name]
        names = [n.lower() for n in names] if lower else names
        if any(fnmatchcase(n, p) for n in names for p in self.patterns):
            return "excluded by pattern"
        if self.most_bytes and item.size is not None and item.size > self.most_bytes:
            return "too large"
        return None


@dataclass
class Cursor:
    """What a listing has visited: items before ``after``, in the connector's order."""

    after: str | None = None
    token: str | None = None

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str | None) -> Cursor:
        return cls(**json.loads(text)) if text else cls()


class Connector(ABC):
    """A source of files. Instances are sent to executors, so they hold settings, no connections."""

    source_id: str
    parallel = False  # whether items may be fetched side by side

    @abstractmethod
    def test(self) -> None:
        """An error if the source can't be reached."""

    @abstractmethod
    def items(self, share: str | None = None, cursor: Cursor | None = None) -> Iterator[Item]:
        """All items, or those of a share, in a fixed order from the cursor on."""

    @abstractmethod
    def fetch(self, item: Item) -> bytes: ...

    def shares(self) -> list[str | None]:
        """Parts of the listing that can be read apart."""
        return [None]

    def estimate(self, budget: float = BUDGET, clock: Callable[[], float] = time.monotonic) -> int | None:
        """How many items there are; unknown if counting takes longer than the budget."""
        end, n = clock() + budget, 0
        for share in self.shares():
            for item in self.items(share):
                n += item.skip is None
                if clock() > end:
                    return None
        return n


@dataclass
class Folder(Connector):
    """A folder that all executors see: depth first, in the order of names. Folders that can't be listed become items with a note."""

    root: str
    source_id: str = "local"
    choice: Choice = field(default_factory=Choice)
    parallel = True

    def test(self) -> None:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        os.scandir(self.root).close()

    def shares(self) -> list[str | None]:
        """Each folder below the root, and the root's own files."""
        try:
            with os.scandir(self.root) as entries:
                return ["", *sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and self._enters(e))]
        except OSError:
            return [""]

    def _hidden(self, entry: os.DirEntry) -> bool:
        marked = getattr(entry.stat(follow_symlinks=False), "st_file_attributes", 0)
        return entry.name.startswith(".") or bool(marked & (getattr(stat, "FILE_ATTRIBUTE_HIDDEN", 2) | getattr(stat, "FILE_ATTRIBUTE_SYSTEM", 4)))

    def _enters(self, entry: os.DirEntry) -> bool:
        relative = os.path.relpath(entry.path, self.root).replace(os.sep, "/")
        excluded = any(fnmatchcase(n, p) for n in (relative, entry.name) for p in self.choice.patterns)
        return entry.name.lower() not in SYSTEM_FOLDERS and not excluded and (self.choice.hidden or not self._hidden(entry))

    def items(self, share: str | None = None, cursor: Cursor | None = None) -> Iterator[Item]:
        after = cursor.after if cursor else None
        for item in self._below(os.path.join(self.root, share) if share else self.root, deep=share != ""):
            if after is None or _order(item.path) > _order(after):
                yield item

    def _below(self, folder: str, deep: bool = True) -> Iterator[Item]:
        relative = os.path.relpath(folder, self.root).replace(os.sep, "/").removeprefix(".").removeprefix("/")
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            yield Item(relative + "/", os.path.basename(folder), relative + "/", skip=f"not listed: {type(e).__name__}")
            return
        for entry in entries:
            try:
                if entry.is_symlink():
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if deep and self._enters(entry):
                        yield from self._below(entry.path)
                elif entry.is_file(follow_symlinks=False) and (self.choice.hidden or not self._hidden(entry)):
                    yield from self._item(entry)
            except OSError:
                continue

    def _item(self, entry: os.DirEntry) -> Iterator[Item]:
        facts = entry.stat(follow_symlinks=False)
        path = os.path.relpath(entry.path, self.root).replace(os.sep, "/")
        when = datetime.fromtimestamp(int(facts.st_mtime), UTC)
        library = path.partition("/")[0] if "/" in path else None
        item = Item(path, entry.name, path, facts.st_size, when, f"{facts.st_size}-{int(facts.st_mtime)}", library=library)
        why = self.choice.reason(item)
        if why in (None, "too large"):  # large files are listed, others that are left out are not
            yield item if why is None else Item(**{**item.__dict__, "skip": why})

    def fetch(self, item: Item) -> bytes:
        """The file's content; a path that leads out of the root is an error."""
        place = os.path.realpath(os.path.join(self.root, item.path))
        if os.path.commonpath([place, os.path.realpath(self.root)]) != os.path.realpath(self.root):
            raise PermissionError(item.path)
        with open(place, "rb") as f:
            return f.read()


def _order(path: str) -> tuple[str, ...]:
    return tuple(path.split("/"))


#: Hashes that a drive tells, the first that is there counts.
HASHES = ("quickXorHash", "sha256Hash", "sha1Hash", "crc32Hash")


@dataclass
class Drive(Connector):
    """A remote drive: its folders by a stack, each folder's children page by page. ``client`` makes the connection where it is used."""

    client: Callable[[], Client]
    drive_id: str
    source_id: str = "drive"
    library: str | None = None
    start: str = "root"
    choice: Choice = field(default_factory=Choice)
    parallel = True

    def _url(self, *parts: str) -> str:
        cleaned = [p.strip().strip("/") for p in parts]
        if not all(cleaned):
            raise Failed("an empty identifier")
        return "/".join(quote(p, safe=",!$&'()*+;=:@") for p in cleaned)

    def test(self) -> None:
        self.client().request("GET", self._url("drives", self.drive_id))

    def shares(self) -> list[str | None]:
        """The folders below the start, and its own files."""
        children = self.client().paged(self._url("drives", self.drive_id, "items", self.start, "children"))
        return ["", *(f"{c['id']}\n{c.get('name', '')}" for c in children if "folder" in c and not self._hidden(c))]

    def _hidden(self, entry: dict) -> bool:
        return not self.choice.hidden and entry.get("name", "").startswith(".")

    def items(self, share: str | None = None, cursor: Cursor | None = None) -> Iterator[Item]:
        client = self.client()
        first, _, name = (share or "").partition("\n")
        todo = [(first or self.start, name)]
        while todo:
            folder, path = todo.pop()
            for entry in client.paged(self._url("drives", self.drive_id, "items", folder, "children")):
                own = f"{path}/{entry.get('name', '')}".lstrip("/")
                if "folder" in entry:
                    if share != "" and not self._hidden(entry):
                        todo.append((entry["id"], own))
                elif "file" in entry and not self._hidden(entry):
                    yield self._item(entry, own)

    def _item(self, entry: dict, path: str) -> Item:
        hashes = entry.get("file", {}).get("hashes", {})
        said = next((f"{k}:{hashes[k]}" for k in HASHES if hashes.get(k)), None)
        person = (entry.get("createdBy") or entry.get("lastModifiedBy") or {}).get("user", {}).get("displayName")
        item = Item(
            entry["id"], entry.get("name", ""), path, entry.get("size"), graph_time(entry.get("lastModifiedDateTime")), entry.get("eTag") or entry.get("cTag"),
            person, self.library, entry.get("webUrl"), said,
        )
        why = self.choice.reason(item, lower=True)
        return item if why is None else Item(**{**item.__dict__, "skip": why})

    def fetch(self, item: Item) -> bytes:
        return self.client().download(self._url("drives", self.drive_id, "items", item.external_id, "content"), item.size)[0]

    def changed(self, cursor: Cursor) -> tuple[list[Item], list[str], Cursor]:
        """Items that are new or changed since the cursor, ids of those that are gone, and the next cursor."""
        url = cursor.token or self._url("drives", self.drive_id, "root") + "/delta"
        entries, link = self.client().changes(url)
        latest = {e["id"]: e for e in entries}  # of several states of one item the last counts
        files = [self._item(e, (e.get("parentReference", {}).get("path", "").partition(":")[2] + "/" + e.get("name", "")).lstrip("/")) for e in latest.values() if "file" in e and "deleted" not in e]
        return files, [i for i, e in latest.items() if "deleted" in e], Cursor(token=link or cursor.token)


def graph_time(text: str | None) -> datetime | None:
    """An ISO time with fractions of any length, in UTC."""
    if not text:
        return None
    head, dot, rest = text.strip().replace("Z", "+00:00").partition(".")
    if dot:
        digits = rest[: len(rest) - len(rest.lstrip("0123456789"))]
        head += "." + digits[:6].ljust(6, "0") + rest[len(digits) :]
    try:
        when = datetime.fromisoformat(head)
    except ValueError:
        return None
    return (when if when.tzinfo else when.replace(tzinfo=UTC)).astimezone(UTC)


# --- any connector as a Spark data source


@dataclass
class _Share(InputPartition):
    share: str | None


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, contents: bool, cursor: str | None):
        self.connector, self.contents, self.cursor = connector, contents, cursor

    def partitions(self) -> list[InputPartition]:
        return [_Share(s) for s in self.connector.shares()]

    def read(self, partition: _Share):
        for item in self.connector.items(partition.share, Cursor.loads(self.cursor)):
            content = note = None
            if self.contents and item.skip is None:
                try:
                    content = self.connector.fetch(item)
                except OSError as e:
                    note = f"download_failed: {type(e).__name__}"
            digest = hashlib.sha256(content).hexdigest() if content is not None else item.content_hash
            yield (
                self.connector.source_id, item.external_id, item.name, item.path, item.extension, item.size, item.modified_at, item.etag, item.author, item.library, item.web_url,
                item.skip, note, content, digest,
            )


def source_of(connector: Connector, contents: bool = True, cursor: Cursor | None = None) -> type[DataSource]:
    """A data source class over a connector, for ``spark.dataSource.register``; one task per share."""
    state = cursor.dumps() if cursor else None

    class Files(DataSource):
        @classmethod
        def name(cls) -> str:
            return "quillspark_" + "".join(c if c.isalnum() else "_" for c in connector.source_id)

        def schema(self) -> str:
            return " ".join(ITEM.split())

        def reader(self, schema) -> DataSourceReader:
            return _Reader(connector, contents, state)

    return Files


def listed(spark, connector: Connector, contents: bool = True, cursor: Cursor | None = None):
    """ITEM rows of a connector; those in ``skip`` or ``note`` have no content, and say why."""
    source = source_of(connector, contents, cursor)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def selected(sources: list[dict], wanted: list[str] | None = None) -> list[dict]:
    """Sources that are enabled and, if any are named, among those named."""
    return [s for s in sources if s.get("enabled", True) and (not wanted or s["source_id"] in wanted)]
