"""HTTP with patience: retries, waits that servers ask for, tokens that expire; for drives, embeddings and recognition alike."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin

from quillspark.sources.egress import Policy


@dataclass
class Answer:
    status: int
    headers: dict[str, str]
    body: bytes

    def json(self) -> dict:
        return json.loads(self.body)


class Failed(OSError):
    """A request that was given up."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Patience:
    """How often a request is made and how long is waited between; waits are the same each time, so that runs can be repeated."""

    # Seconds of waits and their shifts, and statuses that may pass.
    attempts: int = 5
    first: float = 1.0
    most: float = 60.0
    most_asked: float = 300.0  # of what a server asks for
    shifts: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)
    statuses: frozenset[int] = frozenset({429, 500, 502, 503, 504})

    def wait(self, attempt: int) -> float:
        """Seconds after the attempt of this number, from 1."""
        return min(self.most, self.first * 2.0 ** max(0, attempt - 1) + self.shifts[(attempt - 1) % len(self.shifts)])

    def asked(self, header: str | None, now: datetime | None = None) -> float | None:
        """Seconds that a Retry-After header names, as a number or a date."""
        text = (header or "").strip()
        if not text:
            return None
        try:
            seconds = float(text)
        except ValueError:
            try:
                when = parsedate_to_datetime(text)
            except (TypeError, ValueError):
                return None
            when = when if when.tzinfo else when.replace(tzinfo=UTC)
            seconds = (when - (now or datetime.now(UTC))).total_seconds()
        return min(self.most_asked, max(0.0, seconds))


#: Patience with embedding and recognition services.
SERVICE = Patience(attempts=4, first=0.5, most=8.0, shifts=(0.0,), statuses=frozenset({408, 425, 429, 500, 502, 503, 504}))


def transport(method: str, url: str, headers: dict[str, str], body: bytes | None, timeout: float) -> Answer:
    """One request by the standard library."""
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310 (the policy has checked the address)
            return Answer(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read())
    except urllib.error.HTTPError as e:
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read())


@dataclass
class Client:
    """Requests below an address. ``token(fresh)`` gives the bearer token, a new one if ``fresh``."""

    base: str
    category: str
    policy: Policy
    patience: Patience = field(default_factory=Patience)
    token: Callable[[bool], str] | None = None
    timeout: float = 30.0
    send: Callable[..., Answer] = transport
    sleep: Callable[[float], None] = time.sleep

    def request(self, method: str, url: str, body: object = None, headers: dict[str, str] | None = None) -> Answer:
        """The answer of the first attempt that succeeds; an expired token is renewed once."""
        url = urljoin(self.base.rstrip("/") + "/", url)
        self.policy.check(url, self.category)
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        renewed, why = False, ""
        for attempt in range(1, self.patience.attempts + 1):
            own = {"Accept": "application/json", **({"Content-Type": "application/json"} if data is not None else {}), **(headers or {})}
            if self.token:
                own["Authorization"] = "Bearer " + self.token(renewed)
            pause = None
            try:
                answer = self.send(method, url, own, data, self.timeout)
            except OSError as e:
                why = type(e).__name__
            else:
                if answer.status < 400:
                    return answer
                why = f"status {answer.status}"
                if answer.status == 401 and self.token and not renewed:
                    renewed = True
                    continue
                if answer.status not in self.patience.statuses:
                    raise Failed(why, answer.status)
                pause = self.patience.asked(answer.headers.get("retry-after"))
            if attempt < self.patience.attempts:
                self.sleep(self.patience.wait(attempt) if pause is None else pause)
        raise Failed(f"given up after {self.patience.attempts} attempts: {why}")

    def paged(self, url: str) -> Iterator[dict]:
        """The entries of a listing and of the pages that it links to; a page that links to one seen before ends it."""
        seen = set()
        while url and url not in seen:
            seen.add(url)
            page = self.request("GET", url).json()
            yield from page.get("value", [])
            url = page.get("@odata.nextLink")

    def changes(self, url: str) -> tuple[list[dict], str | None]:
        """All entries of a change feed, and where the next one begins."""
        found, link, seen = [], None, set()
        while url and url not in seen:
            seen.add(url)
            page = self.request("GET", url).json()
            found += page.get("value", [])
            link, url = page.get("@odata.deltaLink", link), page.get("@odata.nextLink")
        return found, link

    def download(self, url: str, size: int | None = None) -> tuple[bytes, str]:
        """A file and its SHA-256; another size than was announced is an error."""
        body = self.request("GET", url, headers={"Accept": "*/*"}).body
        if size is not None and size >= 0 and len(body) != size:
            raise Failed(f"{len(body)} bytes came, {size} were announced")
        return body, hashlib.sha256(body).hexdigest()
