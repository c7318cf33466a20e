"""Which hosts may be spoken to: none, unless their category is enabled and lists them."""

from __future__ import annotations

from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from urllib.parse import urlsplit

# Hosts of each category.
HOSTS = {
    "microsoft_graph": ("graph.microsoft.com", "*.graph.microsoft.com", "login.microsoftonline.com", "*.login.microsoftonline.com", "login.microsoft.com", "*.sharepoint.com"),
    "model_download": ("huggingface.co", "cdn-lfs.huggingface.co", "cdn-lfs-us-1.huggingface.co", "*.hf.co"),
    "internal_api": (),
    "vector_db": (),
    "ocr_api": (),
}
LOCAL = frozenset({"localhost", "127.0.0.1", "::1"})


class EgressError(PermissionError):
    """A connection that the policy forbids."""


@dataclass
class Policy:
    enabled: set[str] = field(default_factory=set)
    more_hosts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    plain_local: bool = False  # http to this machine

    def allows_host(self, host: str, category: str) -> bool:
        """Connections to this machine don't leave it; others need their category and a place in its list."""
        name = host.lower()
        patterns = (*HOSTS.get(category, ()), *self.more_hosts.get(category, ()))
        return name in LOCAL or (category in self.enabled and any(fnmatchcase(name, p) for p in patterns))

    def check(self, url: str, category: str) -> str:
        """The host of an address that may be spoken to; an error for any other."""
        parts = urlsplit(url)
        host, scheme = (parts.hostname or "").lower(), parts.scheme.lower()
        if not host:
            raise EgressError("an address without a host")
        secure = scheme == "https" or (scheme == "http" and host in LOCAL and self.plain_local)
        if not secure:
            raise EgressError(f"{scheme or 'no scheme'} to {host} is not allowed")
        if not self.allows_host(host, category):
            raise EgressError(f"{host} is not allowed for {category}")
        return host
