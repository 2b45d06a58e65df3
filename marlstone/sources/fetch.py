"""Fetching under a policy: schemes, addresses, redirects, sizes and rates are checked before and after every hop.

The network comes in as two functions, so everything here runs, and is tested, without one:
``resolve(host) -> [address, ..]`` and ``transport(request) -> Response``, which must connect to the
address it is given and to no other.
"""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

from marlstone.sources.web import blocked_reason, parse_ip


class FetchError(RuntimeError):
    """A fetch that the policy refuses or that went wrong; ``category`` says why."""

    def __init__(self, category: str, message: str):
        super().__init__(f"{category}: {message}")
        self.category = category


@dataclass(frozen=True)
class Policy:
    """Bounds of a fetch (fixed values: the defaults)."""

    schemes: tuple[str, ...] = ("http", "https")
    item_bytes: int = 20 << 20
    inflated_bytes: int = 100 << 20
    max_items: int = 1000
    timeout: float = 30.0
    redirects: int = 5
    per_second: float = 1.0


@dataclass(frozen=True)
class Request:
    """One hop: where to connect, and what to ask of whom."""

    scheme: str
    host: str
    port: int
    address: str
    target: str
    timeout: float
    max_bytes: int


@dataclass
class Response:
    status: int
    headers: dict[str, str]
    body: bytes


@dataclass
class Fetcher:
    """Fetches URLs; keeps the time of the last request to each host."""

    transport: Callable[[Request], Response]
    resolve: Callable[[str], list[str]]
    policy: Policy = field(default_factory=Policy)
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: dict[str, float] = field(default_factory=dict)

    def fetch(self, url: str) -> tuple[str, Response]:
        """The final URL and its response, decoded; every redirect is checked as the first URL was."""
        for _ in range(self.policy.redirects + 1):
            response = self._hop(url)
            if response.status not in (301, 302, 303, 307, 308):
                if response.status >= 400:
                    raise FetchError("status", f"{url} answered {response.status}")
                return url, Response(response.status, response.headers, self._inflate(response))
            where = response.headers.get("location")
            if not where:
                raise FetchError("redirect", f"{url} redirects nowhere")
            url = urljoin(url, where)
        raise FetchError("redirect", f"more than {self.policy.redirects} redirects")

    def _hop(self, url: str) -> Response:
        p = self.policy
        try:
            parts = urlsplit(url)
            host, port = parts.hostname, parts.port
        except ValueError as e:
            raise FetchError("malformed", str(e)) from e
        if parts.scheme not in p.schemes:
            raise FetchError("scheme", f"{parts.scheme or 'no scheme'} is not allowed")
        if not host:
            raise FetchError("malformed", "no host")
        if parts.username or parts.password:
            raise FetchError("credentials", "credentials in a URL")
        address = self._pin(host)
        wait = self.last.get(host, -1e9) + 1 / p.per_second - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.last[host] = self.clock()
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        response = self.transport(Request(parts.scheme, host, port or (443 if parts.scheme == "https" else 80), address, target, p.timeout, p.item_bytes))
        if len(response.body) > p.item_bytes:
            raise FetchError("size", f"{url} is larger than {p.item_bytes} bytes")
        response.headers = {k.lower(): v for k, v in response.headers.items()}
        return response

    def _pin(self, host: str) -> str:
        """The address to connect to; every address of a name must be public, so none can be swapped in later."""
        if host == "localhost" or host.endswith(".localhost"):
            raise FetchError("loopback", host)
        literal = parse_ip(host)
        found = [str(literal)] if literal else self.resolve(host)
        if not found:
            raise FetchError("resolve", f"{host} has no address")
        for a in found:
            if reason := blocked_reason(a):
                raise FetchError(reason, f"{host} is at {a}")
        return found[0]

    def _inflate(self, response: Response) -> bytes:
        how = response.headers.get("content-encoding", "").lower().strip()
        if how in ("", "identity"):
            return response.body
        if how not in ("gzip", "x-gzip", "deflate"):
            raise FetchError("encoding", how)
        for bits in ((31,) if "gzip" in how else (15, -15)):  # deflate comes with and without a header
            stream = zlib.decompressobj(bits)
            try:
                body = stream.decompress(response.body, self.policy.inflated_bytes + 1)
            except zlib.error:
                continue
            if len(body) > self.policy.inflated_bytes:
                raise FetchError("size", "the inflated body is too large")
            return body
        raise FetchError("encoding", f"a damaged {how} body")


def system_resolve(host: str) -> list[str]:
    """Addresses of a name by the system."""
    try:
        return sorted({str(ipaddress.ip_address(i[4][0].split("%")[0])) for i in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)})
    except OSError as e:
        raise FetchError("resolve", f"{host}: {e}") from e


class _Pinned(http.client.HTTPConnection):
    """A connection to a fixed address that names the original host in TLS and in the Host header."""

    def __init__(self, request: Request):
        super().__init__(request.host, request.port, timeout=request.timeout)
        self.request_ = request

    def connect(self) -> None:
        self.sock = socket.create_connection((self.request_.address, self.request_.port), self.timeout)
        if self.request_.scheme == "https":
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.request_.host)


def pinned_transport(request: Request) -> Response:
    """One request over the pinned connection; at most one byte beyond the limit is read."""
    connection = _Pinned(request)
    try:
        connection.request("GET", request.target, headers={"Accept-Encoding": "gzip, deflate", "User-Agent": "marlstone"})
        answer = connection.getresponse()
        return Response(answer.status, dict(answer.getheaders()), answer.read(request.max_bytes + 1))
    except (OSError, http.client.HTTPException) as e:
        raise FetchError("transport", f"{request.host}: {e}") from e
    finally:
        connection.close()


