"""A data source for live pages (S7, S11-S14, F16, X8, X9): opt-in, checked against private addresses, retried and throttled."""

from __future__ import annotations

import ipaddress
import json
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, content_type string, body string, tokens int, seconds double, error string"


def check_address(url: str, allow_private: bool = False) -> None:
    """Raise ValueError if a URL has no host, resolves to a private address or does not resolve."""
    host = urlparse(url).hostname
    if not host:
        raise ValueError(f"no host in {url}")
    if allow_private:
        return
    for info in socket.getaddrinfo(host, None):
        address = ipaddress.ip_address(info[4][0])
        if not address.is_global:
            raise ValueError(f"{url} leads to {address}, which is not public")


def fetch(url: str, accept: str, timeout: float, tries: int, allow_private: bool, proxy: str = "") -> tuple:
    """A row of SCHEMA; failures are rows with an error. Tries wait 1, 2, 4 ... seconds in between."""
    began, error = time.monotonic(), ""
    for k in range(tries):
        try:
            check_address(url, allow_private)
            target = f"{proxy.rstrip('/')}/{url}" if proxy else url
            with urllib.request.urlopen(urllib.request.Request(target, headers={"Accept": accept, "User-Agent": "pagemill"}), timeout=timeout) as r:
                tokens = r.headers.get("x-markdown-tokens", "")
                body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                return url, r.status, r.headers.get_content_type(), body, int(tokens) if tokens.isdigit() else None, time.monotonic() - began, None
        except urllib.error.HTTPError as e:
            if e.code < 500:
                return url, e.code, e.headers.get_content_type(), None, None, time.monotonic() - began, str(e)
            error = str(e)
        except ValueError as e:
            return url, None, None, None, None, time.monotonic() - began, str(e)
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
        if k + 1 < tries:
            time.sleep(2**k)
    return url, None, None, None, None, time.monotonic() - began, error


class WebSource(DataSource):
    """format("web") with options urls (a JSON array), accept, proxy, timeout, tries, delay (seconds) and allowPrivate.

    URLs of one host are one partition, so that the delay holds for each host.
    """

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WebReader:
        return WebReader(dict(self.options))


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[HostPartition]:
        hosts: dict[str, list[str]] = {}
        for url in json.loads(self.options["urls"]):
            hosts.setdefault(urlparse(url).netloc, []).append(url)
        return [HostPartition(v) for v in hosts.values()]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        o = self.options
        for k, url in enumerate(partition.urls):
            if k:
                time.sleep(float(o.get("delay", "0.5")))
            yield fetch(url, o.get("accept", "text/markdown, text/html;q=0.9"), float(o.get("timeout", "30")), int(o.get("tries", "3")), o.get("allowprivate", "false") == "true", o.get("proxy", ""))
