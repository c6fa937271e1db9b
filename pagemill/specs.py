"""The options of a job, checked on the driver before anything runs."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pagemill.operators.html import CONVERTERS

MOST_SELECTORS, MOST_SELECTOR_CHARS = 20, 200
DATA_FOLDER = PurePosixPath("/data")


def _inside_data(path: str) -> bool:
    parts: list[str] = []
    for part in (DATA_FOLDER / path).parts:
        if part == "..":
            parts = parts[:-1]
        else:
            parts.append(part)
    return PurePosixPath(*parts).is_relative_to(DATA_FOLDER)


@dataclass(frozen=True)
class JobSpec:
    url: str
    crawl_model: str | None = None
    pipeline_model: str | None = None
    reasoning_model: str | None = None
    output_path: str = "/data"
    delay_ms: int = 500
    max_concurrent: int = 3
    max_depth: int = 5
    language: str = "en"
    output_format: str = "markdown"
    converter: str | None = None
    skip_llm_cleanup: bool = False
    respect_robots_txt: bool = True
    use_native_markdown: bool = True
    use_cache: bool = False
    proxy_url: str | None = None
    content_selectors: tuple[str, ...] = ()
    noise_selectors: tuple[str, ...] = ()

    def __post_init__(self):
        wrong = []
        if urlparse(self.url).scheme not in ("http", "https") or not urlparse(self.url).hostname:
            wrong.append("url: an http or https address is needed")
        for name, low, high in (("delay_ms", 100, 60000), ("max_concurrent", 1, 10), ("max_depth", 1, 20)):
            if not low <= getattr(self, name) <= high:
                wrong.append(f"{name}: {low} to {high}")
        if self.output_format not in ("markdown", "json"):
            wrong.append("output_format: markdown or json")
        for name in ("content_selectors", "noise_selectors"):
            own = getattr(self, name)
            if len(own) > MOST_SELECTORS or any(len(s) > MOST_SELECTOR_CHARS or set(s) & set("`{}") for s in own):
                wrong.append(f"{name}: at most {MOST_SELECTORS}, of {MOST_SELECTOR_CHARS} characters, without backticks and braces")
        if not _inside_data(self.output_path):
            wrong.append(f"output_path: a folder under {DATA_FOLDER}")
        if self.proxy_url and (urlparse(self.proxy_url).scheme != "https" or not self._public(self.proxy_url)):
            wrong.append("proxy_url: a public https address")
        if self.converter is not None and self.converter not in CONVERTERS:
            wrong.append(f"converter: one of {', '.join(sorted(CONVERTERS))}")
        if not self.pipeline_model and not self.skip_llm_cleanup and not (self.converter or "").startswith("readerlm"):
            wrong.append("pipeline_model: needed unless clean-up is skipped")
        if wrong:
            raise ValueError("; ".join(wrong))

    @staticmethod
    def _public(url: str) -> bool:
        host = urlparse(url).hostname or ""
        try:
            return ipaddress.ip_address(host).is_global
        except ValueError:
            return bool(host) and host != "localhost"
