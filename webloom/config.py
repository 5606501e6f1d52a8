"""Settings of a crawl analysis, as frozen dataclasses with the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scope:
    field_scope: str = "rdn"  # rdn, dn, fqdn or a regular expression on the host
    in_patterns: tuple[str, ...] = ()
    out_patterns: tuple[str, ...] = ()
    no_scope: bool = False


@dataclass(frozen=True)
class Policy:
    exclude_private: bool = False
    deny: tuple[str, ...] = ()


@dataclass(frozen=True)
class Extensions:
    match: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    use_defaults: bool = True


@dataclass(frozen=True)
class Limits:
    max_depth: int = 3
    max_pages_per_root: int = 0
    body_bytes: int = 4 * 1024 * 1024
    trie_threshold: int = 10


@dataclass(frozen=True)
class Crawl:
    scope: Scope = field(default_factory=Scope)
    policy: Policy = field(default_factory=Policy)
    extensions: Extensions = field(default_factory=Extensions)
    limits: Limits = field(default_factory=Limits)
    ignore_query_params: bool = False
    filter_similar: bool = False
    has_credentials: bool = False
    path_climb: bool = False
    js_crawl: bool = False
    known_files: str = ""  # all, robotstxt, sitemapxml or nothing
    display_out_scope: bool = False
    pin_root: bool = False
