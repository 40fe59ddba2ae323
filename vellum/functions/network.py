"""Addresses that must not be fetched, and cookies. No fetching happens here: lanes are injected."""

from __future__ import annotations

import base64
import ipaddress
import json
import re
import time
from collections.abc import Iterable
from dataclasses import dataclass

# Ranges that are not public (fixed values).
_PRIVATE4 = [
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.168.0.0/16",
        "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
    )
]
_PRIVATE6 = [
    ipaddress.ip_network(n)
    for n in (
        "64::/16", "100::/16", "2001::/23", "2001:db8::/32", "2002::/16", "3ffe::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
    )
]
_PRIVATE_HOSTS = (".localhost", ".local", ".internal", ".home", ".lan")


def is_private_address(text: str) -> bool:
    """Whether an address is outside the public ranges; what is no address counts as private."""
    try:
        address = ipaddress.ip_address(text.strip("[]").partition("%")[0])
    except ValueError:
        return True
    if isinstance(address, ipaddress.IPv6Address):
        if int(address) >> 32 in (0, 0xFFFF):  # compatible or mapped
            return is_private_address(str(ipaddress.IPv4Address(int(address) & 0xFFFFFFFF)))
        return any(address in n for n in _PRIVATE6)
    return any(address in n for n in _PRIVATE4)


def is_private_host(name: str) -> bool:
    name = name.strip().rstrip(".").lower()
    if name in ("localhost", "localhost.localdomain") or name.endswith(_PRIVATE_HOSTS):
        return True
    try:
        ipaddress.ip_address(name.strip("[]"))
    except ValueError:
        return False
    return is_private_address(name)


_NAME = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_VALUE = re.compile(r"[\x21\x23-\x2b\x2d-\x3a\x3c-\x5b\x5d-\x7e]*")
MAX_COOKIES, MAX_COOKIE_BYTES = 4096, 1 << 20


@dataclass(frozen=True)
class Cookie:
    name: str
    value: str
    domain: str
    path: str = "/"
    host_only: bool = True
    secure: bool = False
    http_only: bool = False
    same_site: str | None = None
    expires: float | None = None

    @property
    def valid(self) -> bool:
        sound = bool(_NAME.fullmatch(self.name)) and bool(_VALUE.fullmatch(self.value.strip('"'))) and self.path.startswith("/")
        prefixed = not self.name.startswith("__Host-") or (self.secure and self.host_only and self.path == "/")
        return sound and prefixed and (self.secure or not self.name.startswith("__Secure-")) and (self.secure or self.same_site != "None")

    def sent_to(self, host: str, path: str, secure: bool, now: float) -> bool:
        host = host.lower()
        there = host == self.domain or (not self.host_only and host.endswith("." + self.domain))
        below = path == self.path or path.startswith(self.path.rstrip("/") + "/")
        return self.valid and there and below and (secure or not self.secure) and (self.expires is None or self.expires > now)


def _from_json(rows: list[dict]) -> Iterable[Cookie]:
    for r in rows:
        domain = str(r["domain"]).lower()
        expires = r.get("expires", r.get("expirationDate"))
        yield Cookie(
            str(r["name"]), str(r["value"]), domain.lstrip("."), r.get("path") or "/", bool(r.get("hostOnly", not domain.startswith("."))), bool(r.get("secure")),
            bool(r.get("httpOnly")), {"no_restriction": "None"}.get(r.get("sameSite"), r.get("sameSite")), float(expires) if expires and float(expires) > 0 else None,
        )


def _from_jar(text: str) -> Iterable[Cookie]:
    for line in text.splitlines():
        http_only = line.startswith("#HttpOnly_")
        fields = line.removeprefix("#HttpOnly_").split("\t")
        if len(fields) == 7 and (http_only or not line.startswith("#")):
            domain, wide, path, secure, expires, name, value = fields
            yield Cookie(name, value, domain.lstrip(".").lower(), path, wide.upper() != "TRUE", secure.upper() == "TRUE", http_only, None, float(expires) or None)


def _from_header(text: str, host: str) -> Iterable[Cookie]:
    for pair in text.split(";")[:MAX_COOKIES]:
        name, equals, value = pair.strip().partition("=")
        if equals:
            yield Cookie(name, value, host.lower())


def parse_cookies(payload: str, host: str) -> list[Cookie]:
    """Cookies of JSON, base64 JSON, a Netscape jar, a ``Cookie`` header or a cURL command; the last of a name holds."""
    text = payload.strip()
    header = re.search(r"""(?:-H|--header)\s+(['"])cookie:\s*(.*?)\1|(?:-b|--cookie)\s+(['"])(.*?)\3""", text, re.I | re.S) if text.startswith("curl ") else None
    if header:
        found = _from_header(header.group(2) or header.group(4) or "", host)
    elif text.startswith(("[", "{")):
        data = json.loads(text)
        found = _from_json(data if isinstance(data, list) else data.get("cookies", []))
    elif "\t" in text:
        found = _from_jar(text)
    elif re.fullmatch(r"[A-Za-z0-9+/=\s]+", text) and len(text) % 4 == 0 and base64.b64decode(text)[:1] in (b"[", b"{"):
        return parse_cookies(base64.b64decode(text).decode(), host)
    else:
        found = _from_header(re.sub(r"(?i)^cookie:\s*", "", text), host)
    kept: dict[tuple, Cookie] = {}
    size = 0
    for cookie in found:
        size += len(cookie.name) + len(cookie.value)
        if cookie.valid and size <= MAX_COOKIE_BYTES:
            kept[cookie.domain, cookie.host_only, cookie.path, cookie.name] = cookie
    return sorted(kept.values(), key=lambda c: (-len(c.path), c.name, c.domain))


def cookie_header(cookies: Iterable[Cookie], host: str, path: str, secure: bool, now: float | None = None) -> str:
    now = time.time() if now is None else now
    return "; ".join(f"{c.name}={c.value}" for c in cookies if c.sent_to(host, path, secure, now))


def cookie_jar(cookies: Iterable[Cookie]) -> str:
    lines = ["# Netscape HTTP Cookie File"]
    for c in cookies:
        domain = c.domain if c.host_only else "." + c.domain
        flags = ["FALSE" if c.host_only else "TRUE", c.path, "TRUE" if c.secure else "FALSE", str(int(c.expires or 0)), c.name, c.value]
        lines.append("\t".join([("#HttpOnly_" if c.http_only else "") + domain, *flags]))
    return "\n".join(lines) + "\n"
