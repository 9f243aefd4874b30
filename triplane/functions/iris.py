"""References resolved against a base IRI (RFC 3986, section 5.2), whatever the scheme."""

from __future__ import annotations

import re

_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.DOTALL)


def _without_dots(path: str) -> str:
    if "." not in path:
        return path
    out: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "..":
            if len(out) > (1 if path.startswith("/") else 0):
                out.pop()
            if last:
                out.append("")
        elif s == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    return "/".join(out)


def resolve_iri(base: str, reference: str) -> str:
    scheme, host, path, query, fragment = _PARTS.fullmatch(reference).groups()
    if scheme is not None or not base:
        return reference
    scheme, base_host, base_path, base_query, _ = _PARTS.fullmatch(base).groups()
    if host is None:
        host = base_host
        if not path:
            path, query = base_path, base_query if query is None else query
        elif not path.startswith("/"):
            path = _without_dots(("/" if base_host is not None and not base_path else base_path.rpartition("/")[0] + "/" if "/" in base_path else "") + path)
        else:
            path = _without_dots(path)
    out = f"{scheme}:" if scheme else ""
    out += f"//{host}" if host is not None else ""
    return out + path + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")
