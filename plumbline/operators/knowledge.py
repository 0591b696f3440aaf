"""Knowledge pages beside the numbers: references, drift, staleness, live values, pruning."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timedelta


@dataclass(frozen=True)
class Page:
    id: str
    body: str = ""
    summary: str = ""
    tags: tuple[str, ...] = ()
    refs: tuple[str, ...] = ()
    sl_refs: tuple[str, ...] = ()
    scope: str = "global"
    fingerprints: tuple[tuple[str, str], ...] = ()
    validated: datetime | None = None


def expand(pages: Mapping[str, Page], start: str, depth: int = 2, most: int = 50) -> list[str]:
    """Pages around one, breadth first in the order of ids."""
    seen, queue, out = {start}, deque([(start, 0)]), []
    while queue and len(out) < most:
        at, d = queue.popleft()
        out.append(at)
        for ref in sorted(pages[at].refs) if d < depth else ():
            if ref in pages and ref not in seen:
                seen.add(ref)
                queue.append((ref, d + 1))
    return out


def drifted(page: Page, live: Mapping[str, str]) -> list[str]:
    """References whose definition isn't what it was when the page was written."""
    return sorted(ref for ref, was in page.fingerprints if ref in live and live[ref] != was)


def stale(page: Page, now: datetime, window: timedelta) -> bool:
    return page.validated is None or now - page.validated > window


def broken(pages: Mapping[str, Page], known: set[str]) -> list[str]:
    """References that lead nowhere, or from a global page to a user's."""
    out = []
    for page in pages.values():
        for ref in page.refs:
            if ref not in pages:
                out.append(f"{page.id}: page {ref} is gone")
            elif page.scope == "global" and pages[ref].scope != "global":
                out.append(f"{page.id}: {ref} isn't visible to all")
        out += [f"{page.id}: {ref} is no definition" for ref in page.sl_refs if ref not in known]
    return sorted(out)


def pruned(pages: Mapping[str, Page], known: set[str]) -> dict[str, Page]:
    """The pages without references that lead nowhere."""
    return {
        i: replace(p, refs=tuple(r for r in p.refs if r in pages), sl_refs=tuple(r for r in p.sl_refs if r in known)) for i, p in pages.items()
    }


_LIVE = re.compile(r"\{\{\s*sl:([\w.]+)\s*\}\}")


def rendered(text: str, value: Callable[[str], str | None]) -> str:
    """``{{ sl:path }}`` replaced by its value; what has none stays as it is."""
    return _LIVE.sub(lambda m: m[0] if (found := value(m[1])) is None else found, text)
