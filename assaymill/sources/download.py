"""Driver-side download with retries, container checks and a provenance record; never used inside executors."""

from __future__ import annotations

import gzip
import hashlib
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

FATAL = (401, 403, 404, 410)  #: statuses that a retry does not change


def verify_container(path: Path) -> str:
    """Kind of a file by its first bytes; compressed files are read to the end, pages in place of data are refused."""
    head = path.open("rb").read(512)
    if head[:2] == b"\x1f\x8b":
        with gzip.open(path) as f:
            while f.read(1 << 20):
                pass
        return "gzip"
    if head[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(path) as z:
            if (bad := z.testzip()) is not None:
                raise ValueError(f"damaged member {bad}")
        return "zip"
    if head[:5] == b"%PDF-":
        return "pdf"
    if head.lstrip().lower().startswith((b"<!doctype html", b"<html")):
        raise ValueError("a web page came instead of the file")
    return "plain"


def download(url: str, target: Path, attempts: int = 3, wait: float = 1.0, opener: Callable = urllib.request.urlopen) -> dict:
    """Fetch to ``target`` (never overwriting) by way of a ``.part`` file; returns the provenance record."""
    if target.exists():
        raise FileExistsError(target)
    part = target.with_name(target.name + ".part")
    for n in range(1, attempts + 1):
        try:
            with opener(url) as r, part.open("wb") as f:
                told = r.headers.get("Content-Length") if getattr(r, "headers", None) else None
                while piece := r.read(1 << 20):
                    f.write(piece)
            size = part.stat().st_size
            if told is not None and int(told) != size:
                raise OSError(f"{size} of {told} bytes")
            kind = verify_container(part)
            break
        except ValueError:
            part.unlink(missing_ok=True)
            raise
        except OSError as e:
            part.unlink(missing_ok=True)
            if n == attempts or isinstance(e, urllib.error.HTTPError) and e.code in FATAL:
                raise
            time.sleep(wait)
    digest = hashlib.sha256(part.read_bytes()).hexdigest()
    os.replace(part, target)
    return {"url": url, "path": str(target), "bytes": size, "sha256": digest, "kind": kind, "at_utc": datetime.now(timezone.utc).isoformat(), "attempts": n}


def lookup(keys: list[str], fetch: Callable[[str], dict | None], per_second: float = 1 / 0.35, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict[str, dict | None]:
    """Rate-limited lookups by key (a registry's number or name); a key that stays unanswered maps to None."""
    out: dict[str, dict | None] = {}
    for k in dict.fromkeys(keys):
        out[k] = None
        for n in range(attempts):
            sleep(1 / per_second)
            try:
                out[k] = fetch(urllib.parse.quote(k))
                break
            except OSError:
                if n == attempts - 1:
                    break
    return out


def refetch_conflicts(audit: list[dict], fetch: Callable[[str], dict | None], **limits: object) -> dict[str, dict | None]:
    """Look up again, once each, the keys whose audit found a conflict."""
    return lookup(sorted({str(r["key"]) for r in audit if r.get("status") == "conflict"}), fetch, **limits)
