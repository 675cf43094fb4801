"""Raw files from a base URL to the lake, by way of a local staging folder."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Sequence
from pathlib import Path

from .lake import Location

BLOCK = 1 << 20


def whole(path: Path) -> bool:
    """Whether a file is there and, if its name ends in ``.gz``, decompresses to its end."""
    if not path.is_file():
        return False
    if path.suffix != ".gz":
        return True
    try:
        with gzip.open(path) as stream:
            while stream.read(BLOCK):
                pass
    except (OSError, EOFError, zlib.error):
        return False
    return True


def sha256(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def download(url: str, path: Path, tries: int = 3, pause: float = 1.0) -> None:
    """Fetch a URL; a file cut short goes on where it ended if the server allows it."""
    for left in range(tries - 1, -1, -1):
        have = path.stat().st_size if path.is_file() else 0
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have and url.startswith("http") else {})
        try:
            with urllib.request.urlopen(request) as source, path.open("ab" if getattr(source, "status", None) == 206 else "wb") as out:
                while block := source.read(BLOCK):
                    out.write(block)
            return
        except urllib.error.HTTPError as e:
            if e.code == 416:  # nothing is left to send, so what is here is no start of the file, or all of it
                if whole(path):
                    return
                path.unlink()
            elif e.code < 500 or not left:
                raise
        except OSError:
            if not left:
                raise
        time.sleep(pause)
    raise OSError(f"{url} could not be fetched")


def fetch(base_url: str, names: Sequence[str], staging: str, target: Location) -> dict[str, str]:
    """Every file to ``target``, with SHA256SUMS and the time beside them; name -> digest.

    A file that stands whole in the staging folder is not fetched again.
    """
    folder = Path(staging)
    folder.mkdir(parents=True, exist_ok=True)
    target.make()
    sums = {}
    for name in names:
        path = folder / name
        if not whole(path):
            download(f"{base_url.rstrip('/')}/{name}", path)
        if not whole(path):
            path.unlink()
            raise OSError(f"{name} is damaged")
        sums[name] = sha256(path)
        (target / name).put(str(path))
    (target / "SHA256SUMS").write_text("".join(f"{digest}  {name}\n" for name, digest in sums.items()))
    (target / "downloaded_at_utc.txt").write_text(datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") + "\n")
    return sums
