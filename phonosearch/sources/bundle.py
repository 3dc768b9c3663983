"""A zip of reviewed files with a pinned digest: a plain utility beside the Spark jobs."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import stat
import zipfile
from pathlib import Path

POLICY = "policy.json"
TOTAL, EACH = 900 << 20, 95 << 20


def sha256_of(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def inside(root: Path, name: str) -> Path:
    target = (root / name).resolve()
    if not target.is_relative_to(root.resolve()):
        raise ValueError(f"{name} leads out of the folder")
    return target


def create(root: str, names: list[str], policy: dict, output: str, patterns: tuple[str, ...]) -> str:
    """Packs the named files, which must fit one of the patterns, and the policy; gives the zip's SHA-256. Equal files give an equal zip."""
    base = Path(root)
    if len(set(names)) != len(names) or not all(any(re.fullmatch(p, n) for p in patterns) for n in names):
        raise ValueError("a name comes twice or fits no pattern")
    contents = {}
    for n in sorted(names):
        if (base / n).is_symlink():
            raise ValueError(f"{n} is a link")
        contents[n] = inside(base, n).read_bytes()
    contents[POLICY] = json.dumps(policy, sort_keys=True).encode()
    with zipfile.ZipFile(output, "w", zipfile.ZIP_STORED) as z:
        for n, raw in contents.items():
            z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), raw)
    return sha256_of(output)


def restore(root: str, archive: str, pin: str, patterns: tuple[str, ...]) -> list[str]:
    """Unpacks a zip with the pinned digest and a reviewed policy; everything is checked before the first file is written."""
    if sha256_of(archive) != pin:
        raise ValueError("the bundle is not the pinned one")
    base = Path(root)
    with zipfile.ZipFile(archive) as z:
        entries = [e for e in z.infolist() if e.filename != POLICY]
        names = [e.filename for e in entries]
        policy = json.loads(z.read(POLICY)) if POLICY in z.namelist() else {}
        if policy.get("reviewed") is not True:
            raise ValueError("the bundle was not reviewed")
        if len(set(names)) != len(names) or sum(e.file_size for e in entries) > TOTAL:
            raise ValueError("a name comes twice, or the bundle is too large")
        for e in entries:
            if e.file_size > EACH or stat.S_ISLNK(e.external_attr >> 16) or not any(re.fullmatch(p, e.filename) for p in patterns):
                raise ValueError(f"{e.filename} is not allowed")
            inside(base, e.filename)
        for e in entries:
            target = inside(base, e.filename)
            target.parent.mkdir(parents=True, exist_ok=True)
            with z.open(e) as source, open(target, "wb") as out:
                shutil.copyfileobj(source, out)
    return names
