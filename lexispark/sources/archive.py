"""Zipped lexicons: safe staging, and writing a folder back."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from .nodes import LiftParseError

MOST_BYTES, MOST_MEMBERS = 10 << 30, 100_000


def _junk(parts: tuple[str, ...]) -> bool:
    return any(p == "__MACOSX" or p.startswith(".") for p in parts)


def stage(path: str | os.PathLike, to: Path, most_bytes: int = MOST_BYTES, most: int = MOST_MEMBERS) -> Path:
    """Extract into ``to``; the one .lift in it.  Member paths must stay inside; sizes are checked as declared and as read."""
    try:
        with zipfile.ZipFile(path) as z:
            members = z.infolist()
            if len(members) > most:
                raise LiftParseError(f"archive has more than {most} members")
            if sum(m.file_size for m in members) > most_bytes:
                raise LiftParseError(f"archive expands to more than {most_bytes} bytes")
            left, base = most_bytes, to.resolve()
            for m in members:
                name = PurePosixPath(m.filename.replace("\\", "/"))
                target = (base / name).resolve()
                if name.is_absolute() or not target.is_relative_to(base) or ":" in (name.parts or ("",))[0]:
                    raise LiftParseError(f"unsafe path in archive: {m.filename!r}")
                (target if m.is_dir() else target.parent).mkdir(exist_ok=True, parents=True)
                if m.is_dir():
                    continue
                with z.open(m) as src, target.open("wb") as dst:
                    while block := src.read(1 << 20):
                        left -= len(block)
                        if left < 0:
                            raise LiftParseError(f"archive expands to more than {most_bytes} bytes")
                        dst.write(block)
    except (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError) as e:
        raise LiftParseError(f"unreadable archive: {e}") from e
    found = [p for p in sorted(to.rglob("*.lift")) if p.is_file() and not _junk(p.relative_to(to).parts)]
    if len(found) != 1:
        raise LiftParseError(f"archive holds {len(found)} .lift files, not one")
    return found[0]


@contextlib.contextmanager
def lift_path(path: str | os.PathLike) -> Iterator[Path]:
    """The path itself, or of a .zip its staged .lift."""
    p = Path(path)
    if p.suffix.lower() != ".zip":
        yield p
        return
    with tempfile.TemporaryDirectory(prefix="lexispark-zip-") as d:
        yield stage(p, Path(d))


def zip_folder(folder: Path, target: Path, wrap: bool | str = True) -> None:
    """All files of a folder in path order, under a folder named as the archive, as ``wrap`` says, or none."""
    top = target.stem if wrap is True else wrap or ""
    fresh = target.with_name(target.name + ".part")
    with zipfile.ZipFile(fresh, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(folder.rglob("*")):
            if p.is_file() and p.resolve() not in (target.resolve(), fresh.resolve()):
                z.write(p, str(PurePosixPath(top) / p.relative_to(folder).as_posix()))
    shutil.move(fresh, target)
