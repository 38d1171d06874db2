"""Releases of trace archives: parts put together, unpacked, and checked before and after."""

from __future__ import annotations

import shutil
import tarfile
from collections.abc import Callable
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame


class GateError(RuntimeError):
    """A release that must not be used."""


class Parts:
    """Files read one after the other, as one stream."""

    def __init__(self, paths: list[str]):
        self.left, self.now = [Path(p) for p in paths], None

    def read(self, n: int = -1) -> bytes:
        out = []
        while n != 0 and (self.now or self.left):
            self.now = self.now or self.left.pop(0).open("rb")
            data = self.now.read(n)
            if not data:
                self.now.close()
                self.now = None
                continue
            out.append(data)
            n -= len(data) if n > 0 else 0
        return b"".join(out)


def fetch(parts: list[str], folder: str, get: Callable[[str], IO[bytes]], tries: int = 3) -> list[str]:
    """The parts in a folder, each tried some times; a part that is there whole is not fetched again."""
    out = []
    for name in parts:
        target, half = Path(folder, Path(name).name), Path(folder, f".{Path(name).name}")
        for turn in range(tries):
            if target.exists():
                break
            try:
                with get(name) as source, half.open("wb") as sink:
                    shutil.copyfileobj(source, sink)
                half.rename(target)
            except OSError:
                if turn == tries - 1:
                    raise
        out.append(str(target))
    return out


def unpack(parts: list[str], folder: str, spare: float = 1.2) -> int:
    """Unpacks the archive that the parts make up; the number of files. Too little room, by the parts' size, is an error beforehand."""
    need = spare * sum(Path(p).stat().st_size for p in parts)
    free = shutil.disk_usage(folder).free
    if free < need:
        raise GateError(f"{folder} has {free} bytes free, {need:.0f} are needed")
    n = 0
    with tarfile.open(fileobj=Parts(sorted(parts)), mode="r|*") as tar:
        for m in tar:
            if m.isfile():
                tar.extract(m, folder, filter="data")
                n += 1
    return n


def row_gate(df: DataFrame, least: int, most: int | None = None) -> int:
    """The number of rows; an error where it is outside the bounds."""
    n = df.count()
    if n < least or (most is not None and n > most):
        raise GateError(f"{n} rows, expected {least} to {most or 'any number'}")
    return n
