"""Numbers kept in order for repeated passes, in memory that doesn't grow with their count."""

from __future__ import annotations

import tempfile
from array import array

import numpy as np

#: Numbers of a block; whole blocks go to a temporary file of the worker.
BLOCK = 1 << 16


class Spool:
    """A growing series of doubles: ``blocks`` reads it from the start as often as needed."""

    def __init__(self, block: int = BLOCK):
        self.block, self.part, self.file, self.n = block, array("d"), None, 0
        self.first = self.last = None

    def append(self, x: float) -> None:
        if not self.n:
            self.first = x
        self.last, self.n = x, self.n + 1
        self.part.append(x)
        if len(self.part) == self.block:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.file.write(self.part.tobytes())
            self.part = array("d")

    def blocks(self):
        at = 0
        while at < self.n - len(self.part):
            self.file.seek(8 * at)
            yield np.frombuffer(self.file.read(8 * self.block))
            at += self.block
        if self.part:
            yield np.array(self.part)

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        for block in self.blocks():
            yield from block.tolist()

    def mean(self) -> float:
        return float(sum(b.sum() for b in self.blocks()) / self.n)
