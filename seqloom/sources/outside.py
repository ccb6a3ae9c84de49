"""An outside aligner as a source of alignments, where one is installed. The
native one (`operators/aligner.py`) needs none."""

from __future__ import annotations

import re
import shlex
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import ALIGNMENTS

_TYPES = {"string": "object", "double": "float64", "bigint": "int64"}


def option_tokens(text: str) -> list[str]:
    """A text of options in words, with "--x" as "-x"."""
    return [re.sub(r"^--(?=[A-Za-z])", "-", word) for word in shlex.split(text)]


def version_within(text: str, least: tuple[int, ...], most: tuple[int, ...]) -> bool:
    """Whether the first dotted number in a program's greeting lies in a range."""
    found = re.search(r"\d+(?:\.\d+)+", text)
    return bool(found) and least <= tuple(map(int, found.group().split("."))) <= most


def search_outside(queries: DataFrame, name: str, sequence: str, command: list[str], options: str = "") -> DataFrame:
    """The 19-column alignment table that `command` (with `options`) prints for
    FASTA on its input. It is started once a batch; every executor needs it and
    its database. A command that fails raises; no output is no alignment."""
    words = [*command, *option_tokens(options)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fasta = "".join(f">{n}\n{s}\n" for n, s in zip(batch["name"], batch["seq"]))
            done = subprocess.run(words, input=fasta, capture_output=True, text=True)
            if done.returncode:
                raise RuntimeError(f"{words[0]} ended with {done.returncode}: {done.stderr[-500:]}")
            rows = [line.split("\t") for line in done.stdout.splitlines() if line]
            table = pd.DataFrame(rows, columns=ALIGNMENTS.names)
            yield table.astype({f.name: _TYPES[f.dataType.simpleString()] for f in ALIGNMENTS})

    own = queries.where((F.col(sequence) != "") & F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(sequence).alias("seq"))
    return own.mapInPandas(run, ALIGNMENTS)
