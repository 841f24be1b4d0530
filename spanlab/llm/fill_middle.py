"""Fill-in-the-middle: a text becomes prefix, suffix and middle, cut between whole units, in one of two orders.

A text is held as its maximal runs of one character class (run-length encoding), each with the number of units that are
complete at its end. A cut after so many units is found by binary search of these cumulative counts, and its place is plain
arithmetic: in a run whose every character ends a unit it is the run's start plus what is left of the count, in any other
run it is the run's end. No unit is ever cut out or listed, so a text of a million lines costs the number of its runs.

Units are `line` (up to and with a line feed), `word` (a run without ASCII white space with the white space that follows;
white space at the start of a text is a unit of its own) or `char` (a code point). Cuts and forms are drawn from the
SHA-256 of `seed:` and the decimal identifier, so a rerun has the same.

Forms: `psm` is prefix, suffix, middle; `spm` is suffix, prefix, middle; each part stands after its sentinel. `plain` texts
stay as they are: empty ones, those that contain a sentinel, and those that the rate leaves out. `restored` gets the text
back from an output and its form alone.

Defined cases: a null text counts as empty; a null identifier draws from the digest of `seed:`; rows that repeat an
identifier draw the same numbers; parts may be empty; a table's other columns aren't read, so their names can't clash; an
empty table gives an empty result. Sentinels that could overlap one another are refused, since outputs would be ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of output after which a batch is passed on.
_PASSED = 8 << 20
_CLASSES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "line": lambda codes: codes == 10,
    "word": lambda codes: (codes == 32) | ((codes >= 9) & (codes <= 13)),
    "char": lambda codes: np.ones(len(codes), bool),
}


@dataclass
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.marks
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different sentinels are needed")
        for a in marks:
            for b in marks:
                if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or (a != b and a in b):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class ClassRuns:
    """Maximal runs of a text's two character classes, with the units that are complete at the end of each."""

    def __init__(self, text: str, unit: str = "line"):
        closing = _CLASSES[unit](np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        bounds = np.flatnonzero(closing[1:] != closing[:-1]) + 1
        self.start = np.concatenate(([0], bounds)) if len(closing) else np.empty(0, int)
        self.end = np.concatenate((bounds, [len(closing)])) if len(closing) else np.empty(0, int)
        ends_units = closing[self.start]
        #: Of a run that ends units: one a character, or one for the whole run.
        self.single = ends_units & (unit != "word")
        complete = np.where(self.single, self.end - self.start, ends_units.astype(int))
        if len(complete) and not ends_units[-1]:
            complete[-1] = 1  # what follows the last end of a unit is a unit too
        self.complete = np.cumsum(complete)

    @property
    def units(self) -> int:
        return int(self.complete[-1]) if len(self.complete) else 0

    def offset(self, units: int) -> int:
        """Where the first so many units end, in code points."""
        if units == 0:
            return 0
        run = int(np.searchsorted(self.complete, units))
        if not self.single[run]:
            return int(self.end[run])
        before = int(self.complete[run - 1]) if run else 0
        return int(self.start[run]) + units - before


def drawn(identifier: Column, seed: int | str) -> list[Column]:
    """Four numbers below 2 ** 32: the first groups of eight digits of the SHA-256 of `seed:` and the identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def _transformed(unit: str, percent: int, spm_percent: int, marks: Sentinels):
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def cut(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        runs = ClassRuns(text, unit)
        n = runs.units
        if not text or h3 % 100 >= percent or any(m in text for m in marks.marks):
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = runs.offset(a), runs.offset(b)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, "".join((marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle))
        return n, "psm", a, b - a, "".join((marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            numbers = [batch.column(k).to_pylist() for k in range(2, 6)]
            rows, begun, held = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                rows.append(cut(text.as_py() or "", *(h[k] for h in numbers)))
                held += len(rows[-1][-1])
                if held >= _PASSED or k + 1 == batch.num_rows:
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(rows)), *columns], names)
                    rows, begun, held = [], k + 1, 0

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", percent: int = 100,
    spm_percent: int = 50, seed: int | str = 7, sentinels: Sentinels | None = None,
) -> DataFrame:
    """One row for each document: identifier, n (units), form, prefix_chars, middle_chars (null if plain) and output.

    percent of the documents are transformed, spm_percent of those with the suffix first. Works within its row, in Arrow
    batches: nothing is shuffled.
    """
    if unit not in _CLASSES:
        raise ValueError(f"units are {sorted(_CLASSES)}")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *drawn(docs[id_col], seed))
    run = _transformed(unit, percent, spm_percent, sentinels or Sentinels())
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: Sentinels | None = None) -> Column:
    """The text that an output was made of. A text with a sentinel is never transformed, so the first three are the marks."""
    marks = sentinels or Sentinels()
    # Java's \Q...\E would end at an \E of a mark; single characters are quoted instead.
    parts = F.split(output, "|".join(re.sub(r"([^\w])", r"\\\1", m) for m in marks.marks), 4)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
