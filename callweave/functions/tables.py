"""Table functions and aggregates that SQL can call: sections, splits and speech segments by lateral joins, an upper median."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from callweave.operators.calls import SpeechRules
from callweave.operators.chunk import MIN, OVERLAP, TARGET

_HEAD = re.compile(r"(#{1,4})[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]")
_END = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n")
_BLANK = " \t\n\x0b\f\r"


def _words(text: str) -> list[str]:
    return [w for w in re.split(f"[{_BLANK}]+", text) if w]


class Sections:
    """(section, heading_path, content) of a body, as chunk.sections has them."""

    def eval(self, body: str | None) -> Iterator[tuple[int, list[str], str]]:
        stack: list[tuple[int, str]] = []
        held: list[str] = []
        n = 0
        for line in [*(body or "").split("\n"), None]:
            head = _HEAD.match(line.strip(_BLANK)) if line is not None else None
            if line is not None and not head:
                held.append(line)
                continue
            if content := "\n".join(held).strip(_BLANK):
                yield n, [title for _, title in stack], content
                n += 1
            held = []
            if head:
                level = len(head[1])
                stack = [x for x in stack if x[0] < level] + [(level, line.strip(_BLANK)[level:].strip(_BLANK))]


class Splits:
    """(piece, content) of a text that is too long, as chunk.split_long has them."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        done: list[str] = []
        now: list[str] = []
        n = 0
        for unit in _END.split(text or ""):
            words = _words(unit)
            for part in [unit] if len(words) <= TARGET else [" ".join(words[i : i + TARGET]) for i in range(0, len(words), TARGET)]:
                size = len(_words(part))
                if not size:
                    continue
                if now and n + size > TARGET:
                    done.append(" ".join(now))
                    tail = _words(done[-1])[-OVERLAP:]
                    now, n = [" ".join(tail)], len(tail)
                now.append(part)
                n += size
        last = " ".join(now)
        if done and now and len(_words(last)) < MIN:
            done[-1] += " " + last
        elif now:
            done.append(last)
        yield from enumerate(done)


class Segments:
    """(segment, first_frame, end_frame) of a channel's levels, frame by frame, as calls.speech_segments has them."""

    def eval(self, levels: list[float] | None, level: float, frame: float) -> Iterator[tuple[int, int, int]]:
        runs: list[tuple[int, int]] = []
        for k, x in enumerate(levels or []):
            if x is not None and x >= level:
                runs[-1:] = [(runs[-1][0], k)] if runs and runs[-1][1] == k - 1 else [*runs[-1:], (k, k)]
        for n, (a, b) in enumerate(SpeechRules.of(frame).split(runs)[0], 1):
            yield n, a, b


#: Name, class, and columns of each table function.
TABLES = {
    "heading_sections": (Sections, "section int, heading_path array<string>, content string"),
    "split_long": (Splits, "piece int, content string"),
    "speech_segments": (Segments, "segment int, first_frame int, end_frame int"),
}


@F.arrow_udf(DoubleType())
def upper_median(values: pa.Array) -> float | None:
    """The middle value, of an even number the larger of the two; null of none. A group's values meet in one task: for
    groups of any size take reports.upper_median."""
    some = values.drop_null()
    return some.take(pc.array_sort_indices(some))[len(some) // 2].as_py() if len(some) else None


def register(spark: SparkSession) -> None:
    """Makes the table functions and upper_median known to SQL: `SELECT ... FROM t, LATERAL heading_sections(t.body) s`."""
    for name, (kind, columns) in TABLES.items():
        spark.udtf.register(name, F.udtf(kind, returnType=columns))
    spark.udf.register("upper_median", upper_median)
