"""Calls of engines for text recognition and captions: a few at once, each within its time, results in order."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Calls at once in a task, seconds that one may take, and code points of recognised text that a caption is told.
CONCURRENT, SECONDS, HINT_CHARS = 3, 60.0, 3000
#: Sides that an image must have to be captioned, and images that are captioned in a file and on a slide (0: all).
LEAST_WIDTH, LEAST_HEIGHT, PER_FILE, PER_SLIDE = 100, 100, 0, 0


def in_time(calls: Iterable[Callable[[], object]], most: int = CONCURRENT, seconds: float = SECONDS) -> list:
    """The results of ``calls`` in their order, ``most`` running at once. One that raises, or takes longer than ``seconds``, gives None; it is not waited for any longer."""
    done: queue.SimpleQueue = queue.SimpleQueue()
    out, running = [], {}

    def run(number: int, call: Callable[[], object]) -> None:
        try:
            done.put((number, call()))
        except Exception:  # an engine's failure is a missing result
            done.put((number, None))

    def settle() -> None:
        try:
            number, result = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
            if running.pop(number, None) is not None:  # else it came too late
                out[number] = result
        except queue.Empty:
            for number in [n for n, until in running.items() if until <= time.monotonic()]:
                del running[number]

    for number, call in enumerate(calls):
        while len(running) >= most:
            settle()
        out.append(None)
        running[number] = time.monotonic() + seconds
        threading.Thread(target=run, args=(number, call), daemon=True).start()
    while running:
        settle()
    return out


def called(df: DataFrame, out: str, engine: Callable[..., str | None], *args: str, when: Column | None = None, most: int = CONCURRENT, seconds: float = SECONDS) -> DataFrame:
    """``df`` with ``out``, what ``engine`` says of the columns ``args``, trimmed; null where ``when`` does not hold, nothing is said, or it fails or takes too long."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    wanted = df.withColumn("_wanted", F.coalesce(when, F.lit(False)) if when is not None else F.lit(True))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chosen = [k for k, w in enumerate(frame["_wanted"]) if w]
            rows = [tuple(bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else None if v is None or v != v else v for v in (frame[a].iloc[k] for a in args)) for k in chosen]
            said: list[str | None] = [None] * len(frame)
            for k, text in zip(chosen, in_time([lambda r=r: engine(*r) for r in rows], most, seconds)):
                said[k] = text.strip() or None if isinstance(text, str) else None
            frame = frame.drop(columns="_wanted")
            frame[out] = pd.Series(said, dtype=object, index=frame.index)
            yield frame

    return wanted.mapInPandas(each, schema)


@dataclass(frozen=True)
class Engines:
    """What reads images: ``recognise(image)`` and ``caption(image, hint)``; without a caption engine nothing is captioned. Limits as above."""

    recognise: Callable[[bytes], str | None]
    caption: Callable[[bytes, str | None], str | None] | None = None
    least_width: int = LEAST_WIDTH
    least_height: int = LEAST_HEIGHT
    per_file: int = PER_FILE
    per_slide: int = PER_SLIDE
    concurrent: int = CONCURRENT
    seconds: float = SECONDS


def recogniser(decode: Callable[[bytes], object], engine: Callable[[object, str], str | None], languages: tuple[str, ...] = ("eng+vie", "vie", "eng")) -> Callable[[bytes], str | None]:
    """A recogniser that takes the first text over the variants of an image and, for each, the languages; texts are cleaned, and one that fails is passed over.

    ``decode`` gives pixels (height, width, 3), or None; ``engine`` reads pixels in a language.
    """
    from ragloom.functions.images import variants
    from ragloom.operators.context import LineCounter

    def recognise(image: bytes) -> str | None:
        pixels = decode(image)
        for variant in variants(pixels) if pixels is not None else ():
            for language in languages:
                try:
                    text = LineCounter().clean((engine(variant, language) or "").strip())
                except Exception:  # of one language or variant
                    continue
                if text.strip():
                    return text
        return None

    return recognise
