"""Media backends: what a deployment plugs in for codecs, OCR, speech and pixels.

The query core only needs rows.  A backend is a small picklable object; it is
opened once per Python worker.  ``Fake*`` backends make repeatable rows from
names, for tests.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

OBSERVED = "video string, ms long, boxes array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double,page_width:double,page_height:double,ink_score:double>>"
SPOKEN = "video string, start double, end double, text string"


class OcrBackend(Protocol):
    def open(self) -> None: ...

    def recognize(self, video: str, ms: int) -> list[dict]: ...


class SpeechBackend(Protocol):
    def open(self) -> None: ...

    def transcribe(self, video: str) -> list[tuple[float, float, str]]: ...


class FakeOcr:
    """One box per frame, its text chosen by a checksum of video and time."""

    def __init__(self, lines: tuple[str, ...] = ("once upon a time", "the cat went home", "the end")):
        self.lines = lines

    def open(self) -> None:
        self.ready = True

    def recognize(self, video: str, ms: int) -> list[dict]:
        text = self.lines[zlib.crc32(f"{video}|{ms // 4000}".encode()) % len(self.lines)]
        return [{"text": text, "confidence": 0.9, "x": 100.0, "y": 300.0, "width": 400.0, "height": 40.0, "page_width": 1280.0, "page_height": 720.0, "ink_score": 0.9}]


class FakeSpeech:
    def open(self) -> None:
        self.ready = True

    def transcribe(self, video: str) -> list[tuple[float, float, str]]:
        return [(0.0, 2.0, "Once upon a time"), (3.0, 5.0, "the cat went home."), (60.0, 62.0, "The end.")]


BACKENDS = {"fake": FakeOcr}


def ocr_backend(name: str) -> OcrBackend:
    if name not in BACKENDS:
        raise ValueError(f"unknown OCR backend {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]()


def observe(frames: DataFrame, backend: OcrBackend) -> DataFrame:
    """Boxes of each frame (video, ms).  Filter and de-duplicate frames first: nothing is pushed through this step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.open()
        for pdf in batches:
            yield pd.DataFrame({"video": pdf.video.astype(str), "ms": pdf.ms, "boxes": [backend.recognize(str(v), int(m)) for v, m in zip(pdf.video, pdf.ms)]})

    return frames.select("video", "ms").mapInPandas(run, OBSERVED)


def transcribe(videos: DataFrame, backend: SpeechBackend) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.open()
        for pdf in batches:
            rows = [(str(v), *segment) for v in pdf.video for segment in backend.transcribe(str(v))]
            yield pd.DataFrame(rows, columns=["video", "start", "end", "text"])

    return videos.select("video").mapInPandas(run, SPOKEN)
