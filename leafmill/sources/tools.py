"""What extraction may use besides the built-in readers: limits, and functions for pictures, speech and difficult PDF files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: A page that a PDF function gives: number from 1, text, tables as rows of cells.
Page = tuple[int, str, list[list[list[str]]]]


@dataclass(frozen=True)
class Tools:
    """Options of :func:`leafmill.sources.extract.extract`; functions run on the executors, in Arrow batches, once a file or page.

    ``max_pdf_pages`` bounds the pages that are read of a PDF file (0: all); a note tells how many there are. ``ocr`` gets the bytes of a
    picture and gives its text: for picture files, and for PDF pages that show a picture and no text. ``pdf_tiers`` are asked in order for the pages of a
    PDF file of which the built-in reader gets no text, until one gives some; they get the bytes and the greatest number of pages. ``speech`` gets the bytes and name of a sound or film and gives what is said.
    """

    max_pdf_pages: int = 500
    ocr: Callable[[bytes], str] | None = None
    pdf_tiers: tuple[Callable[[bytes, int], list[Page]], ...] = ()
    speech: Callable[[bytes, str], str] | None = None
