"""Text of scanned pages through a recogniser that the caller plugs in.

The first page is probed with English data; the probe is reused when it reads as prose. Only when it
does not is the script asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from millrace.functions import text

MOST_PAGES = 8
#: recognise(image, language) -> text; script(image) -> name of the writing system.
Recogniser = Callable[[bytes, str], str]
# Language data by writing system.
SCRIPTS = {"Arabic": "ara", "Cyrillic": "rus", "Han": "chi_sim", "Japanese": "jpn", "Hangul": "kor", "Greek": "ell", "Hebrew": "heb"}
_WORD = re.compile(text.WORD)


def _share(value: str, words: Sequence[str]) -> float:
    found = _WORD.findall(value.lower())
    return sum(w in words for w in found) / len(found) if len(found) >= 15 else 0.0


def choose(image: bytes, installed: Sequence[str], recognise: Recogniser, script: Callable[[bytes], str]) -> tuple[str, str]:
    """(language, text of the first page, empty if it must be read again)."""
    if "eng" in installed:
        probe = recognise(image, "eng")
        if _share(probe, text.FRENCH) > 0.06 and "fra" in installed:
            return "fra", ""
        if _share(probe, text.FRENCH + text.ENGLISH) > 0.04:
            return "eng", probe
    wanted = SCRIPTS.get(script(image), "")
    if wanted in installed:
        return wanted, ""
    return (installed[0], "") if installed else ("", "")


def read(images: Sequence[bytes], installed: Sequence[str], recognise: Recogniser, script: Callable[[bytes], str], limit: int = 20000) -> tuple[str, str]:
    """(text, reason) of at most MOST_PAGES pages in one language."""
    if not images:
        return "", "no_pages"
    language, first = choose(images[0], installed, recognise, script)
    if not language:
        return "", "no_language_data"
    out, size = [], 0
    for k, image in enumerate(images[:MOST_PAGES]):
        out.append(first if k == 0 and first else recognise(image, language))
        size += len(out[-1])
        if size >= limit:
            break
    joined = "\n\n".join(x.strip() for x in out if x.strip())[:limit]
    return (joined, "") if joined else ("", "scan_empty")
