"""What column expressions cannot say: compatibility decomposition, exact decimal rounding, chunking, MP3 frames.

All are Arrow-batched pandas functions over single values.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from itertools import accumulate, groupby

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .text import INLINE, WHITE

#: Vowel signs of Arabic that each form leaves out. Fixed values.
_MARKS = re.compile("[\\u064B-\\u065F\\u0670\\u06D6-\\u06ED]")
_SEARCH_MARKS = re.compile("[\\u064B-\\u0652\\u0640]")


_NEITHER, _NEITHER_ASCII = regex.compile(r"[^\p{L}\p{N}]+"), re.compile("[^A-Za-z0-9]+")


def match_form_of(s: str | None) -> str:
    """Decomposed, without vowel signs, letters and digits only, lower case: for aligning texts."""
    if not s:
        return ""
    if s.isascii():
        return _NEITHER_ASCII.sub(" ", s).strip().lower()
    bare = _MARKS.sub("", unicodedata.normalize("NFKD", s))
    return _NEITHER.sub(" ", bare).strip().lower()


_ENDS = re.compile(rf"\A{WHITE}+|{WHITE}+\Z")
_INLINE = [(literal, re.compile(pattern), replacement.replace("$1", r"\1")) for literal, pattern, replacement in INLINE]


def inline_of(s: str) -> str:
    """text.inline_text() of one value."""
    for literal, pattern, replacement in _INLINE:
        if literal in s:
            s = pattern.sub(replacement, s)
    return _ENDS.sub("", s)


def search_form_of(s: str | None) -> str:
    """Lower case, decomposed, alef and teh marbuta folded. The alefs are folded after they came apart, so that their
    hamza stays: a bare alef does not find them."""
    folded = unicodedata.normalize("NFKD", (s or "").lower())
    return _SEARCH_MARKS.sub("", re.sub("[أإآ]", "ا", folded).replace("ة", "ه"))


def fixed_of(x: float, digits: int) -> float:
    """Rounded by the exact binary value, halves away from zero."""
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def chunks_of(text: str | None, most: int) -> list[str]:
    """Pieces of at most ``most`` bytes: whole sentences as long as they fit, else whole words, else characters."""
    size = lambda s: len(s.encode())
    if not text or size(text) <= most:
        return [text] if text else []
    out: list[str] = []

    def fill(units: list[str], glue: str, finer) -> str:
        now = ""
        for u in units:
            new = now + glue + u if now else u
            if size(new) <= most:
                now = new
                continue
            if now:
                out.append(now)
            now = u
            if size(u) > most:
                now = finer(u)
        return now

    def letters(word: str) -> str:
        return fill(list(word), "", lambda c: c)

    def words(sentence: str) -> str:
        left = fill(sentence.split(), " ", letters)
        if left:
            out.append(left)
        return ""

    sentences = [s.strip() for s in re.findall(r"[^.!؟؛]+[.!؟؛]?", text) or [text]]
    last = fill([s for s in sentences if s], " ", words)
    return [p.strip() for p in [*out, last] if p.strip()]


def joined_of(items: list[str]) -> str:
    """Pieces joined by a space after an end mark, else by a full stop and a space."""
    text = ""
    for item in items:
        text = text + (" " if text[-1] in ".!؟؛:" else ". ") + item if text else item
    return text.strip()


def parts_of(items: list[str], most: int) -> list[int]:
    """For each piece the number of its part; a part is filled as long as its joined text has at most ``most`` bytes."""
    out, part, used, end = [], 0, 0, ""
    for item in items:
        size = len(item.encode())
        glue = 0 if not used else 1 if end in ".!؟؛:" else 2
        if used and used + glue + size > most:
            part, used, glue = part + 1, 0, 0
        used, end = used + glue + size, item[-1:]
        out.append(part)
    return out


def speech_weight_of(text: str) -> float:
    """A length in time: words, letters and pauses. As functions.text.speech_weight."""
    letters = len("".join(text.split()))
    return max(1.0, len(text.split()) + letters / 22 + sum(c in ".!؟" for c in text) * 1.1 + sum(c in "،؛:" for c in text) * 0.45)


def audio_parts_of(title: str, pieces: list[tuple], most: int) -> list[dict]:
    """The parts of an article's narration. pieces: (segment id, type, match, text) in order; the title is read first. A
    part has its text and, for each run of pieces of one segment, the share of the part's time that it takes."""
    rows = [(None, "title", "", title), *pieces]
    number = parts_of([r[3] for r in rows], most)
    out = []
    for _, group in groupby(zip(number, rows, strict=True), key=lambda x: x[0]):
        own = [r for _, r in group]
        upto = list(accumulate((speech_weight_of(r[3]) for r in own), initial=0.0))
        share = [fixed_of(x / upto[-1], 6) for x in upto]
        sync = []
        for segment, run in groupby(range(len(own)), key=lambda i: own[i][0]):
            at = list(run)
            if segment:
                sync.append({"id": segment, "type": own[at[0]][1], "match": own[at[0]][2], "start": share[at[0]], "end": share[at[-1] + 1]})
        out.append({"text": joined_of([r[3] for r in own]), "sync": sync})
    return out


#: MPEG layer III: kbit/s by index, for MPEG 1 and for MPEG 2 and 2.5. Fixed values.
MPEG1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
MPEG2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]


def mp3_seconds_of(data: bytes | None) -> float | None:
    """Play time from the frame headers; null with fewer than two frames."""
    if not data:
        return None
    at = frames = 0
    seconds = 0.0
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((data[6 + i] & 127) << (21 - 7 * i) for i in range(4))
        at = min(len(data), 10 + size + (10 if data[5] & 16 else 0))
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4], "big")
        version, layer, rate, sampling, pad = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3, head >> 9 & 1
        length = 0
        if head >> 21 == 0x7FF and version != 1 and layer == 1 and 0 < rate < 15 and sampling < 3:
            hertz = (44100, 48000, 32000)[sampling] // {0: 4, 2: 2, 3: 1}[version]
            first = version == 3
            length = (144000 if first else 72000) * (MPEG1 if first else MPEG2)[rate] // hertz + pad
        if length < 24 or at + length > len(data) + 4:
            at += 1
            continue
        frames, seconds, at = frames + 1, seconds + (1152 if first else 576) / hertz, at + length
    return fixed_of(seconds, 3) if frames >= 2 else None


@F.pandas_udf(StringType())
def match_form(s: pd.Series) -> pd.Series:
    return s.map(match_form_of)


@F.pandas_udf(StringType())
def search_form(s: pd.Series) -> pd.Series:
    return s.map(search_form_of)


@F.pandas_udf(DoubleType())
def mp3_seconds(s: pd.Series) -> pd.Series:
    return s.map(mp3_seconds_of)


def fixed(digits: int):
    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else fixed_of(v, digits))

    return run


def chunks(most: int):
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunks_of(t, most))

    return run
