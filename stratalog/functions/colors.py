"""Terminal colours for 8-digit hex words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_WORD = re.compile(r"\b[0-9A-Fa-f]{8}\b")
#: The weights of red, green and blue in luminance, where text turns black, and the codes of 24-bit colours.
LUMINANCE, LIGHT = (0.299, 0.587, 0.114), 0.5
BACKGROUND, FOREGROUND, RESET = "\x1b[48;2;{};{};{}m", "\x1b[38;2;{}m", "\x1b[0m"
BLACK, WHITE = "0;0;0", "255;255;255"


def paint(word: str) -> str:
    """The word on the colour of its first six digits, in black if that is light, else in white."""
    colour = bytes.fromhex(word[:6])
    light = sum(k * c for k, c in zip(LUMINANCE, colour)) / 255 > LIGHT
    return BACKGROUND.format(*colour) + FOREGROUND.format(BLACK if light else WHITE) + word + RESET


def colorize(text: Column) -> Column:
    """Every 8-digit hex word of a string on a background of its colour; a null stays null."""

    @F.pandas_udf("string")
    def painted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else HEX_WORD.sub(lambda m: paint(m[0]), t))

    return painted(text)
