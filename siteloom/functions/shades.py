"""Colours in batches: contrast and the nearest readable shade over whole columns of #rrggbb texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE, BLACK = (255.0, 255.0, 255.0), (17.0, 17.0, 17.0)
#: The value of each hexadecimal digit by its character.
_DIGITS = np.full(256, -1, dtype=np.int16)
for _i, _c in enumerate("0123456789abcdef"):
    _DIGITS[ord(_c)] = _DIGITS[ord(_c.upper())] = _i


def channels(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(3 x n channels from 0 to 255, which texts are colours)."""
    codes = np.frombuffer(texts.fillna("").str.encode("ascii", "replace").to_numpy().astype("S7").tobytes(), dtype=np.uint8).reshape(-1, 7)
    digits = _DIGITS[codes[:, 1:]]
    known = (codes[:, 0] == ord("#")) & (digits >= 0).all(axis=1)
    return np.where(known, (digits[:, 0::2] * 16 + digits[:, 1::2]).T, 0).astype(float), known


def luminance(rgb: np.ndarray) -> np.ndarray:
    s = rgb / 255.0
    r, g, b = np.where(s <= 0.03928, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def ratio(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The contrast of luminances."""
    return (np.maximum(one, two) + 0.05) / (np.minimum(one, two) + 0.05)


def hue_and_saturation(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r, g, b = s = rgb / 255.0
    high, low = s.max(axis=0), s.min(axis=0)
    d = high - low
    safe = np.where(d == 0, 1.0, d)
    hue = np.where(high == r, 60 * np.mod((g - b) / safe, 6.0), np.where(high == g, 60 * ((b - r) / safe + 2), 60 * ((r - g) / safe + 4)))
    span = np.where(d == 0, 1.0, 1 - np.abs(2 * ((high + low) / 2) - 1))
    return np.where(d == 0, 0.0, hue), np.where(d == 0, 0.0, d / span)


def shade(hue: np.ndarray, saturation: np.ndarray, light: np.ndarray) -> np.ndarray:
    """Whole channels of a hue, a saturation and a lightness."""
    half = (1 - np.abs(2 * light - 1)) * saturation / 2
    out = []
    for n in (0.0, 8.0, 4.0):
        k = np.mod(n + hue / 30, 12.0)
        x = 255 * np.clip(light - half * np.maximum(-1.0, np.minimum(np.minimum(k - 3, 9 - k), 1.0)), 0.0, 1.0)
        whole = np.floor(x)
        out.append(whole + (x - whole >= 0.5))
    return np.stack(out)


def fitted(colour: np.ndarray, background: np.ndarray, least: float) -> np.ndarray:
    """Channels of the first shade that reaches the ratio, as ensure_contrast() has it. No channel turns back as the lightness goes away from the half, so steps are halved."""
    behind = luminance(background)
    sign = np.where(behind < 0.5, 1.0, -1.0)
    hue, saturation = hue_and_saturation(colour)
    at = lambda i: shade(hue, saturation, 0.5 + sign * i / 100.0)
    low, high = np.zeros(len(behind)), np.full(len(behind), 51.0)
    for _ in range(6):
        middle = np.floor((low + high) / 2)
        enough, going = ratio(luminance(at(middle)), behind) >= least, low < high
        low, high = np.where(going & ~enough, middle + 1, low), np.where(going & enough, middle, high)
    white, black = (np.array(c)[:, None] for c in (WHITE, BLACK))
    best = np.where(ratio(luminance(white), behind) >= ratio(luminance(black), behind), white, black)
    return np.where(low <= 50, at(low), best)


def named(rgb: np.ndarray) -> np.ndarray:
    r, g, b = rgb.astype(int)
    return np.array([f"#{x:06x}" for x in (r << 16 | g << 8 | b).tolist()], dtype=object)


@F.pandas_udf(StringType())
def readable(colours: pd.Series, backgrounds: pd.Series, least: pd.Series) -> pd.Series:
    """The colours, or their shades that reach the ratio on the backgrounds; null where either is no colour."""
    (one, known), (two, behind) = channels(colours), channels(backgrounds)
    both = known & behind
    out = np.where(both, colours.to_numpy(dtype=object), None)
    wanted = least.to_numpy()
    poor = np.flatnonzero(both & (ratio(luminance(one), luminance(two)) < wanted))
    if len(poor):
        out[poor] = named(fitted(one[:, poor], two[:, poor], wanted[poor]))
    return pd.Series(out, dtype=object)
