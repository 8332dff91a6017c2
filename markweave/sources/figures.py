"""Figures as SVG, without any plotting library: bars, grouped bars, heat maps and bubbles from small result tables."""

from __future__ import annotations

from html import escape
from pathlib import Path

import pandas as pd

WIDTH, HEIGHT, LEFT, BOTTOM, TOP, RIGHT = 900, 460, 90, 110, 50, 130
SERIES = ("#4C78A8", "#F58518", "#54A24B", "#E45756", "#72B7B2", "#B279A2")
#: Ends (and middle) of the colour scales, as red, green and blue.
SCALES = {"one way": ((247, 251, 255), (8, 48, 107)), "two ways": ((59, 76, 192), (242, 242, 242), (180, 4, 38))}


def _colour(share: float, scale: str) -> str:
    stops = SCALES[scale]
    at = min(max(share, 0.0), 1.0) * (len(stops) - 1)
    k = min(int(at), len(stops) - 2)
    return "#" + "".join(f"{round(a + (b - a) * (at - k)):02x}" for a, b in zip(stops[k], stops[k + 1]))


def _text(x: float, y: float, said, anchor: str = "middle", turn: float = 0, size: int = 11) -> str:
    turned = f' transform="rotate({turn} {x:.1f} {y:.1f})"' if turn else ""
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="{size}"{turned}>{escape(str(said))}</text>'


class Sheet:
    """An SVG page with a plot area and a scale of values on its left."""

    def __init__(self, title: str, columns: int = 10):
        self.width = max(WIDTH, LEFT + RIGHT + 14 * columns)
        self.height = HEIGHT
        self.parts = [_text(self.width / 2, 28, title, size=15)]

    @property
    def across(self) -> float:
        return self.width - LEFT - RIGHT

    @property
    def up(self) -> float:
        return self.height - TOP - BOTTOM

    def value_axis(self, low: float, high: float, label: str) -> None:
        for k in range(6):
            v = low + (high - low) * k / 5
            y = self.y(v, low, high)
            self.parts += [f'<line x1="{LEFT}" x2="{self.width - RIGHT}" y1="{y:.1f}" y2="{y:.1f}" stroke="#ddd"/>', _text(LEFT - 6, y + 4, f"{v:.3g}", "end")]
        self.parts.append(_text(18, TOP + self.up / 2, label, turn=-90))

    def y(self, value: float, low: float, high: float) -> float:
        return TOP + self.up * (1 - (value - low) / ((high - low) or 1))

    def box(self, x: float, y: float, w: float, h: float, fill: str, said: str) -> None:
        self.parts.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0.1):.1f}" height="{max(h, 0.0):.1f}" fill="{fill}"><title>{escape(said)}</title></rect>')

    def save(self, path: str | Path) -> Path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.height}" font-family="sans-serif"><rect width="100%" height="100%" fill="white"/>{"".join(self.parts)}</svg>', encoding="utf-8")
        return Path(path)


def bars(data: pd.DataFrame, x: str, columns: list[str], title: str, label: str, path: str | Path) -> Path:
    """A bar for every row, or a group of them where there are several columns; a missing value has none."""
    sheet = Sheet(title, len(data) * len(columns))
    values = data[columns].astype(float)
    low, high = min(0.0, float(values.min(axis=None)) if values.notna().any(axis=None) else 0.0), max(0.0, float(values.max(axis=None)) if values.notna().any(axis=None) else 1.0)
    high = high if high > low else low + 1
    sheet.value_axis(low, high, label)
    step = sheet.across / max(1, len(data))
    for i, (name, row) in enumerate(zip(data[x], values.itertuples(index=False))):
        for k, v in enumerate(row):
            if v == v:
                y0, y1 = sorted((sheet.y(0.0, low, high), sheet.y(v, low, high)))
                sheet.box(LEFT + i * step + step * (0.1 + 0.8 * k / len(columns)), y0, 0.8 * step / len(columns), y1 - y0, SERIES[k % len(SERIES)], f"{name} {columns[k]}: {v:.4g}")
        sheet.parts.append(_text(LEFT + (i + 0.5) * step, sheet.height - BOTTOM + 14, name, "end", -60))
    for k, c in enumerate(columns if len(columns) > 1 else []):
        sheet.box(sheet.width - RIGHT + 10, TOP + 18 * k, 12, 12, SERIES[k % len(SERIES)], c)
        sheet.parts.append(_text(sheet.width - RIGHT + 28, TOP + 18 * k + 10, c, "start"))
    return sheet.save(path)


def heat_map(data: pd.DataFrame, row: str, columns: list[str], title: str, label: str, low: float, high: float, path: str | Path, scale: str = "one way") -> Path:
    """A cell for every row and column, grey where there is no value; the scale of colours stands on the right."""
    sheet = Sheet(title, 2 * len(columns))
    sheet.height = TOP + BOTTOM + 16 * max(1, len(data))
    w = sheet.across / max(1, len(columns))
    for i, values in enumerate(data[[row, *columns]].itertuples(index=False)):
        sheet.parts.append(_text(LEFT - 6, TOP + 16 * i + 12, values[0], "end"))
        for k, v in enumerate(values[1:]):
            known = v is not None and v == v
            sheet.box(LEFT + k * w, TOP + 16 * i, w, 16, _colour((v - low) / (high - low), scale) if known else "#cccccc", f"{values[0]} {columns[k]}: {f'{v:.4g}' if known else 'none'}")
    for k, c in enumerate(columns):
        sheet.parts.append(_text(LEFT + (k + 0.5) * w, sheet.height - BOTTOM + 14, c, "end", -40))
    for k in range(11):
        sheet.box(sheet.width - RIGHT + 20, TOP + 10 * (10 - k), 14, 10, _colour(k / 10, scale), f"{low + (high - low) * k / 10:.3g}")
    sheet.parts += [_text(sheet.width - RIGHT + 40, TOP + 10, f"{high:g}", "start"), _text(sheet.width - RIGHT + 40, TOP + 110, f"{low:g}", "start"), _text(sheet.width - RIGHT + 20, TOP + 128, label, "start")]
    return sheet.save(path)


def bubbles(data: pd.DataFrame, x: str, y: str, size: str, title: str, low: float, high: float, path: str | Path) -> Path:
    """A circle for every pair of values, its area and colour by their number, over the diagonal."""
    sheet = Sheet(title)
    sheet.value_axis(low, high, y)
    at = lambda v: LEFT + sheet.across * (v - low) / (high - low)
    sheet.parts.append(f'<line x1="{at(low):.1f}" y1="{sheet.y(low, low, high):.1f}" x2="{at(high):.1f}" y2="{sheet.y(high, low, high):.1f}" stroke="gray" stroke-dasharray="5 4"/>')
    most = float(data[size].max()) if len(data) else 1.0
    for r in data[[x, y, size]].itertuples(index=False):
        sheet.parts.append(f'<circle cx="{at(r[0]):.1f}" cy="{sheet.y(r[1], low, high):.1f}" r="{2 + 14 * (r[2] / most) ** 0.5:.1f}" fill="{_colour(0.2 + 0.8 * r[2] / most, "one way")}" fill-opacity="0.8"><title>{r[0]:.4g}, {r[1]:.4g}: {r[2]}</title></circle>')
    for k in range(5):
        v = low + (high - low) * k / 4
        sheet.parts.append(_text(at(v), sheet.height - BOTTOM + 16, f"{v:g}"))
    sheet.parts.append(_text(LEFT + sheet.across / 2, sheet.height - BOTTOM + 40, x))
    return sheet.save(path)
