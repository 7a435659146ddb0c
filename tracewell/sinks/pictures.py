"""A document's results as a picture and as a page: what the driver shows of one document."""

from __future__ import annotations

import html
import json

#: Colours of the statuses.
COLOURS = {"verified": "#34d399", "low_confidence": "#fbbf24", "ambiguous": "#fb923c", "not_found": "#f87171"}


def overlay_svg(fields: list[dict], width: float, height: float, page: int | None = None, picture: str | None = None) -> str:
    """An SVG of a page with the boxes of its fields by status, and a banner of the fields that were not found.

    fields: dicts with name, value, status, page, bbox (x0, y0, x1, y1 as shares). Without a page, that of the first
    field with a box. picture: address of the page's raster, if there is one.
    """
    if page is None:
        page = next((f["page"] for f in fields if f.get("bbox")), 0)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">']
    if picture:
        out.append(f'<image href="{html.escape(picture, True)}" width="{width:g}" height="{height:g}"/>')
    size = max(8.0, width / 110)
    for f in fields:
        if f.get("bbox") and f["page"] == page:
            x0, y0, x1, y1 = (f["bbox"][k] * s for k, s in zip(("x0", "y0", "x1", "y1"), (width, height, width, height), strict=True))
            colour = COLOURS.get(f["status"], "#94a3b8")
            out.append(f'<rect x="{x0:g}" y="{y0:g}" width="{x1 - x0:g}" height="{y1 - y0:g}" fill="{colour}" fill-opacity="0.15" stroke="{colour}"/>')
            out.append(f'<text x="{x0:g}" y="{y0 - 2 if y0 > size + 2 else y1 + size:g}" font-size="{size:g}" fill="{colour}">{html.escape(f["name"])}</text>')
    lost = [f for f in fields if f["status"] == "not_found"]
    if lost:
        out.append(f'<rect width="{width:g}" height="{size * (len(lost) + 2):g}" fill="#7f1d1d" fill-opacity="0.82"/>')
        lines = ["NOT FOUND", *(f"{f['name']} = {f['value']}" for f in lost)]
        out += [f'<text x="10" y="{size * (k + 1):g}" font-size="{size:g}" fill="#fee2e2">{html.escape(t)}</text>' for k, t in enumerate(lines)]
    return "\n".join([*out, "</svg>"])


def viewer_html(payload: str) -> str:
    """One page that shows a payload; its meta is left out, values are set as text and can't become markup."""
    data = {k: v for k, v in json.loads(payload).items() if k != "meta"}
    body = json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")
    script = (
        "const d=JSON.parse(document.getElementById('data').textContent);const t=document.getElementById('rows');"
        "for(const [n,f] of Object.entries(d.fields||{})){const r=t.insertRow();for(const v of [n,f.value,f.status,f.confidence,f.evidence]){r.insertCell().textContent=v??''}r.className=f.status}"
    )
    style = "".join(f".{k}{{color:{v}}}" for k, v in COLOURS.items())
    return f'<!doctype html><meta charset="utf-8"><style>{style}</style><table id="rows"></table><script type="application/json" id="data">{body}</script><script>{script}</script>'
