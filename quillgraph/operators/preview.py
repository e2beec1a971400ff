"""A static page of a letter's text with its mentions marked, for reading; no script, everything escaped."""

from __future__ import annotations

import html
import json
import re

from ..sources.tei import Letter, project

_STYLE = "body{max-width:46em;margin:2em auto;font-family:serif;line-height:1.5}mark.PER{background:#fde7b0}mark.LOC{background:#cfe8cf}mark.ORG{background:#cfdcf5}mark.automatic{border-bottom:2px dotted}p{white-space:pre-wrap}"


def safe(url: str | None) -> bool:
    return bool(url) and re.match(r"https?://\S+$", url, re.IGNORECASE) is not None


def marked(text: str, mentions: list[dict]) -> str:
    """The text with mentions as marks; of overlapping ones the first is shown."""
    out, at = [], 0
    for m in sorted(mentions, key=lambda m: (m["start"], -m["end"])):
        if m["start"] < at:
            continue
        out.append(html.escape(text[at : m["start"]]))
        body = html.escape(text[m["start"] : m["end"]])
        link = next((u for u in m["entities"] if safe(u)), None)
        inner = f'<a href="{html.escape(link)}">{body}</a>' if link else body
        out.append(f'<mark class="{m["kind"]} {m["origin"]}" id="m{m["id"]}">{inner}</mark>')
        at = m["end"]
    return "".join(out) + html.escape(text[at:])


def page(source: bytes, mentions: bytes, path: str = "") -> str:
    """The page of a letter and its mentions file."""
    record = json.loads(mentions)
    letter = Letter(source, path)
    reading = record["settings"].get("reading", "edited")
    parts = []
    for k, block in enumerate(letter.blocks()):
        parts.append(f"<p>{marked(project(block, reading).text, [m for m in record['mentions'] if m['block'] == k])}</p>")
    # The record itself, for tools; "<" can't end the element.
    data = json.dumps(record, ensure_ascii=False).replace("<", "\\u003c")
    title = html.escape(letter.title())
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    return (
        f'<!DOCTYPE html>\n<html lang="de"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}">'
        f"<title>{title}</title><style>{_STYLE}</style></head><body><h1>{title}</h1>\n" + "\n".join(parts) + f'\n<script type="application/json" id="mentions">{data}</script></body></html>\n'
    )
