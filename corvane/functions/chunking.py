"""Structure of texts: headings and their trail, sections, chunks, runbooks, extractive records."""

from __future__ import annotations

import re

# Sizes of a chunk, in characters; names that tell the parts of a runbook.
MAX_CHARS, OVERLAP, MIN_CHARS = 1600, 200, 220
_ATX = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")
_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+([A-Z][^.!?]{2,80})$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def heading(line: str, below: str) -> tuple[int, str] | None:
    """Level and title of a heading line, which may be underlined by the next one."""
    text = line.strip()
    if not text or len(text) > 120:
        return None
    under = below.strip()
    if len(under) >= 3 and set(under) in ({"="}, {"-"}):
        return (1 if under[0] == "=" else 2), text
    m = _ATX.match(text)
    if m:
        return len(m[1]), m[2]
    if 4 <= len(text) <= 61 and text.isupper() and any(c.isalpha() for c in text):
        return 2, text.title()
    m = _NUMBERED.match(text)
    return (min(6, m[1].count(".") + 1), text) if m else None


def sections(text: str) -> list[tuple[str, str]]:
    """(trail of headings, body) in order; the whole text under no heading if there is none."""
    lines, out, trail, body = text.split("\n"), [], [], []

    def close() -> None:
        joined = "\n".join(body).strip()
        if joined:
            out.append((" › ".join(t for _, t in trail), joined))
        body.clear()

    skip = False
    for i, line in enumerate(lines):
        if skip:
            skip = False
            continue
        below = lines[i + 1] if i + 1 < len(lines) else ""
        h = heading(line, below)
        if h is None:
            body.append(line)
            continue
        close()
        skip = bool(below.strip()) and set(below.strip()) in ({"="}, {"-"}) and len(below.strip()) >= 3
        while trail and trail[-1][0] >= h[0]:
            trail.pop()
        trail.append(h)
    close()
    return out or ([("", text.strip())] if text.strip() else [])


def pieces(paragraph: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """A paragraph as it is, or its sentences packed up to ``most`` characters; longer sentences are cut."""
    if len(paragraph) <= most:
        return [paragraph]
    out, step = [""], max(1, most - overlap)
    for s in _SENTENCE.split(paragraph):
        for part in [s] if len(s) <= most else [s[i : i + most] for i in range(0, len(s), step)]:
            if out[-1] and len(out[-1]) + len(part) + 1 > most:
                out.append("")
            out[-1] = f"{out[-1]} {part}".strip()
    return [x for x in out if x]


def pack(body: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed up to ``most`` characters; each pack starts with the tail of the one before."""
    out, now = [], ""
    for part in (x for p in re.split(r"\n\s*\n", body) if p.strip() for x in pieces(p.strip(), most, overlap)):
        if now and len(now) + len(part) + 2 > most:
            out.append(now)
            tail = now[-overlap:] if overlap else ""
            now = f"{tail}\n\n{part}" if tail else part
        else:
            now = f"{now}\n\n{part}" if now else part
    return [*out, now] if now else out


def chunks(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> list[tuple[str, str]]:
    """(heading trail, text) of the chunks of a clean text; short ones go unless they are all there is."""
    cut = [(trail, p) for trail, body in sections(text) for p in pack(body, most, overlap)]
    kept = [c for c in cut if len(c[1]) >= least] or cut[:1]
    return [(trail, p if not trail or trail in p else f"{trail}\n\n{p}") for trail, p in kept]
